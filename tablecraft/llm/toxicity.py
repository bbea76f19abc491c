"""Toxicity by class-conditional Kneser-Ney models.

An expression's probability in a class is its discounted count there plus the
discounted mass times a shared backoff, which is the number of documents of
the whole corpus the expression occurs in: its continuation count, with
documents for contexts, which adds up over partitions. All expressions of all
documents are counted in a table. Expressions are single words, in no order.
What neither class has seen is as likely in one as in the other but for the
classes' discounted mass, whatever its count, so it needs no row in the model.
A text's log-likelihoods under both models are compared per expression and
normalised by length; a logistic curve, fitted on labelled rows that gave no
counts, turns them into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, parts, small, text_or_empty, written

DISCOUNT = 0.75
#: Evidence below this log ratio is left to the mean.
MARGIN = 2.0
#: Expressions with counts go to every task up to so many; beyond that texts are joined with their table.
BROADCAST_EXPRESSIONS = 400_000
#: Distinct expressions that a task counts before it passes them on.
HELD_EXPRESSIONS = 300_000
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
_WORD = re.compile(r"\w+")


def expressions(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass(frozen=True)
class ToxicityModel:
    ratios: dict[str, float] | None  # log ratio of toxic to ordinary, of expressions with counts; None: only in table
    unseen: float  # of all others
    weights: tuple[float, ...]
    table: DataFrame | None = None  # the same ratios as word, ratio

    def features(self, text: str | None) -> tuple[float, float, float]:
        words = expressions(text)
        if not words:
            return 1.0, 0.0, 0.0
        get, unseen = self.known(words).get, self.unseen
        ratios = [get(w, unseen) for w in words]
        strong = sum([r - MARGIN for r in ratios if r > MARGIN])
        return 1.0, strong / math.sqrt(len(words)), sum(ratios) / len(words)

    def known(self, words: list[str]) -> dict[str, float]:
        if self.ratios is not None:
            return self.ratios
        return {r["word"]: r["ratio"] for r in self.table.where(F.col("word").isin(sorted(set(words)))).collect()}

    def score(self, text: str | None) -> float:
        return self.value(self.features(text))

    def value(self, features: Iterable[float]) -> float:
        z = sum(w * x for w, x in zip(self.weights, features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, ...]:
    """Newton's method; the ridge keeps separable classes finite."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gain = x.T @ (y - p) - ridge * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gain)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fold(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, calibrating: int, id_col: str, text_col: str) -> DataFrame:
    """``text, toxic, fold`` of a bounded number of labelled rows outside the held-out fold, by a hash of the id."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", fold(id_col)).where(F.col("fold") != HELD_OUT)
    order = F.xxhash64(id_col)
    counted, apart = known.where(F.col("fold") != CALIBRATION), known.where(F.col("fold") == CALIBRATION)
    parts = [counted.where(c).orderBy(order).limit(per_class) for c in ("toxic = 1", "toxic <> 1")]
    chosen = parts[0].unionByName(parts[1]).unionByName(apart.orderBy(order).limit(calibrating))
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    # At most 2 * per_class + calibrating ids.
    return texts.join(F.broadcast(chosen), id_col).select("text", "toxic", "fold")


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 4000,
    calibrating: int = 3000,
    broadcast_expressions: int = BROADCAST_EXPRESSIONS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> ToxicityModel:
    """A model from at most ``2 * per_class + calibrating`` labelled rows and all documents.

    Class counts come from the sample, of every expression in it; the shared
    backoff from counts of all expressions of every document. More than
    ``broadcast_expressions`` of the sample stay a table, which scoring joins.
    Labels are read from ``labels`` (id column, ``toxic``); of several for an
    id the largest counts. Without toxic or ordinary labels all scores are the
    prior's.
    """
    rows = training_rows(docs, labels, per_class, calibrating, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, toxic, folds = (c.to_pylist() for c in batch.columns)
            held = [(t, y) for t, y, f in zip(texts, toxic, folds, strict=True) if f == CALIBRATION]
            n = [Counter(), Counter()]
            for t, y, f in zip(texts, toxic, folds, strict=True):
                if f != CALIBRATION:
                    n[y == 1].update(expressions(t))
            both = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*both, *[None] * len(held)], pa.string()),
                    pa.array([*(n[0][w] for w in both), *[None] * len(held)], pa.int64()),
                    pa.array([*(n[1][w] for w in both), *[None] * len(held)], pa.int64()),
                    pa.array([*[None] * len(both), *(t or "" for t, _ in held)], pa.string()),
                    pa.array([*[None] * len(both), *(y for _, y in held)], pa.int32()),
                ],
                names=["word", "n0", "n1", "text", "toxic"],
            )

    counted = written(rows.mapInArrow(count, "word string, n0 long, n1 long, text string, toxic int"), "labelled")
    sums = counted.where("word is not null").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sums = written(sums, "counts")
    total = sums.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1")],
        *[F.coalesce(F.sum((F.col(c) > 0).cast("long")), F.lit(0)).alias(f"t{c}") for c in ("n0", "n1")],
    ).first()
    if not total["n0"] or not total["n1"]:
        prior = (total["n1"] + 1) / (total["n0"] + total["n1"] + 2)
        return ToxicityModel({}, 0.0, (math.log(prior / (1 - prior)) - 1e-9, 0.0, 0.0))
    spread = written(document_counts(docs, text_col), "document-counts")
    of_all = spread.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    back = [DISCOUNT * total[f"tn{c}"] / total[f"n{c}"] for c in (0, 1)]
    p = (F.col("n") + 0.5) / (of_all["n"] + of_all["kinds"] + 1)
    seen = [F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / total[f"n{c}"] + back[c] * p for c in (0, 1)]
    joined = spread.join(small(sums, broadcast_expressions), "word")
    table = written(joined.select("word", F.log(seen[1] / seen[0]).alias("ratio")), "ratios")
    ratios = None
    if table.count() <= broadcast_expressions:
        got = table.toArrow()
        ratios = dict(zip(got["word"].to_pylist(), got["ratio"].to_pylist(), strict=True))
    model = ToxicityModel(ratios, math.log(back[1] / back[0]), (0.0, 0.0, 0.0), table)
    held = counted.where("text is not null").select("text", "toxic")
    found = with_features(held, model, "text", ["toxic"]).select("toxic", "__x").collect()
    apart = sorted(((r["toxic"] == 1, tuple(r["__x"])) for r in found))
    if len({y for y, _ in apart}) < 2:  # too few labels for a curve
        return replace(model, weights=(-3.0, 2.0, 0.0))
    x, y = np.array([x for _, x in apart]), np.array([float(y) for y, _ in apart])
    return replace(model, weights=logistic(x, y))


def document_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``word, n``: every expression and the number of documents that have it."""

    def occurs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def counts() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

        for batch in parts(batches):
            for text in batch.column(0).to_pylist():
                n.update(set(expressions(text)))
                if len(n) > HELD_EXPRESSIONS:
                    yield counts()
                    n.clear()
        yield counts()

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(occurs, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def with_features(docs: DataFrame, model: ToxicityModel, text_col: str, columns: list[str]) -> DataFrame:
    """``columns`` of every row and ``__x``, the features of its text."""
    if model.ratios is not None:
        carried = docs.sparkSession.sparkContext.broadcast(replace(model, table=None))
        at = docs.select(*columns, text_col)

        def of(batch: pa.RecordBatch) -> dict:
            found = [carried.value.features(t) for t in batch.column(len(columns)).to_pylist()]
            return dict(zip(columns, batch.columns, strict=False)) | {"__x": found}

        kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]
        return arrow_map(at, of, ", ".join([*kinds, "__x array<double>"]), whole=False)
    # Features depend on the text alone, so they are joined by its digest; equal texts are read once.
    digest = F.sha2(text_or_empty(text_col), 256)
    texts = docs.select(digest.alias("__sha"), text_or_empty(text_col).alias("text")).dropDuplicates(["__sha"])

    def split(batch: pa.RecordBatch) -> dict:
        rows = [(sha, w, n) for sha, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w, n in Counter(expressions(t)).items()]
        return {"__sha": [r[0] for r in rows], "word": [r[1] for r in rows], "times": [r[2] for r in rows]}

    words = arrow_map(texts, split, "__sha string, word string, times long").join(model.table, "word", "left")
    ratio, n = F.coalesce("ratio", F.lit(model.unseen)), F.sum("times")
    strong = F.sum(F.col("times") * F.greatest(ratio - MARGIN, F.lit(0.0)))
    x = F.array(F.lit(1.0), strong / F.sqrt(n), F.sum(F.col("times") * ratio) / n)
    per = written(words.groupBy("__sha").agg(x.alias("__x")), "features")
    found = docs.withColumn("__sha", digest).join(per, "__sha", "left")
    return found.select(*columns, F.coalesce("__x", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).alias("__x"))


def score_of(model: ToxicityModel) -> Column:
    z = sum((F.get("__x", F.lit(k)) * w for k, w in enumerate(model.weights)), F.lit(0.0))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    ``score`` is from 0 to 1, from the text alone; null counts as empty. A
    document is held out if its id's fold is; a null id's fold is that of the
    empty text. Repeated rows repeat; an empty table gives no rows; other
    columns are not looked at.
    """
    found = with_features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, "text", ["doc_id"])
    found = found.select("doc_id", score_of(model).alias("score"))
    return found.select(
        "doc_id",
        (fold("doc_id") == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The documents with a score below 0.5, whole rows."""
    if model.ratios is None:
        return with_features(docs, model, text_col, docs.columns).where(score_of(model) < 0.5).select(*docs.columns)
    carried = docs.sparkSession.sparkContext.broadcast(replace(model, table=None))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield batch.filter(pa.array([carried.value.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
