"""Substring deduplication by suffix automata of reference shards.

A passage is repeated if it starts in a document with a smaller id. Finding
where is a candidate search: in any run of ``window`` words the smallest hash
of a few words is the same wherever the run occurs, so only documents that
share such a hash, and only their runs that contain it, are hashed in full; a
run's owner is the smallest document with its hash. The owned runs of a
document are a reference shard. Its suffix automaton goes to the documents
that may repeat it, and only to them: they are streamed through it for
matching statistics, and maximal spans of at least ``window`` words go. So
words decide, not hashes, and the work follows the input instead of the
product of documents and shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, light, written
from .shingles import hashed_each, mixed, words_of

GRAM = 8
#: Stretches of a minimizer that more documents have are not gathered in one task.
HOT = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """Of sequences of words; ``add`` keeps what lies in different sequences apart."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, words: list) -> None:
        if len(self.next) > 1:
            self._push(object())  # equal to no word
        for w in words:
            self._push(w)

    def _push(self, w) -> None:
        nexts, link, length = self.next, self.link, self.length
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[self.last] + 1)
        p = self.last
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][w]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(w) == q:
                    nexts[p][w] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def spans(self, words: list, least: int) -> list[tuple[int, int]]:
        """Maximal ``[start, end)`` of ``words`` that occur, of ``least`` words or more, overlaps joined."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        out: list[tuple[int, int]] = []
        for at, w in enumerate(words):
            while state and w not in nexts[state]:
                state = link[state]
                matched = length[state]
            if w in nexts[state]:
                state = nexts[state][w]
                matched += 1
            if matched >= least:
                start = at + 1 - matched
                while out and out[-1][1] >= start:
                    start = min(start, out.pop()[0])
                out.append((start, at + 1))
        return out


def grams(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes) - GRAM + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(GRAM):
        out = out * _ODD + hashes[k : k + n]
    return mixed(out)


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """The smallest gram hash within each run of ``window`` words."""
    low, span, wanted = grams(hashes), 1, window - GRAM + 1
    while span * 2 <= wanted:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if wanted > span:
        low = np.minimum(low[: len(low) - (wanted - span)], low[wanted - span :])
    return low


def run_hashes(hashes: np.ndarray, window: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of ``window`` words, from running sums."""
    base = _ODD + np.uint64(2 * seed)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    n = len(hashes)
    up, down = np.full(n, base), np.full(n, inverse)
    up[0] = down[0] = 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * np.cumprod(up))])
    return mixed((sums[window:] - sums[:-window]) * np.cumprod(down)[: n - window + 1])


def sequence_print(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole sequence of words."""
    if not len(hashes):
        return 0, 0
    both = []
    for seed in (1, 2):
        powers = np.full(len(hashes), _ODD + np.uint64(2 * seed))
        both.append(int(mixed(np.array([np.sum(mixed(hashes + np.uint64(seed)) * np.cumprod(powers))], dtype=np.uint64)).view(np.int64)[0]))
    return both[0], both[1]


def kind_of(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def stretches(batch: pa.RecordBatch, window: int) -> dict:
    """``doc_id, low, at, r``: consecutive runs of words with one of the wanted minimizers, and their hashes."""
    rows, lows, at, sizes, hashes = [], [], [], [], []
    for row, (hashed, wanted) in enumerate(zip(hashed_each(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True)):
        if len(hashed) < window:
            continue
        low = minimizers(hashed, window).view(np.int64)
        inside = np.isin(low, wanted)
        starts = np.flatnonzero(inside)
        if not len(starts):
            continue
        first = np.flatnonzero(np.concatenate([[True], (np.diff(starts) > 1) | (np.diff(low[starts]) != 0)]))
        rows.append(np.full(len(first), row, dtype=np.int64))
        lows.append(low[starts[first]])
        at.append(starts[first].astype(np.int32))
        sizes.append(np.diff(first, append=len(starts)))
        hashes.append(run_hashes(hashed, window, 1)[starts].view(np.int64))
    cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    offsets = np.concatenate([[0], np.cumsum(cat(sizes, np.int64))])
    r = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cat(hashes, np.int64)))
    return {"doc_id": batch.column(0).take(pa.array(cat(rows, np.int64))), "low": cat(lows, np.int64), "at": cat(at, np.int32), "r": r}


def owned_stretches(found: pa.Table) -> dict:
    """``doc_id, owner, start, runs`` of stretches sorted by minimizer and document, all of a minimizer together.

    Runs are equal if their minimizers and their hashes are, 128 bits.
    """
    docs, low, at = found.column("doc_id").combine_chunks(), found.column("low").to_numpy(), found.column("at").to_numpy()
    r = found.column("r").combine_chunks()
    sizes = np.diff(r.offsets.to_numpy())
    hashes = r.flatten().to_numpy()
    group = np.cumsum(np.concatenate([[0], low[1:] != low[:-1]]))
    other = pc.not_equal(docs.slice(1), docs.slice(0, max(len(docs) - 1, 0))).to_numpy(zero_copy_only=False)
    doc = np.cumsum(np.concatenate([[0], (other | (low[1:] != low[:-1])).astype(np.int64)]))
    row = np.repeat(np.arange(len(low)), sizes)
    start = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # Stable: within equal runs the rows, and so the documents, are in their order.
    order = np.lexsort((hashes, group[row]))
    h, g = hashes[order], group[row][order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(order)) - 1
    which = np.cumsum(first) - 1
    head, tail = row[order][heads], row[order][tails]
    owner = np.full(len(order), -1, dtype=np.int64)
    owner[order] = np.where(doc[head] != doc[tail], head, -1)[which]
    kept = np.flatnonzero(owner >= 0)
    row, start, owner = row[kept], start[kept], owner[kept]
    own = doc[owner]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (own[1:] != own[:-1])])) if len(row) else kept
    return {"doc_id": docs.take(pa.array(row[new])), "owner": docs.take(pa.array(owner[new])), "start": start[new], "runs": np.diff(new, append=len(row))}


def by_minimizer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``owned_stretches`` of a sorted partition, in parts that end where a minimizer does."""
    held: list[pa.RecordBatch] = []

    def told(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        got = owned_stretches(pa.Table.from_batches(parts))
        kinds = [parts[0].schema.field("doc_id").type] * 2 + [pa.int32()] * 2
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(got.values(), kinds, strict=True)], names=list(got))

    for batch in batches:
        if not batch.num_rows:
            continue
        low = batch.column(1).to_numpy(zero_copy_only=False)
        if held and held[-1].column(1)[-1].as_py() != low[0]:
            yield told(held)
            held = []
        cut = int(np.searchsorted(low, low[-1]))
        if cut:
            yield told([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield told(held)


def repeated_runs(docs: DataFrame, owners: DataFrame, window: int) -> DataFrame:
    """``doc_id, owner, start, runs``: consecutive runs of words of a document with one owner.

    ``owner`` is the smallest of the documents that have them; its own are there
    too. Equal runs have one minimizer, so stretches of runs are dealt by it,
    once. Those of a minimizer that more than ``HOT`` documents have are dealt
    run by run, and joined with their owners in a way that Spark can split.
    """
    hashes = owners.select("owner", F.explode("low").alias("low"))
    shared = hashes.groupBy("low").agg(F.min("owner").alias("a"), F.max("owner").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b")
    marked = hashes.join(shared, "low").groupBy(F.col("owner").alias("doc_id")).agg(
        F.collect_set("low").alias("low"), F.collect_set(F.when(F.col("n") > HOT, F.col("low"))).alias("hot")
    )
    marked = written(marked, "marked")
    texts = docs.join(light(marked.drop("hot")), "doc_id").select("doc_id", "text", "low")
    kind = kind_of(docs)
    found = written(arrow_map(texts, lambda b: stretches(b, window), f"doc_id {kind}, low long, at int, r array<long>"), "runs")
    hot = written(marked.select(F.explode("hot").alias("low")).distinct(), "hot")
    cold = found.join(light(hot), "low", "left_anti").select("doc_id", "low", "at", "r")
    placed = cold.repartition("low").sortWithinPartitions("low", "doc_id").mapInArrow(by_minimizer, f"doc_id {kind}, owner {kind}, start int, runs int")
    placed = written(placed, "placed")
    if not hot.isEmpty():
        each = found.join(light(hot), "low").select("doc_id", "low", "at", F.posexplode("r").alias("k", "r0"))
        each = written(each.select("doc_id", (F.col("at") + F.col("k")).alias("start"), "low", "r0"), "each")
        owned = each.groupBy("low", "r0").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
        # Written, so that the join is by itself in its stage and a passage that many documents have can be split.
        owned = written(owned.where("owner < last").drop("last"), "owned")
        more = each.join(light(owned), ["low", "r0"]).select("doc_id", "owner", "start", F.lit(1).alias("runs"))
        placed = placed.unionByName(more)
    end = F.col("start") + F.col("runs")
    order = Window.partitionBy("doc_id", "owner").orderBy("start", "runs")
    ahead = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = placed.withColumn("new", F.coalesce(F.col("start") > ahead, F.lit(True)).cast("int"))
    island = new.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "owner", "island").agg(F.min("start").alias("start"), (F.max(end) - F.min("start")).alias("runs")).drop("island")


def matched_spans(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """``doc_id, start, end``: what the automata of the owners' passages find in documents."""
    marks = written(runs.groupBy("doc_id").agg(F.collect_list(F.struct("owner", "start", "runs")).alias("marks")), "marks")

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"owner": [], "doc_id": [], "start": [], "part": []}
        for doc, text, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = words_of(text)
            for m in marks:
                out["owner"].append(m["owner"])
                out["doc_id"].append(doc)
                out["start"].append(m["start"])
                out["part"].append(b" ".join(words[m["start"] : m["start"] + m["runs"] + window - 1]))
        return out

    texts = docs.join(light(marks), "doc_id").select("doc_id", "text", "marks")
    parts = written(arrow_map(texts, cut, f"owner {kind_of(docs)}, doc_id {kind_of(docs)}, start int, part string"), "parts")
    shards = parts.where("owner = doc_id").groupBy("owner").agg(F.sort_array(F.collect_set("part")).alias("shard"))
    # Written, so that the join is by itself in its stage and the parts that repeat one owner can be split.
    shards = written(shards, "shards")
    pairs = parts.where("owner < doc_id").join(light(shards), "owner").select("owner", "shard", "doc_id", "start", "part")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, SuffixAutomaton] = {}
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "start": [], "end": []}
            shard = batch.column(1)
            for i, (owner, doc, start, part) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True)):
                if owner not in held:
                    if len(held) >= 16:
                        held.pop(next(iter(held)))
                    held[owner] = automaton = SuffixAutomaton()
                    for passage in shard[i].as_py():
                        automaton.add(passage.split(" "))
                for a, b in held[owner].spans(part.split(" "), window):
                    out["doc_id"].append(doc)
                    out["start"].append(start + a)
                    out["end"].append(start + b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], batch.schema.field("doc_id").type), pa.array(out["start"], pa.int32()), pa.array(out["end"], pa.int32())],
                names=["doc_id", "start", "end"],
            )

    return pairs.mapInArrow(match, f"doc_id {kind_of(docs)}, start int, end int")


def drop_repeated_passages(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_text``.

    A word goes if it lies in ``window`` consecutive words of its document that
    also start in a document with a smaller id; that is judged on the input.
    Kept words are joined by one space. Documents with the same words in the
    same order are found first: all but the smallest go whole.

    Ids are of any type with an order. Null counts as empty; texts of fewer
    words than the window keep all; rows
    without an id are kept whole and are nobody's reference; ``id_col`` is a
    key, and rows repeated whole have equal results; an empty table gives no
    rows; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def of(batch: pa.RecordBatch) -> dict:
        n, low, both = [], [], []
        for hashed in hashed_each(batch.column(1).to_pylist()):
            n.append(len(hashed))
            both.append(sequence_print(hashed))
            low.append(np.unique(minimizers(hashed, window)).view(np.int64) if len(hashed) >= window else [])
        return {"doc_id": batch.column(0), "n": n, "p0": [b[0] for b in both], "p1": [b[1] for b in both], "low": low}

    prints = arrow_map(rows.where("doc_id is not null"), of, f"doc_id {kind_of(rows)}, n int, p0 long, p1 long, low array<long>")
    prints = written(prints.where(F.col("n") >= window), "words")
    key = ["n", "p0", "p1"]
    owners = prints.groupBy(*key).agg(
        F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.min_by("low", "doc_id").alias("low")
    )
    owners = written(owners, "owners")
    copies = owners.where("owner < last").select(*key, "owner")
    whole = prints.join(copies, key).where("doc_id > owner").select("doc_id")
    runs = written(repeated_runs(rows, owners, window), "repeated")
    spans = matched_spans(rows, runs, window)
    gone = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    gone = gone.unionByName(whole.distinct().select("doc_id", F.lit(None).cast(gone.schema["spans"].dataType).alias("spans")))
    gone = written(gone.withColumn("found", F.lit(True)), "gone")

    def keep(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": []}
        for text, spans, found in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            words = words_of(text)
            if found and spans is None:
                left = []
            elif found:
                drop = np.zeros(len(words), dtype=bool)
                for s in spans:
                    drop[s["start"] : s["end"]] = True
                left = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
            else:
                left = words
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(left))
            out["kept_text"].append(b" ".join(left))
        return {"doc_id": batch.column(0), **out}

    joined = rows.join(light(gone), "doc_id", "left").select("doc_id", "text", "spans", "found")
    return arrow_map(joined, keep, f"doc_id {kind_of(rows)}, n_words long, n_removed long, kept_text string")
