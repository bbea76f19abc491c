"""Exact deduplication by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks. A chunk's hash is a polynomial in a
fixed base; the hash of two strings after each other is the first one's,
shifted by the length of the second, plus the second one's. So chunks are
hashed apart, in any place, and combined in order. Texts with equal length and
fingerprint are then compared chunk by chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small, text_or_empty, written

CHUNK = 1 << 15
#: Rows of a group that are compared in one task.
GROUP_ROWS = 64
#: Primes below 2**31 and a base for each: products fit in 64 bits.
FIELDS = ((2147483647, 1000003), (2147483629, 998244353), (2147483587, 754974721))


def _powers(modulus: int, base: int) -> np.ndarray:
    out = np.empty(CHUNK, dtype=np.uint64)
    x = 1
    for i in range(CHUNK):
        out[CHUNK - 1 - i] = x
        x = x * base % modulus
    return out


class Polynomial:
    """Fingerprints of bytes; tables are made where they are used."""

    def __init__(self) -> None:
        self.powers = [_powers(m, b) for m, b in FIELDS]

    def chunk(self, data: bytes) -> tuple[int, ...]:
        # Bytes count one more, so that leading zeros count; 2**8 * 2**31 * 2**15 fits.
        x = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        return tuple(int(np.dot(x, p[CHUNK - len(x) :])) % m for p, (m, _) in zip(self.powers, FIELDS, strict=True))

    def text(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= CHUNK:
            return self.chunk(data)
        parts = ((self.chunk(data[i : i + CHUNK]), len(data[i : i + CHUNK])) for i in range(0, len(data), CHUNK))
        return combine(parts)


def combine(parts) -> tuple[int, ...]:
    """Hashes and lengths of consecutive chunks to the hash of the whole."""
    total = (0,) * len(FIELDS)
    for hashes, length in parts:
        total = tuple(
            (t * pow(b, length, m) + h) % m for t, h, (m, b) in zip(total, hashes, FIELDS, strict=True)
        )
    return total


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, f0, f1, f2, text_sha256`` of every row; null counts as empty."""
    state: dict = {}
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batch: pa.RecordBatch) -> dict:
        poly = state.setdefault("poly", Polynomial())
        data = [t.encode() for t in batch.column(1).to_pylist()]
        found = [poly.text(x) for x in data]
        return {
            "doc_id": batch.column(0),
            "n_bytes": [len(x) for x in data],
            **{f"f{k}": [x[k] for x in found] for k in range(len(FIELDS))},
            "text_sha256": [hashlib.sha256(x).hexdigest() for x in data],
        }

    schema = f"doc_id {kind}, n_bytes long, f0 long, f1 long, f2 long, text_sha256 string"
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("string").alias("text"))
    return arrow_map(rows, of, schema)


def chunk_fingerprints(docs: DataFrame, key: str, text_col: str, chunk_chars: int = CHUNK // 4) -> DataFrame:
    """The fingerprints of huge texts, one task to some chunks of them, combined in order.

    ``key`` must tell rows apart. Gives the same values as ``fingerprints``.
    """
    n = F.greatest(F.lit(1), F.ceil(F.length(text_col) / chunk_chars)).cast("int")
    chunks = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"), F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    chunks = chunks.select("key", "at", F.substring("text", F.col("at") * chunk_chars + 1, F.lit(chunk_chars)).alias("part"))
    state: dict = {}

    def of(batch: pa.RecordBatch) -> dict:
        poly = state.setdefault("poly", Polynomial())
        data = [t.encode() for t in batch.column(2).to_pylist()]
        found = [poly.chunk(x) for x in data]
        return {
            "key": batch.column(0),
            "at": batch.column(1),
            "n_bytes": [len(x) for x in data],
            **{f"f{k}": [x[k] for x in found] for k in range(len(FIELDS))},
        }

    kind = docs.schema[key].dataType.simpleString()
    hashed = arrow_map(chunks.repartition("key", "at"), of, f"key {kind}, at int, n_bytes long, f0 long, f1 long, f2 long")
    whole = hashed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "n_bytes", "f0", "f1", "f2"))).alias("parts"))

    def join(batch: pa.RecordBatch) -> dict:
        found = [combine(((p["f0"], p["f1"], p["f2"]), p["n_bytes"]) for p in parts) for parts in batch.column(1).to_pylist()]
        return {
            "key": batch.column(0),
            "n_bytes": [sum(p["n_bytes"] for p in parts) for parts in batch.column(1).to_pylist()],
            **{f"f{k}": [x[k] for x in found] for k in range(len(FIELDS))},
        }

    return arrow_map(whole, join, f"key {kind}, n_bytes long, f0 long, f1 long, f2 long").withColumnRenamed("key", key)


PRINT = ["n_bytes", "f0", "f1", "f2"]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays. Rows whose fingerprints
    are equal are compared with their group's first text chunk by chunk; a row
    that differs after all goes by its digest into a group of its own.

    Null counts as the empty text, and all empty texts are equal; rows without
    an id lose to rows with one; rows that repeat an id are all kept if it is
    the largest; an empty table gives no rows; other columns are not looked at.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = prints.groupBy(*PRINT).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.where("group_size > 1"), "groups")
    members = prints.join(small(groups), PRINT).select("doc_id", "keep_id", "group_size", *PRINT)
    wrong = differing(docs, written(members, "members"), id_col, text_col)
    by_digest = ["text_sha256", *PRINT]
    if wrong.isEmpty():
        found = prints.join(small(groups), PRINT, "left")
    else:
        # Fingerprints met by chance: the digest decides within those groups.
        exact = prints.groupBy(*by_digest).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = prints.join(exact, by_digest, "left")
    keep = F.coalesce("keep_id", "doc_id")
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.col("group_size").isNull() | F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    )


def differing(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Members of a group whose text is not the text of the row that would stay.

    Both texts are cut alike and joined by group and chunk, so that a comparison
    holds two chunks, not two texts. Only texts of groups are read into it.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    ours = texts.join(small(members.distinct()), "doc_id").where(F.octet_length("text") == F.col("n_bytes"))
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / CHUNK)).cast("int")
    cut = ours.select("doc_id", "keep_id", "group_size", *PRINT, "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    cut = cut.withColumn("part", F.substring("text", F.col("at") * CHUNK + 1, F.lit(CHUNK))).drop("text")
    # A large group is dealt to several tasks, each with a copy of its first text.
    salts = F.ceil(F.col("group_size") / GROUP_ROWS).cast("int")
    key = [*PRINT, "at", "salt"]
    stays = cut.where(F.col("doc_id") == F.col("keep_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    first = stays.groupBy(*key).agg(F.min("part").alias("first"))
    others = cut.where(F.col("doc_id") != F.col("keep_id"))
    others = others.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
    return others.join(first, key).where(F.col("part") != F.col("first")).select("doc_id").limit(1)
