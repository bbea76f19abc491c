"""Mixing sources to target weights by hash thresholds.

Sizes are summed by source and hash bucket; running sums over a source's
buckets find the bucket in which its budget ends; only that bucket is summed
again, by the next bits of the hash, until the boundary lies between two
hashes. Documents below a source's threshold are in: nothing is sorted, and a
larger budget takes a superset of what a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, word_count, written

HASH_BITS = 60
LEVEL_BITS = 12


def position(id_col: str, source_col: str) -> Column:
    """A document's place in its source: 60 bits of a hash of both, null as empty."""
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(source_col), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """A row per source: ``source_size`` and ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    the sum of all sizes. A target stops at ``max_repeats`` times its source;
    what is above goes to the others by weight, which ends at one level:
    ``target = min(max_repeats * size, weight * level)``. The windows run over
    one row per source, never over documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    per = per.withColumn("most", max_repeats * F.col("source_size"))
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    below = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(below), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    )
    per = per.withColumn("level", level).withColumn("nth", F.row_number().over(filling))
    first = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("nth", "level")))
    per = per.withColumn("level", first.over(everything)["level"])
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.lit(0.0)))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds ``repeats``, taken by all of a source, and ``threshold``: those up to it are taken once more.

    The documents of the boundary hash are in if that comes nearer to the target.
    """
    size = F.col("source_size")
    wanted = wanted.withColumn(
        "repeats", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    ).withColumn("rest", F.col("target") - F.col("repeats") * size)
    wanted = written(wanted, "targets")
    open_ = wanted.select("source", "rest", F.lit(0).cast("long").alias("prefix"))
    settled = None
    shift = HASH_BITS
    while True:
        above, shift = shift, shift - LEVEL_BITS
        near = open_.select(F.col("source").alias("s"), "rest", "prefix")
        inside = sized.join(
            small(near), sized["source"].eqNullSafe(F.col("s")) & (F.shiftright("hash", above) == F.col("prefix"))
        )
        bucket = F.shiftright("hash", shift)
        sums = inside.groupBy("source", "rest", bucket.alias("bucket")).agg(
            F.sum("size").alias("sum"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        order = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("sum").over(order)).withColumn("last", F.lead("bucket").over(order).isNull())
        # The bucket where the running sum passes what is left; the last one if it never does.
        edge = sums.where(
            ((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("sum") <= F.col("rest")))
            | (F.col("last") & (F.col("upto") <= F.col("rest")))
        )
        edge = edge.groupBy("source").agg(
            F.min_by(F.struct("bucket", "rest", "sum", "upto", "low", "high"), "bucket").alias("e")
        )
        edge = edge.select("source", "e.*").withColumn("rest", F.col("rest") - F.col("upto") + F.col("sum"))
        edge = written(edge, "edge")
        done = edge.where(F.col("low") == F.col("high")).select(
            "source", (F.col("low") - F.when(F.col("rest") >= F.col("sum") / 2, 0).otherwise(1)).alias("threshold")
        )
        settled = done if settled is None else settled.unionByName(done)
        open_ = edge.where(F.col("low") != F.col("high")).select("source", "rest", F.col("bucket").alias("prefix"))
        if shift <= 0 or open_.isEmpty():
            break
    ends = settled.withColumnRenamed("source", "s")
    return wanted.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """What a mix takes of every document, by its source's share.

    Gives ``doc_id, source, size, source_size, target, taken``: ``size`` counts
    words, ``taken`` is ``size`` times the number of times the document is
    taken, from 0 to ``max_repeats``. A document's place in its source depends
    on its id and source alone, so reruns agree.

    Null texts have size 0 and take nothing; a null source is a source of its
    own, ordered last; null ids and rows that repeat an id share one place and
    so one fate; a source without words has target 0; an empty table gives no
    rows; other columns are not looked at.
    """
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text_col).alias("size"),
            position(id_col, source_col).alias("hash"),
        ),
        "sizes",
    )
    return taken(sized, limits(sized, weights, max_repeats)).drop("hash")


def limits(sized: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    return written(thresholds(sized, targets(sized, weights, max_repeats)), "limits")


def taken(sized: DataFrame, limit: DataFrame) -> DataFrame:
    limit = limit.select(F.col("source").alias("s"), "source_size", "target", "repeats", "threshold")
    joined = sized.join(small(limit), sized["source"].eqNullSafe(F.col("s"))).drop("s")
    times = F.col("repeats") + F.coalesce((F.col("hash") <= F.col("threshold")).cast("long"), F.lit(0))
    return joined.withColumn("taken", F.col("size") * times).drop("repeats", "threshold")


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """The documents as the mix has them: whole rows, each as often as it is taken.

    A document without words weighs nothing and stays once.
    """
    sized = docs.select(
        *[F.col(c) for c in docs.columns],
        word_count("text").alias("__size"),
        position("doc_id", "source").alias("__hash"),
    )
    narrow = written(
        sized.select(F.col("source").cast("string").alias("source"), F.col("__size").alias("size"), F.col("__hash").alias("hash")),
        "sizes",
    )
    limit = limits(narrow, weights, max_repeats).select(
        F.col("source").alias("__source"), "repeats", "threshold"
    )
    joined = sized.join(small(limit), sized["source"].eqNullSafe(F.col("__source")))
    times = F.col("repeats") + F.coalesce((F.col("__hash") <= F.col("threshold")).cast("long"), F.lit(0))
    times = F.when(F.col("__size") == 0, F.lit(1)).otherwise(times).cast("int")
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)
