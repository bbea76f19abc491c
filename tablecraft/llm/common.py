"""Shared plumbing: scratch tables, size-checked broadcasts, words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast only when it was counted and has at most so many rows.
BROADCAST_ROWS = 100_000
#: The same by the bytes of a written table's files, for rows with arrays.
BROADCAST_BYTES = 32_000_000
#: Texts of a batch become Python objects in parts of about so many bytes.
PART_BYTES = 4_000_000


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    It is set here only where it is unset and the session is local, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tablecraft-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tablecraft/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small, else as it is.

    Callers pass a written table, so counting reads only its footers.
    Beyond the limit the join shuffles, where adaptive execution splits hot keys.
    """
    return F.broadcast(df) if df.count() <= limit else df


def light(df: DataFrame) -> DataFrame:
    """A written table marked for broadcast if its files have at most ``BROADCAST_BYTES``; rows may be wide."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def words(text: str) -> Column:
    """Array of the words of a text column; empty for null and blank texts."""
    bare = F.btrim(text_or_empty(text), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def word_count(text: str) -> Column:
    bare = F.btrim(text_or_empty(text), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where a lambda within it uses it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in parts of about ``PART_BYTES``."""
    for batch in batches:
        step = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    release()


def release() -> None:
    """Gives freed memory back to the system; a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, whole: bool = True
) -> DataFrame:
    """``mapInArrow`` for functions that give the columns of one batch as a dict; without ``whole`` batches come in parts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def column(values: object, kind: pa.DataType) -> pa.Array:
        return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if whole else parts(batches):
            got = fn(batch)
            if got is not None:
                columns = [column(got[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        release()

    return df.mapInArrow(run, kind)
