"""Media columns: payloads stored as FLAC, read back as seekable PCM blocks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from .common import arrow_map, text_or_empty

STEP = 64
#: Streams are coded in groups of about so many payload bytes.
GROUP_BYTES = 2_000_000


def padded(data: bytes) -> bytes:
    """Bytes 0 behind ``data`` up to a positive multiple of ``STEP``."""
    return data + bytes(max(STEP, -(-len(data) // STEP) * STEP) - len(data))


def _groups(items: list[bytes]) -> Iterator[list[bytes]]:
    run: list[bytes] = []
    held = 0
    for item in items:
        run.append(item)
        held += len(item)
        if held >= GROUP_BYTES:
            yield run
            run, held = [], 0
    if run:
        yield run


def store_flac(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text's UTF-8, padded, as a FLAC stream.

    Null counts as empty; equal texts give equal streams; ids may be null or
    repeat; an empty table gives no rows; other columns are not looked at.
    """

    def of(batch: pa.RecordBatch) -> dict:
        data = [t.encode() for t in batch.column(1).to_pylist()]
        media = [m for run in _groups([padded(x) for x in data]) for m in flac.encode(run)]
        return {"doc_id": batch.column(0), "n_bytes": [len(x) for x in data], "media": media}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return arrow_map(rows, of, f"doc_id {kind}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """``doc_id, block, first_sample, n_samples, pcm`` of the streams in ``media``.

    Every frame's checksums and every stream's digest are verified; a damaged
    stream raises. ``first_sample`` is the offset to seek to. A null stream has
    no blocks.
    """

    def of(batch: pa.RecordBatch) -> dict:
        at, block, first, n, pcm = [], [], [], [], []
        present = [(i, m) for i, m in enumerate(batch.column(1).to_pylist()) if m is not None]
        place = iter(present)
        for run in _groups([m for _, m in present]):
            for blocks in flac.decode(run):
                i = next(place)[0]
                sample = 0
                for k, x in enumerate(blocks):
                    at.append(i), block.append(k), first.append(sample), n.append(len(x)), pcm.append(x)
                    sample += len(x)
        ids = batch.column(0).take(pa.array(at, pa.int64()))
        return {"doc_id": ids, "block": block, "first_sample": first, "n_samples": n, "pcm": pcm}

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, block int, first_sample long, n_samples int, pcm binary"
    return arrow_map(media.select("doc_id", "media"), of, schema)


def feature(samples: np.ndarray, blocks: int) -> str:
    """What a stream sounds like, from its samples alone."""
    x = samples.astype(np.int64)
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    return (
        f"samples={len(x)};blocks={blocks};low={x.min()};high={x.max()};"
        f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings}"
    )


def media_digests(media: DataFrame) -> DataFrame:
    """Per stream, from the stored bytes: the payload's and the stream's digests, and features."""

    def of(batch: pa.RecordBatch) -> dict:
        stored = batch.column(2).to_pylist()
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "feature")}
        for run in _groups(stored):
            for blocks in flac.decode(run):
                payload = b"".join(blocks)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-STEP:]))
                out["feature"].append(feature((np.frombuffer(payload, np.uint8) ^ 0x80).view(np.int8), len(blocks)))
        return {
            "doc_id": batch.column(0),
            "n_bytes": batch.column(1),
            **out,
            "media_bytes": [len(m) for m in stored],
            "media_sha256": [hashlib.sha256(m).hexdigest() for m in stored],
        }

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "feature string, media_bytes long, media_sha256 string"
    )
    return arrow_map(media.select("doc_id", "n_bytes", "media"), of, schema)
