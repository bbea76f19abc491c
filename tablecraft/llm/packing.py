"""Best-fit packing of token sequences.

Bulk-synchronous best fit. Token counts are integers up to the capacity, so
the range sort of documents and of gaps is a counting sort: both sides become
runs of equal lengths. A round takes the documents of one length, longest
first; its successor sweep walks the runs of gaps upwards from that length;
documents that want the same gap are dealt by their rank; the gaps shrink, and
the next round starts. What meets on the driver is one count per length, at
most ``capacity`` numbers however large the corpus; documents stay where they
are and find their place from their rank.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, written
from .shingles import Words

#: An encoder forgets parts it has met in one run of texts beyond so many, and in several beyond so many; longer ones are not kept.
NEW_PARTS = 150_000
CACHED_PARTS = 400_000
CACHED_LENGTH = 64
#: Marks that can follow a word; not the apostrophe, which begins some of the tokenizer's words.
TAILS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's
    ids are those of its blank-separated parts. The distinct parts of several
    texts are encoded, or looked up if seen before, and their ids are dealt out
    to all places. A part of letters with ASCII punctuation behind it is two of
    the tokenizer's words; new Latin words are merged together, in one call, and
    told apart by the tokens that end a word.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        if not tokenizer.startswith("/"):
            import public_tokenizers

            tokenizer = str(public_tokenizers.path(tokenizer))
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.parts: dict[bytes, bytes] = {}
        self.new_parts: dict[bytes, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        tokens = map(self.tokenizer.id_to_token, range(size))
        self.ends = np.array([(t or "").endswith("</w>") for t in tokens])
        # The same merges without the regular expressions around them, for Latin words.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in printed]
        self.letters = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(rest)} | {32: " "}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _latin(self, words: list[str]) -> dict[str, bytes]:
        """Lower case of these is a letter for a letter, and they are in composed form."""
        text = " ".join(words).lower().encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        data = ids.tobytes()
        return {w: data[a:b] for w, a, b in zip(words, stops[:-1], stops[1:], strict=True)}

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        split, odd = [], []
        for i, part in enumerate(parts):
            p = part.decode()
            core = p.rstrip(TAILS)
            if core.isalpha() and (core.isascii() or max(core) < "\u0250" and "\u0130" not in core):
                split.append((i, core, p[len(core) :]))
            else:
                odd.append((i, p))
        new = {core for _, core, _ in split}.union([tail for _, _, tail in split])
        new.discard("")
        words = self._latin(list(new)) if new else {}
        words[""] = b""
        out = [b""] * len(parts)
        for i, core, tail in split:
            out[i] = words[core] + words[tail]
        for (i, _), ids in zip(odd, self._ids([p for _, p in odd]), strict=True):
            out[i] = array("I", ids).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        words = Words([t.encode() for t in texts])
        distinct, number = words.distinct()
        ids = list(map(self.parts.get, distinct))
        missing = [i for i, x in enumerate(ids) if x is None]
        # Most distinct parts of a corpus occur once or twice; only those met again are kept for long.
        if len(self.parts) > CACHED_PARTS:
            self.parts.clear()
        for i in missing:
            again = self.new_parts.pop(distinct[i], None)
            if again is not None:
                ids[i] = self.parts[distinct[i]] = again
        missing = [i for i in missing if ids[i] is None]
        new = [distinct[i] for i in missing]
        for i, x in zip(missing, self._learn(new), strict=True):
            ids[i] = x
        if len(self.new_parts) + len(new) > NEW_PARTS:
            self.new_parts.clear()
        self.new_parts.update((p, ids[i]) for p, i in zip(new[:NEW_PARTS], missing, strict=False) if len(p) <= CACHED_LENGTH)
        lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        store = np.frombuffer(b"".join(ids), dtype="<u4")
        each = lengths[number]
        ends = np.cumsum(each)
        # The place in the store of every token: where its part's ids begin, and how far in it is.
        begin = (np.cumsum(lengths) - lengths)[number]
        found = store[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - each), each)]
        stops = np.concatenate([[0], ends])[np.cumsum(words.counts)].tolist()
        return [found[a:b].tobytes() for a, b in zip([0, *stops[:-1]], stops, strict=True)]


@functools.cache
def encoder_for(tokenizer: str) -> WordEncoder:
    """One per worker process: later tasks find the words that earlier ones have met."""
    return WordEncoder(tokenizer)


def by_size(texts: list[str | None], most: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of some million characters; null counts as empty."""
    run: list[str] = []
    held = 0
    for text in texts:
        run.append(text or "")
        held += len(run[-1])
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run


def plan_rounds(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best fit, longest first, over runs of equal lengths and equal gaps.

    Gives rows ``(length, first rank, first sequence, documents to a sequence,
    offset)`` sorted by length and rank, and the number of sequences.
    """
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    rows, made = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for gap in range(length, capacity + 1):
            each = gap // length
            while left and gaps[gap]:
                first, n = gaps[gap].pop()
                took = min(left, n * each)
                rows.append((length, rank, first, each, capacity - gap))
                full, rest = divmod(took, each)
                if full and gap - each * length:
                    gaps[gap - each * length].append((first, full))
                if rest:
                    gaps[gap - rest * length].append((first + full, 1))
                if n > full + bool(rest):
                    gaps[gap].append((first + full + bool(rest), n - full - bool(rest)))
                rank, left = rank + took, left - took
            if not left:
                break
        if left:
            each = capacity // length
            rows.append((length, rank, made, each, 0))
            full, rest = divmod(left, each)
            if full and capacity - each * length:
                gaps[capacity - each * length].append((made, full))
            if rest:
                gaps[capacity - rest * length].append((made + full, 1))
            made += full + bool(rest)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), made


def pieces_of(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str
) -> DataFrame:
    """Token pieces, with the partition that made them and their rank by length there."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = array("I", [end_id]).tobytes()
    state: dict = {}

    def cut(batch: pa.RecordBatch) -> dict:
        if "encoder" not in state:
            state.update(encoder=encoder_for(tokenizer), ranks=[0] * (capacity + 1))
        encoder, ranks = state["encoder"], state["ranks"]
        rows = []
        coded = (x for run in by_size(batch.column(1).to_pylist()) for x in encoder.encode(run))
        for i, ids in enumerate(coded):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                n = len(part) // 4
                rows.append((i, piece, at // 4, n, zlib.crc32(part), ranks[n]))
                ranks[n] += 1
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        return {
            "id": batch.column(0).take(pa.array(cols[0], pa.int64())),
            "piece": cols[1],
            "start": cols[2],
            "length": cols[3],
            "ids_crc32": cols[4],
            "rank": cols[5],
            "dealt": [TaskContext.get().partitionId()] * len(rows),
        }

    return arrow_map(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
        cut,
        f"id {kind}, piece int, start long, length long, ids_crc32 long, rank long, dealt int",
        whole=False,
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens.

    Every row of ``docs`` is tokenized whole and closed by ``end_id``; only
    longer ones are cut. Gives a row per piece: the id column, ``piece``,
    ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``. Within a
    sequence offsets leave no gap.

    A null text counts as empty (one token, the end); a null id is kept;
    repeated rows are packed as often as they occur, ties are broken by the
    rank within the partition; an empty table gives no rows; other columns are
    not looked at.
    """
    pieces = written(pieces_of(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    per_task = pieces.groupBy("length", "dealt").count()
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan, _ = plan_rounds(counts, capacity)
    before = Window.partitionBy("length").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("length", "dealt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    # A length's runs are found by one search over (length, rank) as a single number.
    keys = (plan[:, 0] << 48) | plan[:, 1]

    def place(batch: pa.RecordBatch) -> dict:
        got = dict(zip(batch.schema.names, batch.columns, strict=True))
        length = got["length"].to_numpy(zero_copy_only=False)
        rank = got["rank"].to_numpy(zero_copy_only=False) + got["ahead"].to_numpy(zero_copy_only=False)
        run = plan[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
        nth = rank - run[:, 1]
        got["sequence_id"] = run[:, 2] + nth // run[:, 3]
        got["offset"] = run[:, 4] + nth % run[:, 3] * length
        return got

    placed = arrow_map(
        pieces.join(starts, ["length", "dealt"]),
        place,
        f"id {pieces.schema['id'].dataType.simpleString()}, piece int, start long, length long, "
        "ids_crc32 long, sequence_id long, offset long",
    )
    return placed.withColumnRenamed("id", id_col)
