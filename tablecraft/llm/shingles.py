"""Words of texts and 64-bit hashes of them, the same in every process."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Texts are hashed together in runs of about so many bytes.
RUN_BYTES = 1_000_000
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: By the number of bytes, up to 8: the mask that keeps the first of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and U+0009 to U+000D, in UTF-8: bytes are split at just these. Null has none."""
    return (text or "").encode().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of several texts in UTF-8, one text's after the other's: places in one buffer, no objects."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n" + bytes(8)
        # Every place as a number of the eight bytes from there on.
        self.blocks = np.ndarray(len(self.data) - 7, dtype="<u8", buffer=self.data, strides=(1,))
        space = _SPACE[np.frombuffer(self.data, dtype=np.uint8)[:-8]]
        before = np.concatenate([[True], space[:-1]])
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(space & ~before)
        self.sizes = self.ends - self.starts
        stops = np.cumsum([len(t) + 1 for t in texts])
        #: Number of words of each text.
        self.counts = np.diff(np.searchsorted(self.starts, stops), prepend=0)

    def cut(self, which: np.ndarray) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]

    def hashes(self) -> np.ndarray:
        """64 bits of each word, from its 8-byte blocks and its length; all words at once, block by block."""
        out = mixed(self.sizes.astype(np.uint64) * _STEP)
        active = np.flatnonzero(self.sizes <= LONG_WORD)
        at, left = self.starts[active], self.sizes[active]
        while len(active):
            block = self.blocks[at] & _FIRST[np.minimum(left, 8)]
            out[active] = mixed((out[active] ^ block) * _STEP + np.uint64(1))
            more = left > 8
            active, at, left = active[more], at[more] + 8, left[more] - 8
        long = np.flatnonzero(self.sizes > LONG_WORD)
        if len(long):
            out[long] = pd.util.hash_array(np.array(self.cut(long), dtype=object), categorize=False)
        return out

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct words, and for each word its number among them."""
        _, first, number = np.unique(self.hashes(), return_index=True, return_inverse=True)
        if self._equal(first[number]):
            return self.cut(first), number
        known: dict[bytes, int] = {}  # two words have one hash
        number = [known.setdefault(w, len(known)) for w in self.cut(np.arange(len(number)))]
        return list(known), np.array(number)

    def _equal(self, other: np.ndarray) -> bool:
        """Whether each word is the one of number ``other``, byte by byte."""
        if (self.sizes != self.sizes[other]).any():
            return False
        active = np.flatnonzero((self.sizes <= LONG_WORD) & (self.starts != self.starts[other]))
        at, there, left = self.starts[active], self.starts[other[active]], self.sizes[active]
        while len(at):
            if ((self.blocks[at] ^ self.blocks[there]) & _FIRST[np.minimum(left, 8)]).any():
                return False
            more = left > 8
            at, there, left = at[more] + 8, there[more] + 8, left[more] - 8
        long = np.flatnonzero(self.sizes > LONG_WORD)
        return self.cut(long) == self.cut(other[long])


def hashed_texts(texts: list[str | None], lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words and numbers of words of the texts, in runs; null counts as empty, only A to Z are made lower case."""
    run: list[bytes] = []
    held = 0
    for text in texts:
        data = (text or "").encode()
        run.append(data.lower() if lower else data)
        held += len(data)
        if held >= RUN_BYTES:
            words = Words(run)
            yield words.hashes(), words.counts
            run, held = [], 0
    if run:
        words = Words(run)
        yield words.hashes(), words.counts


def hashed_each(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The hashes of each text's words."""
    for hashes, counts in hashed_texts(texts):
        yield from np.split(hashes, np.cumsum(counts)[:-1])
