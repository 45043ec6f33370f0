"""Word tables over batches of UTF-8 texts, built with numpy.

A table holds every word of a few texts: where it starts and ends in one byte buffer, which
text it is of, and 64-bit hashes. Words are maximal runs of bytes that a class table marks;
both classes used here keep all bytes from 0x80 up, so words of any script stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (a longer single text is taken alone).
SLICE_BYTES = 1 << 20

_BYTE = np.arange(256)
#: Marks bytes of words that white space (0x20, 0x09-0x0D) ends.
NOT_SPACE = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
#: Marks ASCII letters, digits and every byte from 0x80.
ALNUM = (
    ((_BYTE >= 0x30) & (_BYTE <= 0x39))
    | ((_BYTE >= 0x41) & (_BYTE <= 0x5A))
    | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
    | (_BYTE >= 0x80)
)
#: A-Z to a-z, all else unchanged.
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Two seeds, so that two hashes of a word tell nothing of each other.
_SEEDS = mix(np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64))
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed by a library, one at a time.
_LONG_WORD = 256


def eights(buf: np.ndarray) -> np.ndarray:
    """From each byte on, eight of them as one number; zeros follow the last byte."""
    out = np.zeros(len(buf) + 8, np.uint8)
    out[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", out, 0, (1,))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the bytes start..end of each word, eight at a time, each eight stirred into the last.

    Nothing is added up over a word, so no arrangement of the same bytes cancels out. Words of at
    most eight bytes that are equally long never collide; `which` names one of two independent hashes.
    """
    seed = _SEEDS[which]
    size = end - start
    view = eights(buf)
    out = mix(view[start] & _FIRST[np.minimum(size, 8)] ^ (size.astype(_U) * _U(0xA0761D6478BD642F) + seed))
    more = np.flatnonzero(size > 8)
    done = 8
    long = more[size[more] > _LONG_WORD]
    more = more[size[more] <= _LONG_WORD]
    while len(more):
        chunk = view[start[more] + done] & _FIRST[np.minimum(size[more] - done, 8)]
        out[more] = mix((out[more] ^ chunk) + seed)
        done += 8
        more = more[size[more] > done]
    for i in long.tolist():
        key = int(seed).to_bytes(8, "little")
        out[i] = int.from_bytes(blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return out


class Words:
    """All words of some texts. first[i]..first[i+1] are the words of text i."""

    def __init__(self, texts: list[bytes | None], klass: np.ndarray = NOT_SPACE, lower: bool = False) -> None:
        raw = b"\n" + b"\n".join(t or b"" for t in texts) + b"\n"
        self.n = len(texts)
        self.buf = np.frombuffer(raw, np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        is_word = klass[self.buf]
        edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t or b"") for t in texts), np.int64, self.n)
        self.begin = np.concatenate(([1], np.cumsum(lengths + 1) + 1))
        self.lengths = lengths
        self.first = np.searchsorted(self.start, self.begin)
        self.counts = np.diff(self.first)
        self._hashes: dict[int, np.ndarray] = {}

    def doc(self) -> np.ndarray:
        """The text's number for each word."""
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """One of two independent 64-bit hashes of each word."""
        if which not in self._hashes:
            self._hashes[which] = word_hashes(self.buf, self.start, self.end, which)
        return self._hashes[which]

    def windows(self, size: int, which: int = 0, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of `size` consecutive words, from every word or those numbered `at`.

        Hashes of twice as many words are stirred together until two of them, which may overlap,
        cover a window. Entries whose window would leave the text are meaningless; see fits().
        """
        x, n, have = self.hashes(which), len(self.start), 1
        if size > n:
            return np.zeros(n if at is None else len(at), _U)
        while have < size:
            step = min(have, size - have)
            left, right = x[: len(x) - step], x[step:]
            x = mix(left * _U(0x9E3779B97F4A7C15) + right + _U(have + step))
            have += step
        if len(x) < n:
            x = np.concatenate((x, np.zeros(n - len(x), _U)))
        return x if at is None else x[at]

    def fits(self, size: int) -> np.ndarray:
        """Whether `size` words from each word on are in its text."""
        last = np.repeat(self.first[1:], self.counts)
        return np.arange(len(self.start)) + size <= last

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def lines(self) -> tuple[bytes, bytes, np.ndarray]:
        """All words, each followed by a blank; the same from the last word to the first; where each word begins in the first."""
        size = self.end - self.start + 1
        edge = np.concatenate(([0], np.cumsum(size)))
        rel = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
        spaced = self.buf.copy()
        spaced[self.end] = 0x20
        back = np.concatenate(([0], np.cumsum(size[::-1])))
        turned = np.arange(edge[-1]) - np.repeat(back[:-1], size[::-1])
        return spaced[np.repeat(self.start, size) + rel].tobytes(), spaced[np.repeat(self.start[::-1], size[::-1]) + turned].tobytes(), edge

    def joined(self, keep: np.ndarray | None = None) -> list[memoryview]:
        """For each text its kept words, joined by one space."""
        delta = np.zeros(len(self.buf) + 1, np.int8)
        starts, ends = (self.start, self.end) if keep is None else (self.start[keep], self.end[keep])
        delta[starts] += 1
        delta[ends + 1] -= 1  # with the byte that follows each word
        inside = np.cumsum(delta[:-1], dtype=np.int8) > 0
        spaced = self.buf.copy()
        spaced[ends] = 0x20
        out = memoryview(spaced[inside].tobytes())
        sizes = np.concatenate(([0], np.cumsum(ends + 1 - starts)))
        counts = self.first if keep is None else np.concatenate(([0], np.cumsum(keep)))[self.first]
        cut = sizes[counts]
        return [out[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def column_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's values in UTF-8."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(texts: list[bytes | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about `most` bytes each."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if held and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(texts):
        yield lo, len(texts)
