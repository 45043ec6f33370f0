"""Passages that repeat: words covered by a window of `length` words that also starts elsewhere.

Both operators here find, for every window of `length` consecutive words of every document,
whether its word sequence starts earlier (smaller doc_id, or same document, earlier start) or
elsewhere at all. Neither looks at every window: each chooses anchors, a sparse set of places,
and passes over those whose first words, by a hash, begin nowhere else.

* suffix_array_dedup: sparse suffix arrays. The suffixes retained start at minimiser positions:
  of the k-word prefixes inside a window the leftmost of least hash. Equal windows choose the
  same place, so they share a retained suffix. Suffixes go with their words, are sorted by them
  within groups of equal first k words, and the words of neighbours are compared: how far each
  agrees with the next says which agree to any depth. Their left sides, read backwards, are sorted
  and compared likewise. Windows are equal that agree far enough on both sides.
* substring_dedup: difference-cover anchors. Windows are hashed at positions whose number modulo
  a period is in a difference cover. For any two windows there is a shift below the period
  that brings both to a cover position, so equal windows share an aligned anchor. Repeated
  anchors are extended left and right to the windows around them; these are sorted by 96 bits of
  two independent hashes, and neighbours compared in the order of (doc_id, start).

Hot passages. Before a shuffle, each batch of documents compares its own rows and sends one of
each kind under the kind's key; the others, whose fate that one decides, travel under keys of
their own. So a passage that a third of all documents have puts one row a batch into its
partition. Kinds by hash are compared in a stream, never gathered. Suffixes of equal first words
are held together up to `run_rows`; a longer run's windows go the way of substring_dedup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlex.llm.ids import free_name, numbered_ids, plain_ids, whole_numbers
from quernlex.llm.words import NOT_SPACE, Words, column_bytes, mix, slices
from quernlex.session import ship, written

#: A perfect difference cover modulo 13: every residue is a difference of two of these.
PERIOD, COVER = 13, (0, 1, 3, 9)
SUBSTRING_WORDS = 20
SUFFIX_WORDS = 50
SUFFIX_PREFIX = 16
#: Suffixes of equal first words that one task compares in memory.
RUN_ROWS = 50_000
#: Suffixes whose runs are complete that are worked on at once.
_BATCH_ROWS = 16_000
#: Bytes of text that are searched for anchors at once.
_SLICE = 2 << 20

_NULL_ID = -(1 << 63)
_U = np.uint64

Anchors = Callable[[Words], tuple[np.ndarray, np.ndarray]]


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The place of the leftmost least of each `size` consecutive entries (doubling, so log2(size) passes)."""
    least, at, have = x, np.arange(len(x)), 1
    while have < size:
        step = min(have, size - have)
        right = least[step:] < least[: len(least) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        least = np.where(right, least[step:], least[: len(least) - step])
        have += step
    return at


def cover_anchors(length: int, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> tuple[Anchors, int]:
    """Anchors at cover positions; the words hashed from each on are what any window still holds."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("not a difference cover")
    size = length - period + 1
    if size < 1:
        raise ValueError("the window is shorter than the period")
    inside = np.isin(np.arange(period), cover)

    def anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
        number = np.arange(len(w.start)) - np.repeat(w.first[:-1], w.counts)
        at = np.flatnonzero(inside[number % period] & w.fits(size))
        return at, w.windows(size, at=at)

    return anchors, size


def minimisers(w: Words, length: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the minimiser of each, and the hashes of prefixes from every word."""
    h = w.windows(prefix)
    if len(w.start) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h
    at = sliding_least(h[: len(h) - prefix + 1], length - prefix + 1)
    starts = np.flatnonzero(w.fits(length)[: len(at)])
    return starts, at[starts], h


def minimiser_anchors(length: int, prefix: int = SUFFIX_PREFIX) -> Anchors:
    """Anchors at the minimiser of each window."""
    if not 0 < prefix <= length:
        raise ValueError("the prefix is longer than the window")

    def anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
        _, at, h = minimisers(w, length, prefix)
        at = at[np.flatnonzero(np.diff(at, prepend=-1))]
        return at, h[at]

    return anchors


def _runs(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys, True where an entry equals the one before it."""
    same = np.ones(len(keys[0]), bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[1:] == k[:-1]
    return same


def _own(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of their own for rows that needn't meet their kind."""
    return mix(key ^ (at.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))


def _numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _bytes_of(values: np.ndarray) -> bytes:
    return np.asarray(values, np.int32).tobytes()


def positions(w: Words, lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Packed word numbers of each text as numbers in the table, and the text of each."""
    sizes = np.fromiter((sum(map(len, x)) // 4 if x else 0 for x in lists), np.int64, len(lists))
    of = np.repeat(np.arange(len(lists)), sizes)
    flat = np.frombuffer(b"".join(p for x in lists if x for p in x), np.int32)
    return flat + w.first[of], of


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor().compress
    for batch in batches:
        packed = pa.array([press(t) for t in column_bytes(batch.column(3))], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], ["doc_id", "d", "v", "packed"])


class Corpus:
    """The rows of docs as doc_id, d, v, text, and the same by document with packed texts.

    d is the id as a number in its order, null the smallest. v tells texts of one id apart.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        ship(docs.sparkSession)
        self.id_kind = docs.schema[id_col].dataType.simpleString()
        number = id_col
        only = docs.select(F.col(id_col), F.col(text_col)) if id_col != text_col else docs.select(F.col(id_col))
        if not whole_numbers(docs, id_col):
            number = free_name(only, "_number")
            only = numbered_ids(only, id_col, number)
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        version = F.lit(0).cast("long") if plain_ids(docs, id_col) else F.xxhash64(text)
        d = F.coalesce(F.col(number).cast("long"), F.lit(_NULL_ID))
        self.rows = only.select(F.col(id_col).alias("doc_id"), d.alias("d"), version.alias("v"), text.alias("text"))

    def by_document(self) -> DataFrame:
        packed = self.rows.mapInArrow(_pack, f"doc_id {self.id_kind}, d long, v long, packed binary")
        return packed.repartition("d", "v")


def _texts(batch: pa.RecordBatch, wanted: list) -> list[bytes]:
    """The packed texts of those rows for which there is anything to do."""
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t) if a else b"" for t, a in zip(batch.column(3).to_pylist(), wanted, strict=True)]


def repeated_anchors(corpus: Corpus, anchors: Anchors) -> DataFrame:
    """d, v, ats: lists of the word numbers of anchors whose key another has."""

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_bytes(batch.column(2))
            d, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi in slices(texts, _SLICE):
                w = Words(texts[lo:hi], NOT_SPACE)
                at, key = anchors(w)
                if not len(at):
                    continue
                of = np.searchsorted(w.first, at, side="right") - 1
                order = np.argsort(key, kind="stable")
                key, at, of = key[order], at[order], of[order]
                again = _runs(key)
                several = again.copy()
                several[:-1] |= again[1:]
                # of each kind one is sent under its key, the others already known to repeat
                key = np.where(again, _own(key, at + lo), key)
                order = np.argsort(at)  # in the order of the texts: neighbours compress well
                key, at, of, several = key[order], at[order], of[order], several[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (key.view(np.int64), d[lo + of], v[lo + of], (at - w.first[of]).astype(np.int32), several)],
                    ["key", "d", "v", "pos", "known"],
                )

    sent = corpus.rows.select("d", "v", "text").mapInArrow(anchor_rows, "key long, d long, v long, pos int, known boolean")

    def equal_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, whose next neighbour is still to come

        def out(d, v, pos, keep):
            order = np.flatnonzero(keep)
            order = order[np.lexsort((pos[order], v[order], d[order]))]
            d, v, pos = d[order], v[order], pos[order]
            cut = np.flatnonzero(~_runs(d, v))
            lists = [_bytes_of(x) for x in np.split(pos, cut[1:])] if len(cut) else []
            return pa.RecordBatch.from_arrays([pa.array(d[cut]), pa.array(v[cut]), pa.array(lists, pa.binary())], ["d", "v", "at"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = _numbers(batch)
            if held is not None:
                now = [np.concatenate((a, b)) for a, b in zip(held, now, strict=True)]
            again = _runs(now[0])
            keep = now[4].astype(bool) | again
            keep[:-1] |= again[1:]
            held = [x[-1:] for x in now[:4]] + [keep[-1:]]
            if len(keep) > 1:
                yield out(now[1][:-1], now[2][:-1], now[3][:-1], keep[:-1])
        if held is not None:
            yield out(held[1], held[2], held[3], held[4])

    found = sent.repartition("key").sortWithinPartitions("key").mapInArrow(equal_neighbours, "d long, v long, at binary")
    # written down, so that the anchors' exchange isn't on disk beside the next one
    return written(found.groupBy("d", "v").agg(F.collect_list("at").alias("ats")))


#: Rows of windows: two hashes, place, and what is known: one starts earlier, one starts elsewhere.
_WINDOWS = "a long, b int, d long, v long, pos int, later boolean, others boolean"


def window_rows(corpus: Corpus, places: DataFrame, length: int, anchor_size: int) -> DataFrame:
    """The windows that hold an anchor that repeats."""

    def windows_of(w: Words, ats: list) -> np.ndarray:
        """The starts of windows that hold one of the anchors given for each text."""
        pos, of = positions(w, ats)
        n = len(w.start) + 1
        lo, hi = np.maximum(pos + anchor_size - length, w.first[of]), np.minimum(pos + 1, w.first[of + 1])
        reach = np.cumsum(np.bincount(lo, minlength=n) - np.bincount(hi, minlength=n))
        return np.flatnonzero((reach[:-1] > 0) & w.fits(length))

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            ats = batch.column(4).to_pylist()
            texts = _texts(batch, ats)
            for lo, hi in slices(texts, _SLICE):
                if not any(ats[lo:hi]):
                    continue
                w = Words(texts[lo:hi], NOT_SPACE)
                at = windows_of(w, ats[lo:hi])
                if not len(at):
                    continue
                of = np.searchsorted(w.first, at, side="right") - 1
                a, b = w.windows(length, 0, at), w.windows(length, 1, at).astype(np.uint32)
                dd, vv, pos = d[lo + of], v[lo + of], (at - w.first[of]).astype(np.int32)
                order = np.lexsort((pos, dd, b, a))
                a, b, dd, vv, pos = a[order], b[order], dd[order], vv[order], pos[order]
                again = _runs(a, b)
                starts = np.flatnonzero(~again)
                first = starts[np.cumsum(~again) - 1]
                later = (dd != dd[first]) | (pos != pos[first])
                # repeated rows have equal places: they meet their kind like its first
                others = np.bincount(np.cumsum(~again) - 1, later.astype(np.float64))[np.cumsum(~again) - 1] > 0
                a = np.where(later, _own(a, at[order] + lo), a)
                order = np.argsort(order)  # in the order of the texts: neighbours compress well
                a, b, dd, vv, pos, later, others = (x[order] for x in (a, b, dd, vv, pos, later, others))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (a.view(np.int64), b.view(np.int32), dd, vv, pos, later, others)],
                    ["a", "b", "d", "v", "pos", "later", "others"],
                )

    joined = corpus.by_document().join(places.hint("shuffle_hash"), ["d", "v"], "left")
    return joined.select("doc_id", "d", "v", "packed", "ats").mapInArrow(window_rows, _WINDOWS)


def window_verdicts(windows: DataFrame, elsewhere: bool) -> DataFrame:
    """d, v, later, first: starts of windows that aren't the first of their kind and, with elsewhere,
    of those that are the first of several."""

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """later: an equal window starts earlier. Else, in a second list: one starts later."""
        held = first = None

        def out(d, v, pos, later, others):
            use = np.flatnonzero(later | (others & elsewhere))
            order = use[np.lexsort((pos[use], v[use], d[use]))]
            d, v, pos, later = d[order], v[order], pos[order], later[order]
            cut = np.flatnonzero(~_runs(d, v))
            parts = [np.split(x, cut[1:]) for x in (pos, later)] if len(cut) else [[], []]
            lists = [[_bytes_of(p[f]) for p, f in zip(*parts, strict=True)], [_bytes_of(p[~f]) for p, f in zip(*parts, strict=True)]]
            return pa.RecordBatch.from_arrays([pa.array(d[cut]), pa.array(v[cut]), *(pa.array(x, pa.binary()) for x in lists)], ["d", "v", "later", "first"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [x.astype(bool) if i > 4 else x for i, x in enumerate(_numbers(batch))]
            if held is not None:
                now = [np.concatenate((a, b)) for a, b in zip(held, now, strict=True)]
            a, b, d, v, pos, later, others = now
            again = _runs(a, b)
            group = np.cumsum(~again) - 1
            heads = np.flatnonzero(~again)
            least_d, least_pos = d[heads], pos[heads]
            if first is not None and len(heads):
                least_d[0], least_pos[0] = first  # the kind that the last batch ended in
            after = (d != least_d[group]) | (pos != least_pos[group])
            later = later | (again & after)
            if first is not None:
                later[0] = now[5][0]
            others = others | later
            others[:-1] |= again[1:] & after[1:]
            # equal places of repeated rows stand together at the head of a kind
            tied = np.flatnonzero(again & ~after)
            for i in tied[::-1].tolist():
                others[i - 1] |= others[i]
            first = (least_d[-1], least_pos[-1])
            held = [x[-1:] for x in (a, b, d, v, pos, later, others)]
            if len(a) > 1:
                yield out(d[:-1], v[:-1], pos[:-1], later[:-1], others[:-1])
        if held is not None:
            yield out(*held[2:])

    by_kind = windows.repartition("a", "b").sortWithinPartitions("a", "b", "d", "pos")
    return by_kind.mapInArrow(verdicts, "d long, v long, later binary, first binary")


def common_words(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For byte strings of words, each followed by a blank: how many words each has in common with the one before it (0 for the first)."""
    out = np.zeros(len(start), np.int64)
    if len(start) < 2:
        return out
    m = np.minimum(size[1:], size[:-1])
    cut = np.concatenate(([0], np.cumsum(m)))
    of = np.repeat(np.arange(len(m)), m)
    rel = np.arange(cut[-1]) - cut[of]
    differ = np.flatnonzero(data[start[:-1][of] + rel] != data[start[1:][of] + rel])
    same = m.copy()
    rows, first = np.unique(of[differ], return_index=True)
    same[rows] = rel[differ[first]]
    blanks = np.concatenate(([0], np.cumsum(data == 0x20)))
    out[1:] = blanks[start[1:] + same] - blanks[start[1:]]
    return out


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A binary column's bytes, and where each value starts and how long it is."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(1, np.uint8)
    return data, offsets[:-1], np.diff(offsets)


_SUFFIXES = "key long, suffix binary, before binary, d long, v long, pos int, least int, most int, later boolean, others boolean"


def suffix_rows(corpus: Corpus, places: DataFrame, length: int, prefix: int) -> DataFrame:
    """The retained suffixes: their words as far as a window reaches, and those before, backwards.

    A suffix stands for the windows whose minimiser it starts at; they start least to most words
    before it. Of equal ones in a batch the first is sent; of the others all is known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            ats = batch.column(4).to_pylist()
            texts = _texts(batch, ats)
            for lo, hi in slices(texts, _SLICE):
                if not any(ats[lo:hi]):
                    continue
                w = Words(texts[lo:hi], NOT_SPACE)
                starts, anchor, h = minimisers(w, length, prefix)
                chosen = np.zeros(len(w.start) + 1, bool)
                chosen[positions(w, ats[lo:hi])[0]] = True
                use = chosen[anchor]
                starts, anchor = starts[use], anchor[use]
                if not len(starts):
                    continue
                # the windows of one minimiser follow each other
                head = np.flatnonzero(np.diff(anchor, prepend=-1))
                at = anchor[head]
                most = at - starts[head]
                least = at - starts[np.append(head[1:], len(starts)) - 1]
                of = np.searchsorted(w.first, at, side="right") - 1
                dd, vv, pos = d[lo + of], v[lo + of], (at - w.first[of]).astype(np.int32)
                forward, backward, edge = w.lines()
                end = len(forward)
                order = np.lexsort((pos, vv, dd))
                kinds: dict[tuple, int] = {}
                suffix, before = [b""] * len(at), [b""] * len(at)
                key = h[at].copy()
                later, others = np.zeros(len(at), bool), np.zeros(len(at), bool)
                right, left = edge[at + length - least], edge[at - most]
                for i, a, r, b in zip(order.tolist(), edge[at[order]].tolist(), right[order].tolist(), left[order].tolist(), strict=True):
                    x, y = forward[a:r], backward[end - a : end - b]
                    first = kinds.setdefault((x, y), i)
                    if first != i and (dd[first] != dd[i] or pos[first] != pos[i]):
                        later[i] = others[first] = True
                    else:
                        suffix[i], before[i] = x, y
                key = np.where(later, _own(key, at + lo), key)
                columns = (dd, vv, pos, least.astype(np.int32), most.astype(np.int32), later, others)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(suffix, pa.binary()), pa.array(before, pa.binary()), *map(pa.array, columns)],
                    ["key", "suffix", "before", "d", "v", "pos", "least", "most", "later", "others"],
                )

    joined = corpus.by_document().join(places.hint("shuffle_hash"), ["d", "v"], "left")
    return joined.select("doc_id", "d", "v", "packed", "ats").mapInArrow(run, _SUFFIXES)


def equal_windows(rows: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in order, whole runs of them: which of their windows (by how far they start before) start later than an equal one, and which are the first of several."""
    n = rows.num_rows
    key, d, v, pos, least, most = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4, 5, 6, 7))
    known, others = (rows.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (8, 9))
    reach = np.arange(int(most.max()) + 1)
    own = (least[:, None] <= reach) & (reach <= most[:, None])
    later, first = own & known[:, None], own & others[:, None]
    forward = common_words(*_binary(rows.column(1)))
    forward[1:][key[1:] != key[:-1]] = 0
    texts = rows.column(2).to_pylist()
    order = np.array(sorted(range(n), key=texts.__getitem__), np.int64)
    data, start, size = _binary(rows.column(2))
    backward = common_words(data, start[order], size[order])
    side = np.zeros(n, np.int64)
    places = np.lexsort((pos, d))  # stable sorts by kind keep this order within each
    for o in reach.tolist():
        use = places[own[places, o] & ~known[places]]
        if len(use) < 2:
            continue
        side[order] = np.cumsum(backward < o)
        kind = np.cumsum(forward < length - o)[use] * (n + 1) + side[use]
        by = np.argsort(kind, kind="stable")
        use, kind = use[by], kind[by]
        new = ~_runs(kind)
        head = use[np.flatnonzero(new)[np.cumsum(new) - 1]]
        after = (d[use] != d[head]) | (pos[use] != pos[head])
        later[use[after], o] = True
        several = np.bincount(np.cumsum(new) - 1, after) > 0
        first[use, o] |= several[np.cumsum(new) - 1] & ~after
    return later, first & ~later


def _ranges(mask: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True in each row: the row, the first and the last start of the windows."""
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return row, pos[row] - (b - 1), pos[row] - a


def suffix_verdicts(suffixes: DataFrame, length: int, elsewhere: bool, run_rows: int) -> DataFrame:
    """d, v, later, first as in window_verdicts, but ranges (first start, last start) for starts.

    Rows with `a` are windows of runs too long to be held; they are still to be judged.
    """
    schema = pa.schema(
        [("d", pa.int64()), ("v", pa.int64()), ("later", pa.binary()), ("first", pa.binary())]
        + [("a", pa.int64()), ("b", pa.int32()), ("pos", pa.int32()), ("known", pa.bool_()), ("others", pa.bool_())]
    )

    def judged(rows: pa.RecordBatch) -> pa.RecordBatch:
        later, first = equal_windows(rows, length)
        d, v, pos = (rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
        sides = [_ranges(later, pos), _ranges(first & elsewhere, pos)]
        row = np.concatenate([x[0] for x in sides])
        lo, hi = (np.concatenate([x[k] for x in sides]).astype(np.int32) for k in (1, 2))
        of_first = np.repeat([False, True], [len(x[0]) for x in sides])
        order = np.lexsort((lo, of_first, v[row], d[row]))
        row, pairs, of_first = row[order], np.stack((lo, hi), axis=1)[order], of_first[order]
        cut = np.flatnonzero(~_runs(d[row], v[row]))
        lists: list[list[bytes]] = [[], []]
        for part, side in zip(np.split(pairs, cut[1:]), np.split(of_first, cut[1:]), strict=True) if len(cut) else ():
            lists[0].append(_bytes_of(part[~side]))
            lists[1].append(_bytes_of(part[side]))
        out = [pa.array(d[row][cut]), pa.array(v[row][cut]), *(pa.array(x, pa.binary()) for x in lists)]
        return pa.RecordBatch.from_arrays(out + [pa.nulls(len(cut), f.type) for f in schema][4:], schema=schema)

    def windows(rows: pa.RecordBatch) -> pa.RecordBatch:
        """The windows of some suffixes, by hashes of their words."""
        found: list[tuple] = []
        for r in rows.to_pylist():
            right, left = r["suffix"].split(b" "), r["before"].split(b" ")
            for o in range(r["least"], r["most"] + 1):
                words = b" ".join([*left[:o][::-1], *right[: length - o]])
                x = hashlib.blake2b(words, digest_size=12).digest()
                a, b = (int.from_bytes(y, "little", signed=True) for y in (x[:8], x[8:]))
                found.append((r["d"], r["v"], None, None, a, b, r["pos"] - o, r["later"], r["others"]))
        columns = zip(*found, strict=True) if found else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, spilled = 0, None  # spilled: the key of a run too long to be held
        for batch in batches:
            if not batch.num_rows:
                continue
            if spilled is not None:
                key = batch.column(0).to_numpy(zero_copy_only=False)
                n = int(np.argmax(key != spilled)) if (key != spilled).any() else len(key)
                if n:
                    yield windows(batch.slice(0, n))
                batch = batch.slice(n)
                if not batch.num_rows:
                    continue
                spilled = None
            held.append(batch)
            size += batch.num_rows
            if size < min(_BATCH_ROWS, run_rows):
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = rows.column(0).to_numpy(zero_copy_only=False)
            whole = int(np.searchsorted(np.cumsum(~_runs(key)), np.sum(~_runs(key))))  # where the last run begins
            if whole:
                yield judged(rows.slice(0, whole))
            held, size = [rows.slice(whole)], len(key) - whole
            if size > run_rows:
                yield windows(held[0])
                held, size, spilled = [], 0, key[-1]
        if held:
            yield judged(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    ordered = suffixes.repartition("key").sortWithinPartitions("key", "suffix")
    listed = "d long, v long, later binary, first binary, a long, b int, pos int, known boolean, others boolean"
    found = written(ordered.mapInArrow(run, listed))
    done = found.where("a is null").select("d", "v", "later", "first")
    rest = found.where("a is not null")
    if not rest.limit(1).count():
        return done
    rest = rest.select("a", "b", "d", "v", "pos", F.col("known").alias("later"), "others")
    return done.union(window_verdicts(rest, elsewhere).select("d", "v", _doubled("later"), _doubled("first")))


def _doubled(name: str):
    """Starts as ranges of one start each."""
    at = F.transform(F.sequence(F.lit(0), F.octet_length(name) / 4 - 1), lambda i: F.substring(F.col(name), (4 * i + 1).cast("int"), F.lit(4)))
    twice = F.aggregate(at, F.lit(b""), lambda all_, x: F.concat(all_, x, x))
    return F.when(F.octet_length(name) > 0, twice).otherwise(F.lit(b"")).alias(name)


def without_repeats(corpus: Corpus, verdict: DataFrame, length: int, elsewhere: bool, ranges: bool) -> DataFrame:
    """What is left of each text. One row per row of docs: doc_id, n_words, n_removed, kept_sha256, removed and, with
    elsewhere, n_repeated and repeated; the last two are arrays of struct<start, end> of words."""
    verdict = verdict.groupBy("d", "v").agg(F.collect_list("later").alias("later"), F.collect_list("first").alias("first"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def spans(mask: np.ndarray, w: Words) -> pa.Array:
        """Runs of True for each text, as word numbers in it."""
        n = len(mask)
        border = np.zeros(n + 1, bool)
        border[w.first] = True
        before, after = np.concatenate(([False], mask[:-1])), np.concatenate((mask[1:], [False]))
        start = np.flatnonzero(mask & (~before | border[:-1]))
        end = np.flatnonzero(mask & (~after | border[1:])) + 1
        of = np.searchsorted(w.first, start, side="right") - 1
        base = w.first[of]
        cut = np.searchsorted(of, np.arange(w.n + 1)).astype(np.int32)
        flat = pa.StructArray.from_arrays([pa.array((start - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(cut), flat)

    def covered(w: Words, lists: list) -> np.ndarray:
        pos, _ = positions(w, lists)
        lo, hi = (pos[0::2], pos[1::2]) if ranges else (pos, pos)
        n = len(w.start) + length + 1
        return np.cumsum(np.bincount(lo, minlength=n) - np.bincount(hi + length, minlength=n))[: len(w.start)] > 0

    def joined_lists(parts: list) -> pa.Array:
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [unpack(t) for t in batch.column(3).to_pylist()]
            later, first = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            n_words, n_removed, shas, removed, n_repeated, repeated = [], [], [], [], [], []
            for lo, hi in slices(texts):
                w = Words(texts[lo:hi], NOT_SPACE)
                gone = covered(w, later[lo:hi])
                total = np.concatenate(([0], np.cumsum(gone)))
                n_words += w.counts.tolist()
                n_removed += (total[w.first[1:]] - total[w.first[:-1]]).tolist()
                shas += [hashlib.sha256(x).hexdigest() for x in w.joined(~gone)]
                removed.append(spans(gone, w))
                if elsewhere:
                    twice = gone | covered(w, first[lo:hi])
                    total = np.concatenate(([0], np.cumsum(twice)))
                    n_repeated += (total[w.first[1:]] - total[w.first[:-1]]).tolist()
                    repeated.append(spans(twice, w))
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string()), joined_lists(removed)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"]
            if elsewhere:
                arrays += [pa.array(n_repeated, pa.int64()), joined_lists(repeated)]
                names += ["n_repeated", "repeated"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    listed = "array<struct<start: int, end: int>>"
    result = f"doc_id {corpus.id_kind}, n_words long, n_removed long, kept_sha256 string, removed {listed}" + f", n_repeated long, repeated {listed}" * elsewhere
    last = corpus.by_document().join(verdict.hint("shuffle_hash"), ["d", "v"], "left")
    return last.select("doc_id", "d", "v", "packed", "later", "first").mapInArrow(final, result)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SUBSTRING_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256 and the removed spans of words.

    A word goes if a window of `length` words over it has an equal that starts earlier; windows
    are judged on the input. Found from difference-cover anchors; words are compared by 96 bits
    of two independent hashes.

    Ids may be of any type with an order; a null id counts as the smallest. Rows with one id and
    one text are one document; rows with one id and different texts are two, neither of which is
    earlier at an equal start. Null and empty texts have no words; texts may be of any length.
    Empty tables give no rows. Other columns of docs are not read, so their names may be any.
    """
    anchors, size = cover_anchors(length)
    corpus = Corpus(docs, id_col, text_col)
    windows = window_rows(corpus, repeated_anchors(corpus, anchors), length, size)
    return without_repeats(corpus, window_verdicts(windows, elsewhere=False), length, elsewhere=False, ranges=False)


def suffix_array_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SUFFIX_WORDS, prefix: int = SUFFIX_PREFIX, run_rows: int = RUN_ROWS
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_repeated, n_removed, kept_sha256, repeated, removed.

    repeated: the spans of words under windows of `length` words that also start elsewhere, in
    this text or another; removed: those that start earlier elsewhere, so one copy of each
    passage stays. Found from a sparse suffix array and confirmed on the words themselves (in
    runs of more than run_rows suffixes with equal first words, by 96 bits of a hash). Odd rows
    as in substring_dedup.
    """
    anchors = minimiser_anchors(length, prefix)
    corpus = Corpus(docs, id_col, text_col)
    suffixes = suffix_rows(corpus, repeated_anchors(corpus, anchors), length, prefix)
    verdict = suffix_verdicts(suffixes, length, True, run_rows)
    out = without_repeats(corpus, verdict, length, elsewhere=True, ranges=True)
    return out.select("doc_id", "n_words", "n_repeated", "n_removed", "kept_sha256", "repeated", "removed")
