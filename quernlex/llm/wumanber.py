"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark's items, texts are documents, symbols are words. For
the patterns of one length m, blocks of two words (one, where m is 1) key a shift table: a
block that no pattern has lets the search skip m - 1 words, one that ends d words before the
end of a pattern lets it skip d. Only at shift 0 does the suffix's bucket, in which patterns are
in the order of their hashes, name the patterns to test, and a direct comparison of their bytes
confirms each occurrence. A text is searched in lanes of consecutive window ends, all lanes a
step at a time.

The tables are numpy arrays, built once on the driver and shared with the executors. A benchmark
of more than PART_BYTES is searched for in parts, one pass over the documents for each; what was
found so far is written down with them, so neither driver nor executors hold more than a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlex.llm.words import ALNUM, Words, column_bytes, mix, slices
from quernlex.session import ship, written

WINDOW = 8
LEAST_ITEMS = 2
#: Most bytes of benchmark text whose patterns are held at once; tables take about six times that.
PART_BYTES = 16 << 20
_LANE = 64
_U = np.uint64


class _Length(NamedTuple):
    """Patterns of one length: shift table, and patterns in the order of suffix bucket and hash."""

    words: int
    block: int
    bits: int
    shift: np.ndarray
    keys: np.ndarray  # suffix bucket in the high bits, hash of the pattern below
    at: np.ndarray  # where in the items' words each pattern stands
    cut: np.ndarray  # which of the owners are whose
    owners: np.ndarray  # numbers of items


def _block(h: np.ndarray, ends: np.ndarray, size: int, bits: int) -> np.ndarray:
    """A number of `bits` bits for the block of words that ends at each of `ends`."""
    x = h[ends] if size == 1 else mix(h[ends - 1] * _U(0x9E3779B97F4A7C15) + h[ends])
    return x >> _U(64 - bits)


def _key(block: np.ndarray, pattern: np.ndarray, bits: int) -> np.ndarray:
    return block << _U(64 - bits) | pattern >> _U(bits)


def _same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray, m: int) -> np.ndarray:
    """Whether m words of a from each i on are, byte for byte, those of b from each j on."""
    x = (i[:, None] + np.arange(m)).ravel()
    y = (j[:, None] + np.arange(m)).ravel()
    size = a.end[x] - a.start[x]
    alike = size == b.end[y] - b.start[y]
    some = np.flatnonzero(alike)
    n = size[some]
    rel = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    equal = a.buf[np.repeat(a.start[x[some]], n) + rel] == b.buf[np.repeat(b.start[y[some]], n) + rel]
    alike[np.repeat(some, n)[~equal]] = False
    return alike.reshape(-1, m).all(axis=1)


class Patterns:
    """The distinct windows of some items, by length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.ids, self.window = sorted({i for i, _ in items}), window
        number = {x: k for k, x in enumerate(self.ids)}
        item = np.array([number[i] for i, _ in items], np.int64)
        w = Words([t for _, t in items], ALNUM, lower=True)
        h, doc = w.hashes(), w.doc()
        length = np.minimum(window, w.counts)[doc]
        self.sets: list[_Length] = []
        for m in np.unique(length).tolist():
            size = min(2, m)
            at = np.flatnonzero((length == m) & w.fits(m))
            one, two = w.windows(m, 0, at), w.windows(m, 1, at)
            order = np.lexsort((at, two, one))
            at, one, two = at[order], one[order], two[order]
            new = np.ones(len(at), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            own = np.unique((np.cumsum(new) - 1) * len(self.ids) + item[doc[at]])
            at, one = at[new], one[new]
            bits = int(np.clip(np.ceil(np.log2(len(at) + 1)) + 3, 12, 22))
            shift = np.full(1 << bits, min(m - size + 1, 255), np.uint8)
            for j in range(size - 1, m):  # a block's end in the pattern, from its first word
                np.minimum.at(shift, _block(h, at + j, size, bits).astype(np.int64), min(m - 1 - j, 255))
            keys = _key(_block(h, at + m - 1, size, bits), one, bits)
            order = np.argsort(keys, kind="stable")
            cut = np.searchsorted(own // max(len(self.ids), 1), np.arange(len(at) + 1))
            held = np.diff(cut)[order]
            place = np.concatenate(([0], np.cumsum(held)))
            owners = own[np.repeat(cut[:-1][order] - place[:-1], held) + np.arange(place[-1])] % max(len(self.ids), 1)
            self.sets.append(_Length(m, size, bits, shift, keys[order], at[order].astype(np.int32), place.astype(np.int32), owners.astype(np.int32)))
        # only what comparing needs stays
        w.start, w.end = w.start.astype(np.int32), w.end.astype(np.int32)
        w._hashes = {}
        self.words = w

    def search(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words of w are in an occurrence; pairs of text and number of an item; those by a window of full length."""
        h = w.hashes()
        hit = np.zeros(len(w.start) + 1, np.int64)
        pairs, full = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in self.sets:
            m = s.words
            # lanes: ranges of window ends, each in one text
            first_end, stop = w.first[:-1] + m - 1, w.first[1:]
            lanes = np.maximum(0, -(-(stop - first_end) // _LANE))
            of = np.repeat(np.arange(w.n), lanes)
            turn = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            at = first_end[of] + turn * _LANE
            last = np.minimum(at + _LANE, stop[of])
            ends, texts, buckets = [], [], []
            while len(at):
                block = _block(h, at, s.block, s.bits)
                step = s.shift[block.astype(np.int64)].astype(np.int64)
                zero = step == 0
                ends.append(at[zero])
                texts.append(of[zero])
                buckets.append(block[zero])
                at = at + np.maximum(step, 1)
                alive = at < last
                at, last, of = at[alive], last[alive], of[alive]
            if not ends:
                continue
            end, text, block = (np.concatenate(x) for x in (ends, texts, buckets))
            start = end - m + 1
            key = _key(block, w.windows(m, 0, start), s.bits)
            place = np.searchsorted(s.keys, key)
            while len(place):  # all patterns of the bucket that have this hash
                there = place < len(s.keys)
                there[there] = s.keys[place[there]] == key[there]
                place, key, start, text = place[there], key[there], start[there], text[there]
                same = _same_words(w, start, self.words, s.at[place].astype(np.int64), m)
                np.add.at(hit, start[same], 1)
                np.add.at(hit, start[same] + m, -1)
                n = s.cut[place[same] + 1] - s.cut[place[same]]
                rel = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                owner = s.owners[np.repeat(s.cut[place[same]], n) + rel]
                pairs.append(np.unique(np.repeat(text[same], n) * len(self.ids) + owner))
                if m == self.window:
                    full.append(pairs[-1])
                place = place + 1
        return np.cumsum(hit[:-1]) > 0, np.unique(np.concatenate(pairs)), np.unique(np.concatenate(full))


def _owned(pairs: np.ndarray, ids: list[str], n: int) -> list[set[str]]:
    out: list[set[str]] = [set() for _ in range(n)]
    for p in pairs.tolist():
        out[p // len(ids)].add(ids[p % len(ids)])
    return out


#: What was found so far: the words hit as bits, and the items, all and by windows of full length.
_SO_FAR = [("hits", "binary", pa.binary()), ("items", "array<string>", pa.list_(pa.string())), ("full", "array<string>", pa.list_(pa.string()))]
_RESULT = [("n_words", "long", pa.int64()), ("n_hit", "long", pa.int64()), ("n_items", "long", pa.int64()), ("items_sha256", "string", pa.string()), ("n_full", "long", pa.int64())]


def _pass(rows: DataFrame, shared, carried: int, more: bool) -> DataFrame:
    """One part's search: rows (c0, c1, ..., text and, after the first part, what was found so far) with the results or, with more to come, what was found."""
    later = len(rows.columns) > carried + 1
    added = _SO_FAR if more else _RESULT
    names = [f"c{i}" for i in range(carried)] + ["text"] * more + [a[0] for a in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = shared.value
        for batch in batches:
            texts = column_bytes(batch.column(carried))
            before = [batch.column(carried + 1 + i).to_pylist() for i in range(3)] if later else None
            new: list[list] = [[] for _ in added]
            for lo, hi in slices(texts):
                w = Words(texts[lo:hi], ALNUM, lower=True)
                hit, *found = patterns.search(w)
                items, full = (_owned(x, patterns.ids, w.n) for x in found)
                for k in range(w.n):
                    own = hit[w.first[k] : w.first[k + 1]]
                    if before is not None:
                        own = own | np.unpackbits(np.frombuffer(before[0][lo + k], np.uint8), count=len(own)).astype(bool)
                        items[k].update(before[1][lo + k])
                        full[k].update(before[2][lo + k])
                    if more:
                        row = (np.packbits(own).tobytes(), sorted(items[k]), sorted(full[k]))
                    else:
                        row = (len(own), int(own.sum()), len(items[k]), hashlib.sha256(",".join(sorted(items[k])).encode()).hexdigest(), len(full[k]))
                    for column, value in zip(new, row, strict=True):
                        column.append(value)
            kept = [batch.column(i) for i in range(carried + more)]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(x, a[2]) for x, a in zip(new, added, strict=True)], names)

    kinds = [f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(carried)] + ["text string"] * more + [f"{a[0]} {a[1]}" for a in added]
    return rows.mapInArrow(run, ", ".join(kinds))


def search_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    carry: list[str] | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """docs' columns `carry` as c0, c1, ... and n_words, n_hit, n_items, items_sha256, n_full (items by a window of full length).

    Words are lower-cased (A-Z) runs of ASCII letters, digits and characters from U+0080. A
    window is `window` consecutive words of an item; a shorter item with words is one window; an
    item without words has none. Null and empty texts have no words; texts may be of any length.
    Items with one id, of any type, count once, and repeated items are one; a null id is the empty
    string. Ids and rows of docs may be null or repeated. Empty tables: no rows, or nothing found.
    Other columns of docs are kept as they are where `carry` names them. The benchmark's bytes are
    counted first; beyond `part_bytes` there is a pass for each part.
    """
    spark = ship(docs.sparkSession)
    chosen = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(item_text_col).alias("t")).where("t is not null").distinct()
    size = chosen.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-size // part_bytes))
    carry = carry or []
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{text_col}`").alias("text"))
    for k in range(n):
        part = chosen.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        shared = spark.sparkContext.broadcast(Patterns([(r["i"], r["t"].encode()) for r in part], window))
        rows = _pass(rows, shared, len(carry), k < n - 1)
        if k < n - 1:
            rows = written(rows)
            shared.unpersist()
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", least_items: int = LEAST_ITEMS, **how) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Odd rows as in search_benchmark."""
    out = search_benchmark(docs, benchmark, carry=[id_col], **how).drop("n_full")
    return out.withColumnRenamed("c0", "doc_id").withColumn("contaminated", F.col("n_items") >= least_items)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least_items: int = LEAST_ITEMS, **how) -> DataFrame:
    """The rows of docs, columns as they are, in which windows of fewer than `least_items` items occur.

    An item shorter than a window is too common a thing to go by alone: items with only such
    windows in a text count where LEAST_ITEMS items or more, of any length, are found in it.
    """
    stays = (F.col("n_full") < least_items) & (F.col("n_items") < max(least_items, LEAST_ITEMS))
    out = search_benchmark(docs, benchmark, carry=docs.columns, **how).where(stays)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
