"""Near-duplicate detection by b-bit MinHash, exact at the end.

1. Each text becomes the set of its word shingles: its size, a 128-bit hash of the set, the
   minima of HASHES hash functions grouped into bands, and a packed signature that retains the
   low BITS bits of every minimum. Texts with equal sets are one node from here on.
2. Nodes that share a band are candidates. A star from the least node of each band's bucket
   spans it, so the connected components of the stars hold every candidate pair without any
   pair of a bucket being emitted.
3. Inside a component, candidates that differ too much in size, or whose similarity as
   estimated from the signatures (equal groups of bits counted, corrected for chance equality) is
   far below the threshold, are passed over; all others are confirmed on their full sets, unless
   confirmed links connect them already.
4. A component too large for one task is cut into chunks and linked within chunks. What may be
   missing then are links inside buckets whose nodes confirmed links don't connect: only those
   buckets are gone through, each by itself, and in a bucket the largest connected part never
   against itself.
5. Confirmed links give the final components.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlex.llm.batches import map_texts
from quernlex.llm.components import components, salt, spread_join
from quernlex.llm.ids import free_name, numbered_rows, plain_ids
from quernlex.llm.words import NOT_SPACE, Words, column_bytes, mix, slices
from quernlex.session import checkpoint, written

HASHES, BITS = 192, 4
#: A link at the threshold shares no band with at most this chance.
MISSED = 1e-6
#: Shingles of a component, or of a chunk of a large one, that one task takes.
TASK_SHINGLES = 2_000_000
SHINGLE_WORDS, PERCENT = 5, 80
_U = np.uint64

_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=_U) * _U(0xA0761D6478BD642F))
_XOR = (_SEEDS[:HASHES] >> _U(32)).astype(np.uint32)
_ODD = (_SEEDS[HASHES:] >> _U(32)).astype(np.uint32) | np.uint32(1)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def band_rows(percent: int) -> int:
    """The most minima a band may join so that no more than MISSED of the links are lost."""
    t = percent / 100
    return max((r for r in range(1, HASHES + 1) if (1 - t**r) ** (HASHES // r) <= MISSED), default=1)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, end to end; and where each text's begin.

    A text with fewer words than `size`, but any, has its whole sequence as its one shingle.
    """
    count = np.where(w.counts >= size, w.counts - size + 1, np.minimum(w.counts, 1))
    h = w.windows(size)
    for few in range(1, size):
        at = w.first[:-1][w.counts == few]
        if len(at):
            h[at] = w.windows(few, 0, at)
    begin = np.concatenate(([0], np.cumsum(count)))
    out = h[np.repeat(w.first[:-1] - begin[:-1], count) + np.arange(begin[-1])]
    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        out[lo:hi].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][count > 0]] = True
    total = np.concatenate(([0], np.cumsum(new)))
    return out[new], total[begin]


def signatures(sets: np.ndarray, begin: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits of the minima, for texts that have shingles."""
    x = (sets >> _U(32)).astype(np.uint32)
    at = begin[:-1]
    n, bands = len(at), HASHES // rows
    low = np.empty((n, HASHES), np.uint8)
    keys = np.empty((n, bands), _U)
    part = np.zeros(n, _U)
    for k in range(HASHES):
        least = np.minimum.reduceat((x ^ _XOR[k]) * _ODD[k], at)
        low[:, k] = least & ((1 << BITS) - 1)
        if k < bands * rows:
            part = mix(part * _U(0x9E3779B97F4A7C15) + least + _U(1))
            if k % rows == rows - 1:
                keys[:, k // rows] = mix(part + _U(k))
                part = np.zeros(n, _U)
    packed = low[:, 0::2] << 4 | low[:, 1::2] if BITS == 4 else low
    return keys, packed


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of a packed signature with others, corrected for equality by chance."""
    differ = one ^ many
    differ |= differ >> 2
    differ |= differ >> 1  # the low bit of each half says whether its four bits differ
    unequal = _ONES[differ & 0x11].sum(axis=1)
    by_chance = 1 / (1 << BITS)
    return ((HASHES - unequal) / HASHES - by_chance) / (1 - by_chance)


class Task:
    """Nodes of one or more components: confirmed links of those that share a band."""

    def __init__(self, ids, sizes, sigs, keys, sets, labels, sides, percent: int) -> None:
        self.ids, self.sizes, self.sigs, self.keys, self.sides = ids, sizes, sigs, keys, sides
        self.percent, n = percent, len(ids)
        t = percent / 100
        p = t + (1 - t) / (1 << BITS)
        self.least = t - 6 * sqrt(p * (1 - p) / HASHES) / (1 - 1 / (1 << BITS))
        self.begin = np.concatenate(([0], np.cumsum(sizes)))
        distinct, self.tokens, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.mark = np.zeros(len(distinct), bool)
        # What a node shares with any other is at most what isn't its alone.
        shared = np.add.reduceat((counts > 1)[self.tokens].astype(np.int64), self.begin[:-1])
        self.live = 100 * shared >= percent * sizes
        _, self.root = np.unique(labels, return_inverse=True)
        self.members: dict[int, list[int]] = {}
        for i, r in enumerate(self.root.tolist()):
            self.members.setdefault(r, []).append(i)
        self.links: list[tuple[int, int]] = []
        self.n = n

    def join(self, i: int, j: int) -> None:
        a, b = int(self.root[i]), int(self.root[j])
        if a == b:
            return
        self.links.append((i, j))
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.root[moved] = a
        self.members[a] += moved

    def confirm(self, i: int, others: np.ndarray) -> None:
        """Link i with all of the others that are similar enough by their full sets."""
        big, small = np.maximum(self.sizes[i], self.sizes[others]), np.minimum(self.sizes[i], self.sizes[others])
        others = others[100 * small >= self.percent * big]
        if len(others):
            others = others[estimate(self.sigs[i], self.sigs[others]) >= self.least]
        for lo in range(0, len(others), 512):
            some = others[lo : lo + 512]
            some = some[self.root[some] != self.root[i]]
            if not len(some):
                continue
            own = self.tokens[self.begin[i] : self.begin[i + 1]]
            self.mark[own] = True
            n = self.sizes[some]
            at = np.concatenate(([0], np.cumsum(n)))
            flat = self.tokens[np.repeat(self.begin[some] - at[:-1], n) + np.arange(at[-1])]
            both = np.add.reduceat(self.mark[flat].astype(np.int64), at[:-1])
            self.mark[own] = False
            for j in some[100 * both >= self.percent * (self.sizes[i] + n - both)].tolist():
                self.join(i, j)

    def run(self) -> list[tuple[int, int]]:
        live = np.flatnonzero(self.live)
        earlier: list[list[np.ndarray]] = [[] for _ in range(self.n)]
        leaders: list[set[int]] = [set() for _ in range(self.n)]
        for b in range(self.keys.shape[1]):
            order = live[np.argsort(self.keys[live, b], kind="stable")]
            k = self.keys[order, b]
            cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else []
            for group in np.split(order, cut[1:]) if len(k) else ():
                if len(group) > 1:
                    for place, i in enumerate(group.tolist()):
                        if place:
                            earlier[i].append(group[:place])
                            leaders[i].add(int(group[0]))
        for i in live.tolist():  # first with the head of each bucket: most links that there are
            for j in leaders[i]:
                if self.root[i] != self.root[j] and (self.sides is None or self.sides[i] != self.sides[j]):
                    self.confirm(i, np.array([j]))
        for i in live.tolist():  # then with whatever is still in another component
            rest = [g[self.root[g] != self.root[i]] for g in earlier[i]]
            others = np.unique(np.concatenate(rest)) if rest else np.zeros(0, np.int64)
            if self.sides is not None:
                others = others[self.sides[others] != self.sides[i]]
            if len(others):
                self.confirm(i, others)
        return self.links


def _link_rows(bands: int, percent: int):
    """Streams rows sorted by task; small tasks are worked on together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def work() -> pa.RecordBatch:
            d, n, sig, keys, sets, label, side, _ = zip(*held, strict=True)
            ids, sides = np.array(d, np.int64), np.array(side)
            task = Task(
                ids,
                np.array(n, np.int64),
                np.frombuffer(b"".join(sig), np.uint8).reshape(len(d), -1),
                np.frombuffer(b"".join(keys), np.int64).reshape(len(d), bands),
                [np.frombuffer(s, _U) for s in sets],
                np.array(label, np.int64),
                None if sides[0] < 0 else sides,
                percent,
            )
            links = task.run()
            u, v = ([int(ids[x[k]]) for x in links] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns, strict=True):
                if held and row[7] != last and (size >= TASK_SHINGLES // 4 or row[6] >= 0 or held[0][6] >= 0):
                    yield work()
                    held, size = [], 0
                held.append(row)
                size, last = size + row[1], row[7]
        if held:
            yield work()

    return run


def _candidates(nodes: DataFrame, bands: int) -> DataFrame:
    """Stars over the buckets of each band: u, v. A hot bucket has a star in each of its salted parts, whose heads have one star."""
    entries = _entries(nodes, bands, ["d"]).withColumn("s", salt("d"))
    parts = entries.withColumn("head", F.min("d").over(Window.partitionBy("b", "key", "s")))
    inner = parts.where("d <> head").select(F.col("d").alias("u"), F.col("head").alias("v"))
    heads = parts.where("d = head").withColumn("top", F.min("d").over(Window.partitionBy("b", "key")))
    return inner.union(heads.where("d <> top").select(F.col("d").alias("u"), F.col("top").alias("v")))


def _entries(nodes: DataFrame, bands: int, carry: list[str]) -> DataFrame:
    """A row for each band of each node: carry, b, key."""
    key = [F.conv(F.hex(F.substring("keys", 1 + 8 * b, 8)), 16, -10).cast("long") for b in range(bands)]
    return nodes.select(*carry, F.posexplode(F.array(*key)).alias("b", "key"))


def _bucket_tasks(sets: DataFrame, bands: int, task_shingles: int) -> DataFrame:
    """d, task, side: what is left to do in buckets that have nodes of different labels.

    sets: d, n, keys, label. A bucket's body are its nodes of the label with the most shingles,
    which needn't be compared with each other; the rest is compared with the body and with itself,
    in chunks of about task_shingles.
    """
    entries = checkpoint(_entries(sets, bands, ["d", "n", "label"]))
    labels = entries.withColumn("s", salt("d")).groupBy("b", "key", "label", "s").agg(F.sum("n").alias("n")).groupBy("b", "key", "label").agg(F.sum("n").alias("n"))
    open_ = labels.groupBy("b", "key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("labels")).where("labels > 1")

    def chunks(size: Column) -> Column:
        return F.greatest(F.ceil(size / task_shingles), F.lit(1)).cast("int")

    open_ = open_.select("b", "key", F.col("top.label").alias("body"), chunks(F.col("top.n")).alias("nb"), chunks(F.col("total") - F.col("top.n")).alias("nr"))
    rows = spread_join(entries, open_, ["b", "key"], ["d"])
    rest = F.col("label") != F.col("body")
    rows = rows.withColumn("c", F.pmod(F.xxhash64("d"), F.when(rest, F.col("nr")).otherwise(F.col("nb"))).cast("int"))

    def task(kind: str, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.concat_ws(":", F.lit(kind), F.col("b"), F.col("key"), i, j).alias("task"), side.cast("int").alias("side"))

    others = F.sequence(F.lit(0), F.col("nr") - 1)
    mixed = F.when(rest, F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: task("body", i, F.col("c"), F.lit(1)))).otherwise(
        F.transform(others, lambda j: task("body", F.col("c"), j, F.lit(0)))
    )
    inner = F.when(rest, F.transform(others, lambda j: task("rest", F.least("c", j), F.greatest("c", j), F.when(F.col("c") == j, -1).otherwise((F.col("c") > j).cast("int")))))
    every = F.concat(mixed, F.coalesce(inner, F.array().cast("array<struct<task: string, side: int>>")))
    return rows.select("d", F.explode(every).alias("t")).select("d", "t.task", "t.side")


def _linked(docs: DataFrame, words: int, percent: int, task_shingles: int) -> DataFrame:
    """docs: d (long, never null or repeated), text. Per row: d, n (shingles), comp (the least d reachable)."""
    rows = band_rows(percent)
    bands = HASHES // rows

    def make():
        def work(texts: list[bytes | None]) -> list[list]:
            w = Words(texts, NOT_SPACE, lower=True)
            sets, begin = shingles(w, words)
            n = np.diff(begin)
            some = np.flatnonzero(n)
            keys: list = [None] * w.n
            sigs: list = [None] * w.n
            one = np.zeros(w.n, np.int64)
            two = np.zeros(w.n, np.int64)
            if len(some):
                at = begin[:-1][some]
                k, s = signatures(sets, np.append(at, begin[-1]), rows)
                one[some] = np.add.reduceat(mix(sets ^ _U(0x51)), at).view(np.int64)
                two[some] = np.add.reduceat(mix(sets ^ _U(0xA7)), at).view(np.int64)
                for x, i in enumerate(some.tolist()):
                    keys[i], sigs[i] = k[x].tobytes(), s[x].tobytes()
            return [n.tolist(), one.tolist(), two.tolist(), keys, sigs]

        return work

    added = [("n", "long", pa.int64()), ("one", "long", pa.int64()), ("two", "long", pa.int64()), ("keys", "binary", pa.binary()), ("sigs", "binary", pa.binary())]
    signed = checkpoint(map_texts(docs, "text", added, make, ["d"]).withColumnRenamed("c0", "d"))
    nodes = signed.where("n > 0").groupBy("n", "one", "two").agg(F.min("d").alias("d"), F.first("keys").alias("keys"), F.first("sigs").alias("sigs"))
    near = components(_candidates(nodes, bands))
    member = near.select(F.col("node").alias("d"), F.col("root").alias("comp"))
    member = member.union(near.select(F.col("root").alias("d"), F.col("root").alias("comp")).distinct())

    # the full sets of nodes that have a candidate, read again from their texts
    wanted = checkpoint(nodes.join(member, "d"))
    total = wanted.groupBy("comp").agg(F.sum("n").alias("total")).select("comp", F.ceil(F.col("total") / task_shingles).cast("int").alias("chunks"))
    large = total.where("chunks > 1")
    if large.limit(1).count():
        wanted = spread_join(wanted, large, ["comp"], ["d"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        wanted = checkpoint(wanted.withColumn("chunk", F.pmod(F.xxhash64("d"), F.col("chunks")).cast("int")))
    else:
        large = None
        wanted = wanted.withColumns({"chunks": F.lit(1), "chunk": F.lit(0)})

    def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_bytes(batch.column(0))
            out = []
            for lo, hi in slices(texts):
                sets, begin = shingles(Words(texts[lo:hi], NOT_SPACE, lower=True), words)
                out += [sets[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.binary())], ["d", "n", "sigs", "keys", "label", "task", "shingles"])

    def sets_of(some: DataFrame) -> DataFrame:
        some = some.select("d", "n", "sigs", "keys", F.col("d").alias("label"), F.concat_ws(":", "comp", "chunk").alias("task"))
        read = docs.join(some.hint("shuffle_hash"), "d").select("text", "d", "n", "sigs", "keys", "label", "task")
        return read.mapInArrow(set_rows, "d long, n long, sigs binary, keys binary, label long, task string, shingles binary")

    def confirmed(tasks: DataFrame) -> DataFrame:
        by = tasks.select("d", "n", "sigs", "keys", "shingles", "label", "side", "task").repartition("task").sortWithinPartitions("task")
        return by.mapInArrow(_link_rows(bands, percent), "u long, v long")

    alone = F.lit(-1).alias("side")
    links = confirmed(sets_of(wanted.where("chunks = 1")).select("*", alone))
    if large is not None:
        sets = written(sets_of(wanted.where("chunks > 1")))
        within = checkpoint(confirmed(sets.select("*", alone)))
        known = components(within).select(F.col("node").alias("d"), "root")
        sets = sets.drop("label", "task").join(known, "d", "left").withColumn("label", F.coalesce("root", "d")).drop("root")
        tasks = _bucket_tasks(sets, bands, task_shingles)
        links = links.union(within).union(confirmed(sets.join(tasks, "d")))
    found = components(links)

    # from rows to nodes to components
    named = nodes.select("n", "one", "two", F.col("d").alias("rep")).join(found, F.col("rep") == F.col("node"), "left")
    named = named.select("n", "one", "two", F.coalesce("root", "rep").alias("comp"))
    out = spread_join(signed.where("n > 0").select("d", "n", "one", "two"), named, ["n", "one", "two"], ["d"])
    return out.select("d", "n", "comp").union(signed.where("n = 0").select("d", "n", F.col("d").alias("comp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Texts are linked whose sets of shingles of `words` words (lower-cased A-Z) have 100 times
    their common part >= percent times their union. component_id is the smallest id reachable.
    A text without words, or null, has no shingles and links. Ids may be of any type with an
    order. Rows that share an id are one document with the links of all of them. A row without an
    id is a document of its own and its null counts as the smallest id: component_id is null then,
    and one of the component's rows without ids is kept. Empty tables give no rows. Other columns
    of docs are not read. Shingles are compared by 64-bit hashes.
    """
    if plain_ids(docs, id_col):
        out = _linked(docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("text")), words, percent, task_shingles)
        kind = docs.schema[id_col].dataType
        return out.select(
            F.col("d").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").cast(kind).alias("component_id"), (F.col("d") == F.col("comp")).alias("kept")
        )
    rows = numbered_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", "d")
    out = checkpoint(_linked(rows.select("d", "text"), words, percent, task_shingles).join(rows.select("d", "id"), "d"))
    own = out.where("id is not null")
    several = own.groupBy("id").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").drop("most")
    ties = spread_join(own.select("id", "comp").distinct(), several, ["id"], ["comp"])
    tied = components(ties.select(F.col("comp").alias("u"), F.col("least").alias("v"))).select(F.col("node").alias("comp"), "root")
    out = checkpoint(spread_join(out, tied, ["comp"], ["d"], "left").withColumn("comp", F.coalesce("root", "comp")).drop("root"))
    first = out.groupBy("comp").agg(F.min_by("id", "d").alias("component_id"), F.min("d").alias("first"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("d") == F.col("first")))
    return spread_join(out, first, ["comp"], ["d"]).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, columns as they are, of which one of each group of near-duplicates stays.

    Of a group the row with the smallest id stays. Where rows share an id, or have none, each row
    counts for itself: null is the smallest id, and rows of one id go by a hash of their texts.
    """
    row = free_name(docs, "_row")
    if plain_ids(docs, id_col):
        rows = docs.withColumn(row, F.col(id_col).cast("long"))
    else:
        rows = numbered_rows(docs, id_col, text_col, row)
    kept = _linked(rows.select(F.col(row).alias("d"), F.col(text_col).alias("text")), words, percent, TASK_SHINGLES).where("d = comp")
    return rows.join(kept.select(F.col("d").alias(row)).hint("shuffle_hash"), row, "left_semi").drop(row).select(*[F.col(f"`{c}`") for c in docs.columns])
