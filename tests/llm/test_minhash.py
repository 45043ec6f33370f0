import random
import re

import numpy as np
import pytest

from quernlex.llm.components import components
from quernlex.llm.minhash import HASHES, band_rows, estimate, near_duplicates, one_of_each, shingles, signatures
from quernlex.llm.words import Words

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, words, percent):
    sets, ids = [], []
    for i, t, *_ in rows:
        w = SPACED.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        ids.append(i)
        sets.append({tuple(w[s : s + words]) for s in range(max(1, len(w) - words + 1))} if w else set())
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


@pytest.mark.parametrize(("words", "percent", "task"), [(3, 85, 2_000_000), (5, 80, 2_000_000), (3, 85, 900)])
def test_near_duplicates(docs, rows, words, percent, task):
    want = plain(rows, words, percent)
    got = near_duplicates(docs, words=words, percent=percent, task_shingles=task).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({c for _, c in want.values()}) < len(rows) - 30


def test_chain_of_edits(spark):
    """Texts that drift: ends are far apart, neighbours are linked."""
    rng = random.Random(2)
    words, rows = [f"w{k}" for k in range(200)], []
    for i in range(60):
        words[(i * 37) % 200] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85, task_shingles=3000).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain(rows, 3, 85)


def test_odd_rows(odd, empty):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(odd).collect()), key=str)
    # rows without ids are documents of their own, of which one stays
    assert got == sorted([(None, 1, None, True), (None, 1, None, False)] + [(5, 1, None, False)] * 3 + [(6, 0, 6, True), (7, 0, 7, True)], key=str)
    assert near_duplicates(empty).count() == 0
    assert one_of_each(odd).columns == odd.columns and one_of_each(empty).count() == 0


def test_one_of_each(docs, rows):
    want = {i for i, (_, c) in plain(rows, 5, 80).items() if i == c}
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_one_of_each_goes_by_rows(spark):
    """Rows that share an id, or have none, are judged by their own texts."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, one), (7, one + " more"), (7, two), (None, three), (None, three + " more"), (9, three), (None, None)]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert kept.columns == ["doc_id", "text"]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(3, one), (7, two), (None, three), (None, None)], key=str)


@pytest.mark.parametrize("hubs", [1000, 5])
def test_components(spark, monkeypatch, hubs):
    """With few hubs, nodes of both kinds; with the usual number every node of so small a graph is one."""
    monkeypatch.setattr("quernlex.llm.components.HUBS", hubs)
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5300)]
    root = {n: n for e in links for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("small", "hubs"), [(10**6, 1000), (0, 1000), (0, 5)])
def test_components_of_small_and_large_graphs(spark, monkeypatch, small, hubs):
    """Long chains, stars, loops, repeated links and negative nodes, in one task and by rounds."""
    monkeypatch.setattr("quernlex.llm.components.SMALL", small)
    monkeypatch.setattr("quernlex.llm.components.HUBS", hubs)
    rng = random.Random(6)
    chain = rng.sample(range(-2000, -1000), 40)
    links = list(zip(chain, chain[1:], strict=False)) + [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(2**62, k) for k in range(7000, 7200)] + [(9, 9), (-(2**63), 2**63 - 1)] * 2
    near = {n: set() for e in links for n in e}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for n in sorted(near):
        todo = [n]
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = n
                todo += near[x]
    spark.sparkContext.setJobGroup(f"components-{small}-{hubs}", "")
    found = components(spark.createDataFrame(links, "u long, v long").repartition(7))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{small}-{hubs}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = found.collect()
    assert len(rows) == len({r["node"] for r in rows}) and {r["node"]: r["root"] for r in rows} == {n: r for n, r in want.items() if n != r}
    assert not small or jobs <= 8  # each round takes several; a driver keeps something of every query


def test_estimate_is_close():
    rng = random.Random(1)
    base = [f"w{k}" for k in range(600)]
    other = [w if rng.random() > 0.05 else f"x{k}" for k, w in enumerate(base)]
    sets, begin = shingles(Words([" ".join(base).encode(), " ".join(other).encode()]), 3)
    _, sigs = signatures(sets, begin, 6)
    a, b = set(sets[: begin[1]].tolist()), set(sets[begin[1] :].tolist())
    assert abs(float(estimate(sigs[0], sigs[1:])[0]) - len(a & b) / len(a | b)) < 0.12
    assert float(estimate(sigs[0], sigs[:1])[0]) == 1.0


def test_bands_lose_nothing():
    for percent in (80, 85, 90):
        r = band_rows(percent)
        assert (1 - (percent / 100) ** r) ** (HASHES // r) <= 1e-6
    assert band_rows(85) == 6 and np.uint8(1) == 1


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_that_cancel_out_in_sums(spark, n):
    """Hashes that add up weighted bytes modulo 2**64 can't tell these words apart."""
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    w = Words([f"{one} {two}".encode()])
    assert len(set(w.hashes().tolist() + w.hashes(1).tolist())) == 4
    letters = Words([" ".join(x).encode() for x in (one, two)])
    for which in (0, 1):
        a, b = letters.windows(n, which)[[0, n]].tolist()
        assert a != b
    rows = [(1, " ".join([one] * 9)), (2, " ".join([two] * 9)), (3, " ".join([one] * 9))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1}


def test_hashes_see_every_byte():
    base = bytes(97 + k % 26 for k in range(600))
    words = {base[:n] for n in range(1, 601)} | {base[:k] + b"#" + base[k + 1 :] for k in range(600)} | {base[:40][:k] + b"#" + base[:40][k + 1 :] for k in range(40)}
    w = Words([b" ".join(sorted(words))])
    for which in (0, 1):
        assert len(set(w.hashes(which).tolist())) == len(words)
    # the same word hashes alike wherever it stands
    again = Words([b"x " + b" ".join(sorted(words))])
    assert (again.hashes()[1:] == w.hashes()).all()


def test_many_rows_without_ids(spark):
    """Each is a document of its own; no join brings them together."""
    texts = [f"alpha{k} beta{k} gamma{k} delta{k}" for k in range(5000)]
    rows = [(None, t) for t in texts] + [(1, "one two three four"), (2, "one two three four"), (3, texts[0])]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert sum(r["doc_id"] is None for r in got) == 5000 and sum(r["doc_id"] is None and r["kept"] for r in got) == 5000
    assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in got if r["doc_id"]} == {1: (1, True), 2: (1, False), 3: (None, False)}


def test_ids_that_are_no_numbers(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(9)) for x in "ab")
    rows = [("z", one, 0, 1), ("b", one, 0, 2), ("é", two, 0, 3), (None, None, 0, 4)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id string, text string, d int, comp int"), words=3, percent=85).collect()
    assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in got} == {"z": ("b", False), "b": ("b", True), "é": ("é", True), None: (None, True)}


@pytest.mark.parametrize("task", [300, 2000])
def test_a_component_of_many_chunks(spark, task):
    """Hundreds of near copies in the same buckets, and strangers that share a part with them."""
    rng = random.Random(11)
    base, rows = [f"w{k}" for k in range(60)], []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85, task_shingles=task).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain(rows, 3, 85)
