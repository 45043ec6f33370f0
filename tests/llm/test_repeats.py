import hashlib
import re
from collections import defaultdict

import pytest

from quernlex.llm.repeats import cover_anchors, minimiser_anchors, substring_dedup, suffix_array_dedup

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, length):
    """Per id: words, words under a window that starts earlier, words under one that repeats."""
    words = {i: SPACED.findall(t or "") for i, t, *_ in rows}
    starts = defaultdict(list)
    for i in sorted(words):
        for s in range(len(words[i]) - length + 1):
            starts[tuple(words[i][s : s + length])].append((i, s))
    gone, twice = defaultdict(set), defaultdict(set)
    for places in starts.values():
        for k, (i, s) in enumerate(places):
            if k:
                gone[i].update(range(s, s + length))
            if len(places) > 1:
                twice[i].update(range(s, s + length))
    return words, gone, twice


def spread(spans):
    return {n for s in spans for n in range(s["start"], s["end"])}


def kept_sha(words, gone):
    return hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()


@pytest.mark.parametrize("length", [13, 20, 31])
def test_substring(docs, rows, length):
    words, gone, _ = plain(rows, length)
    got = substring_dedup(docs, length=length).collect()
    assert len(got) == len(rows) and any(gone.values())
    for r in got:
        i = r["doc_id"]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(words[i]), len(gone[i]), kept_sha(words[i], gone[i]))
        assert spread(r["removed"]) == gone[i]


@pytest.mark.parametrize(("length", "prefix", "run_rows"), [(50, 16, 50_000), (12, 12, 50_000), (20, 3, 50_000), (20, 3, 7)])
def test_suffix_array(docs, rows, length, prefix, run_rows):
    words, gone, twice = plain(rows, length)
    for r in suffix_array_dedup(docs, length=length, prefix=prefix, run_rows=run_rows).collect():
        i = r["doc_id"]
        assert (r["n_words"], r["n_removed"], r["n_repeated"]) == (len(words[i]), len(gone[i]), len(twice[i]))
        assert r["kept_sha256"] == kept_sha(words[i], gone[i])
        assert spread(r["repeated"]) == twice[i] and spread(r["removed"]) == gone[i]


def test_odd_rows(spark, odd, empty):
    for op in (substring_dedup, suffix_array_dedup):
        assert op(empty).count() == 0
        assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in op(odd).collect()} == {(None, 3, 0), (5, 3, 0), (5, 1, 0), (6, 0, 0), (7, 0, 0)}
    # a null id counts as the smallest; repeated rows are one document; two texts of one id are two
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(3, text), (None, text), (3, text), (9, text + " more"), (9, "less " + text), (9, text + " more")]
    for op in (substring_dedup, suffix_array_dedup):
        got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in op(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == [(0, 60, 0), (3, 60, 60), (3, 60, 60), (9, 61, 60), (9, 61, 60), (9, 61, 60)]


def test_one_text_repeats_itself(spark):
    text = " ".join(["a"] * 300 + [f"w{k}" for k in range(300)])
    row = substring_dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_removed"] == 299


def test_parameters():
    with pytest.raises(ValueError):
        cover_anchors(20, 13, (0, 1, 2))
    with pytest.raises(ValueError):
        cover_anchors(5)
    with pytest.raises(ValueError):
        minimiser_anchors(10, 16)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_cancel_out_in_sums(spark, n):
    """Words of two letters in the Thue-Morse order, and their complements, are different words."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    two = one.translate({97: "b", 98: "a"})
    tail = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, " ".join([one, two] * 30)), (4, " ".join([two, one] * 30))]
    for op, length in ((substring_dedup, 20), (suffix_array_dedup, 50)):
        words, gone, _ = plain(rows, length)
        for r in op(spark.createDataFrame(rows, "doc_id long, text string")).collect():
            assert spread(r["removed"]) == gone[r["doc_id"]] and r["n_removed"] == len(gone[r["doc_id"]])


def test_left_sides_that_alternate(spark):
    """Suffixes that sort next to each other have different left sides; their equals stand apart."""
    middle = " ".join(f"m{k}" for k in range(30))
    lefts = [" ".join(f"{c}{k}" for k in range(15)) for c in "xyz"]
    rights = [" ".join(f"{c}{k}" for k in range(15)) for c in "pqr"]
    rows = [(i, f"{lefts[i % 3]} {middle} {rights[i % 2]}") for i in range(12)]
    words, gone, twice = plain(rows, 50)
    for run_rows in (50_000, 2):
        for r in suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string"), run_rows=run_rows).collect():
            assert spread(r["removed"]) == gone[r["doc_id"]] and spread(r["repeated"]) == twice[r["doc_id"]]


def test_ids_texts_and_names(spark):
    """Ids that are strings, a very long text, other columns named like those of the result."""
    text = " ".join(f"w{k}" for k in range(60))
    long = "x" * 300_000 + " " + text + " " + " ".join(f"v{k}" for k in range(40_000))
    rows = [("b", text, 1, 1), ("a", long, 2, 2), (None, "short", 3, 3), ("c", "y" * 2_000_000, 4, 4)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_words int, d int")
    for op in (substring_dedup, suffix_array_dedup):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in op(docs).collect()}
        assert got == {"a": (40_061, 0), "b": (60, 60), None: (1, 0), "c": (1, 0)}


def test_common_words():
    import numpy as np

    from quernlex.llm.repeats import common_words

    texts = [b"", b"a ", b"a b ", b"a b c ", b"a bc ", b"a bc ", b"ab "]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array(list(map(len, texts)))
    assert common_words(data, np.cumsum(size) - size, size).tolist() == [0, 0, 1, 2, 1, 2, 0]
