"""The trained operators, by their accuracy on rows kept from training; trees and calibration alone."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernlex.llm.language import languages, softmax, subwords
from quernlex.llm.toxicity import Features, toxicity, without_toxic
from quernlex.llm.trees import Boosted, Isotonic

TOXIC_STEMS = ("grubbl", "snivt")


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


@pytest.fixture(scope="module")
def labelled():
    """Texts of two invented languages; toxic ones have an insult or an inflected stem."""
    rng = random.Random(11)
    parts = {"aa": ["ka", "mo", "ti", "ra", "lu", "pe"], "bb": ["schö", "grun", "wex", "dorf", "zep", "quil"]}
    rows, labels = [], []
    for i in range(700):
        lang = rng.choice(["aa", "aa", "bb"])
        words = ["".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(8, 90))]
        toxic = int(rng.random() < 0.25)
        for _ in range(toxic * rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words)), "Idiot" if lang == "aa" else rng.choice(TOXIC_STEMS) + rng.choice(parts["bb"]))
        rows.append((i, " ".join(words), lang if rng.random() < 0.9 else None))
        if rng.random() < 0.8:
            labels.append((i, None if rng.random() < 0.02 else toxic))
    rows += [(9001, None, "aa"), (9002, "", None), (9003, "123 !?", "aa"), (9004, "idiot " * 30_000, "aa"), (None, "ka mo ti", "bb"), (5, rows[5][1], rows[5][2])]
    labels += [(9001, 0), (None, 1), (77_777, 1), labels[0]]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, labelled):
    rows, labels = labelled
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return docs.withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1)), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(tables, labelled):
    docs, labels = tables
    rows, known = labelled
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    truth = dict(known)
    seen = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert len(seen) > 80 and np.mean([a == b for a, b in seen]) > 0.95
    assert sorted(map(str, toxicity(docs, labels).collect())) == sorted(map(str, got))
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)


def test_toxicity_with_nothing_to_learn(spark, tables, odd, empty):
    docs, labels = tables
    assert toxicity(empty, labels).count() == 0
    none = labels.where("false")
    assert {r["predicted"] for r in toxicity(odd, none).collect()} == {0} and toxicity(odd, none).count() == 7
    only = spark.createDataFrame([(5, 1)], "doc_id long, toxic int")
    assert toxicity(odd, only).count() == 7


def test_language(tables, labelled):
    docs, _ = tables
    rows, _ = labelled
    got = languages(docs).collect()
    assert len(got) == len(rows) and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    truth = {i: x for i, _, x in rows}
    seen = [(truth[r["doc_id"]], r["lang_pred"], r["rejected"]) for r in got if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(seen) > 100 and np.mean([a == b for a, b, _ in seen]) > 0.97
    assert np.mean([a == b for a, b, c in seen if not c]) >= 0.99
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[9001] == by[9002] == by[9003] == "und" and by[9004] != "und" and by[None] == "aa"
    assert sorted(map(str, languages(docs).collect())) == sorted(map(str, got))


def test_language_with_nothing_to_learn(docs, odd, empty):
    assert languages(empty).count() == 0
    assert languages(odd).count() == 7
    nothing = languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in nothing} == {("und", 0.0, True)}


def test_subwords_do_not_depend_on_neighbours():
    texts = [b"One two", None, b"", b"x", "é\nab 12 cd".encode(), b"ONE  TWO!"]
    codes, begin = subwords(texts)
    for i, t in enumerate(texts):
        alone, _ = subwords([t])
        assert sorted(codes[begin[i] : begin[i + 1]].tolist()) == sorted(alone.tolist())
    assert sorted(codes[begin[0] : begin[1]].tolist()) == sorted(codes[begin[5] : begin[6]].tolist())
    assert np.allclose(softmax(np.array([[0.0, 0.0], [1000.0, 0.0]])), [[0.5, 0.5], [1, 0]])


def test_features_do_not_depend_on_neighbours():
    from quernlex.llm.toxicity import Lexicon

    f, none = Features(), Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    texts = [b"you IDIOT!", None, b"", b"an 1di0t, idi0tic", b"you"]
    together = f.of(texts, [none], np.zeros(5, np.int64))
    alone = np.concatenate([f.of([t], [none], np.zeros(1, np.int64)) for t in texts])
    assert np.allclose(together, alone)
    assert together[:, 3].tolist() == [1, 0, 0, 2, 0] and together[3, -2] > 0 and together[0, 10] > 0


def test_boosting_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    p = Boosted().fit(x[:2000], y[:2000]).predict(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.97
    assert np.allclose(Boosted().fit(x, np.ones(3000)).predict(x[:3]), 1, atol=1e-6)
    score = rng.random(4000)
    iso = Isotonic(score, rng.random(4000) < score**2)
    grid = iso.apply(np.linspace(0, 1, 50))
    assert (np.diff(grid) > 0).all() and np.abs(grid - np.linspace(0, 1, 50) ** 2).max() < 0.12


def test_a_table_of_one_id(spark):
    """All rows share an id: the sample has one row, whatever their number."""
    docs = spark.createDataFrame([(1, f"hello there number {k}", "en" if k % 2 else "de") for k in range(4000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)] * 50, "doc_id long, toxic int")
    scored = toxicity(docs, labels)
    assert scored.count() == 4000 and {r["score"] for r in scored.collect()} <= {0.0, 1.0} | {r["score"] for r in scored.collect()}
    named = languages(docs).collect()
    assert len(named) == 4000 and {r["lang_pred"] for r in named} == {"de"}
