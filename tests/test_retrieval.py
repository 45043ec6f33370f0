"""Facts about search, fusion and metrics, on rows small enough to work out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from quernlex.operators.metrics import at_k, by_rank, overall, section_scores
from quernlex.operators.retrieval import Bm25, cosine_topk, fuse


def test_cosine(spark):
    index = spark.createDataFrame([(0, "a", [0.0, 2.0, 0.0]), (1, "a", [3.0, 3.0, 0.0]), (2, "b", [5.0, 0.0, 0.0]), (3, "b", [0.0, 0.0, 0.0]), (4, "b", None)], "ordinal long, d string, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, embedding array<double>")
    got = [(r["ordinal"], round(r["score"], 6)) for r in cosine_topk(asked, index, 5).orderBy("rank").collect()]
    assert got == [(2, 1.0), (1, round(1 / math.sqrt(2), 6)), (0, 0.0), (3, 0.0), (4, 0.0)]
    assert [r["ordinal"] for r in cosine_topk(asked, index, 1, F.col("d") == "a").collect()] == [1]
    assert cosine_topk(asked, index, 0).count() == 0 and cosine_topk(asked, index.where("false"), 3).count() == 0 and cosine_topk(asked.where("false"), index, 3).count() == 0
    with pytest.raises(ValueError):
        cosine_topk(asked, index, -1)


def plain_bm25(texts, question):
    docs = [t.lower().split() for t in texts]
    n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    return [sum(idf.get(q, 0) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for q in question.lower().split()) for d in docs]


def test_bm25(spark):
    texts = ["the cat sat", "the dog", "the cat the cat", "a bird", "", "the end of the cat"]
    index = spark.createDataFrame([(i, t, "x" if i % 2 else "y") for i, t in enumerate(texts)], "ordinal long, text string, d string")
    asked = spark.createDataFrame([(1, "the cat cat"), (2, "zebra"), (3, "")], "query_id int, text string")
    for k in (1, 4, 6, 9):
        got = Bm25(index).topk(asked, k).collect()
        for q in (1, 2, 3):
            scores = plain_bm25(texts, {1: "the cat cat", 2: "zebra", 3: ""}[q])
            want = sorted(range(6), key=lambda i: (-round(scores[i], 9), i))[:k]
            mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
            assert [r["ordinal"] for r in mine] == want and all(abs(r["score"] - scores[r["ordinal"]]) < 1e-9 for r in mine)
    assert [r["ordinal"] for r in Bm25(index).topk(asked.where("query_id = 2"), 2, F.col("d") == "x").orderBy("rank").collect()] == [1, 3]
    assert Bm25(index.where("false")).topk(asked, 3).count() == 0


def test_fusion(spark):
    shape = "query_id string, ordinal long, score double, rank int"
    dense = spark.createDataFrame([("q", 7, 0.9, 1), ("q", 8, 0.0, 2)], shape)
    sparse = spark.createDataFrame([("q", 9, 3.0, 1), ("q", 7, 1.0, 2)], shape)
    got = fuse(dense, sparse).orderBy("rank").collect()
    assert [r["ordinal"] for r in got] == [7, 9, 8]
    assert abs(got[0]["combined_score"] - (1 / 61 + 1 / 62)) < 1e-12 and got[1]["vector_score"] == 0.0


def test_metrics(spark):
    run = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "z", 2)], "query_id string, chunk_id string, rank int")
    marks = spark.createDataFrame([("a", "x", 0, 1), ("a", "x", 2, 2), ("b", "z", 1, 1), ("c", "x", 0, 1), ("d", "x", 2, 1)], "query_id string, chunk_id string, relevance_score int, seq int")
    k = {(r["query_id"], r["k"]): (r["precision"], r["recall"]) for r in at_k(run, marks).collect()}
    assert k["a", 1] == (1.0, 1.0) and k["a", 3] == (0.5, 1.0) and k["b", 1] == (0.0, 0.0) and k["c", 5] == (0.0, 1.0) and k["d", 1] == (0.0, 0.0)
    r = {r["query_id"]: r for r in by_rank(run, marks).collect()}
    assert (r["b"]["reciprocal_rank"], r["b"]["average_precision"]) == (0.5, 0.5)
    assert r["c"]["average_precision"] == 0.0 and not r["c"]["has_relevant"]
    m = {x["metric"]: x["value"] for x in overall(at_k(run, marks), by_rank(run, marks), "median").collect()}
    assert m["precision@1"] == 0.0 and m["recall@10"] == 1.0 and m["mrr"] == 0.375


def test_section_scores(spark):
    run = spark.createDataFrame([("q", 1, "act_v1", ["2", "3"], "2", None), ("q", 2, "act_v1", ["2"], "2", None), ("q", 3, "actx", ["9"], "9", None), ("q", 4, "act", ["9"], "9", "1"), ("q", 5, "act", ["9a"], "9a", None)], "query_id string, rank int, document_name string, sections array<string>, section_number string, schedule string")
    gold = spark.createDataFrame([("q", "act", "3"), ("q", "act", "9A"), ("n", "act", None)], "query_id string, act string, section string")
    got = {(r["query_id"], r["k"]): r for r in section_scores(run, gold, (3, 5)).collect()}
    assert (round(got["q", 3]["precision"], 6), got["q", 3]["recall"], got["q", 5]["recall"], got["q", 5]["rr"]) == (round(1 / 3, 6), 0.5, 1.0, 1.0)
    assert got["n", 3]["precision"] is None and got["n", 3]["doc_hit"] is False
