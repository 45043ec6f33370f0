"""Queries that take the whole of their tables, against brute force on small ones."""

import math

import pytest

from quernlex.plans import registry

VECTORS = [(i, [math.cos(i * i), math.sin(i * i), math.sin(3 * i)], i % 4) for i in range(130)]


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(i, f"word{i} and") for i in range(30)], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, f"word{i}") for i in range(4)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def nearest(q, keep=lambda i: True):
    """All that are kept, the nearest first."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    score = lambda i: dot(VECTORS[q][1], VECTORS[i][1]) / math.sqrt(dot(VECTORS[q][1], VECTORS[q][1]) * dot(VECTORS[i][1], VECTORS[i][1]))
    return sorted(filter(keep, range(130)), key=lambda i: (-round(score(i), 6), i))


def fused(dense, sparse):
    part = lambda one, x: 1 / (61 + one.index(x)) if x in one else 0
    return sorted({*dense, *sparse}, key=lambda x: (-part(dense, x) - part(sparse, x), x not in dense, (dense if x in dense else sparse).index(x)))[:10]


def found(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["ordinal"])
    return got


def test_every_asking_vector_meets_the_whole_table(spark, vectors):
    q = registry.queries()
    assert found(q["cosine_topk"](spark, vectors)) == {i: nearest(i)[:10] for i in (0, 50, 100)}
    assert found(q["cosine_topk_filtered"](spark, vectors)) == {i: nearest(i, lambda x: VECTORS[x][2] == 3)[:5] for i in (0, 50, 100)}
    hybrid = found(q["hybrid_topk"](spark, vectors))
    assert hybrid == {n: fused(nearest(50 * n)[:20] if n < 3 else [], [n, *(x for x in range(30) if x != n)][:20]) for n in range(4)}  # item 3 has no vector


def test_metrics_of_every_asking_vector(spark, vectors):
    q = registry.queries()
    ranked = {i: [int(VECTORS[x][2] == VECTORS[i][2]) for x in nearest(i, lambda x, i=i: x != i)[:10]] for i in (0, 50, 100)}
    total = {i: sum(v[2] == VECTORS[i][2] for v in VECTORS) - 1 for i in ranked}
    at_k = {(r["query_id"], r["k"]): r for r in q["metrics_at_k"](spark, vectors).collect()}
    assert set(at_k) == {(i, k) for i in ranked for k in (1, 3, 5, 10)}
    assert all(math.isclose(r["precision"], sum(ranked[i][:k]) / k, abs_tol=1e-8) and math.isclose(r["recall"], sum(ranked[i][:k]) / total[i], abs_tol=1e-8) for (i, k), r in at_k.items())
    by_rank = {r["query_id"]: r for r in q["reciprocal_rank_and_average_precision"](spark, vectors).collect()}
    rr = {i: next((1 / (n + 1) for n, x in enumerate(hits) if x), 0) for i, hits in ranked.items()}
    assert set(by_rank) == set(ranked) and all(by_rank[i]["num_relevant"] == total[i] and math.isclose(by_rank[i]["reciprocal_rank"], rr[i], abs_tol=1e-8) for i in ranked)
    mean = {r["metric"]: r["value"] for r in q["overall_mean"](spark, vectors).collect()}
    median = {r["metric"]: r["value"] for r in q["overall_median"](spark, vectors).collect()}
    p10 = sorted(sum(hits) / 10 for hits in ranked.values())
    assert math.isclose(mean["precision@10"], sum(p10) / 3, abs_tol=1e-8) and math.isclose(median["precision@10"], p10[1], abs_tol=1e-8) and math.isclose(mean["mrr"], sum(rr.values()) / 3, abs_tol=1e-8)


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("lines"))
    texts = ["lantern lantern harbour\nharbour anchor\nbeacon", "anchor lantern\n\n" + "\n".join(f"pebble line {i}" for i in range(3, 13))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(f"{at}/documents.parquet")
    return at, texts


def test_terms_of_every_section(spark, lines):
    at, texts = lines
    got = {}
    for r in sorted(registry.queries()["section_term_specificity"](spark, at).collect(), key=lambda r: r["place"]):
        got.setdefault(r["section_number"], []).append((r["term"], r["n_sections"]))
    own = {}
    for text in texts:
        for i, line in enumerate(text.split("\n"), 1):
            own.setdefault(str(i), set()).update(w for w in line.split() if w.isalpha())
    assert set(got) == set(own) and len(own) == 12
    spread = {w: sum(w in x for x in own.values()) for x in own.values() for w in x}
    for section, words in own.items():
        mine = [x for x in got[section] if x[0] in spread]
        assert mine == sorted(((w, spread[w]) for w in words), key=lambda x: (x[1], x[0]))
        assert [x[1] for x in got[section]] == sorted(x[1] for x in got[section])


def test_a_question_for_every_section_and_document(spark, lines):
    at, texts = lines
    blocks = [(d, str(i)) for d, text in enumerate(texts) for i, _ in enumerate(text.split("\n"), 1)]
    want = {(f"document_act_{d}", f"act_{d}_chunk_{i}", 2) for d, i in blocks}
    want |= {(f"section_{s}", f"act_{d}_chunk_{i}", 2 if s == i else 1) for s in {i for _, i in blocks} for d, i in blocks if s in i}
    got = [tuple(r) for r in registry.queries()["auto_annotate"](spark, at).collect()]
    assert sorted(got) == sorted(want)
