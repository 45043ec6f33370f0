"""The pipeline's stages, each on its own input, against plain versions."""

import random

import pytest

from corpus_pipeline import ORACLE_SQL, STAGES, run

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    draw = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(n))
    items = [draw(12) for _ in range(3)]
    base = [draw(rng.randrange(20, 90)) for _ in range(160)]
    rows, labels = [], []
    for i, t in enumerate(base):
        toxic = i % 5 == 0
        rows.append((i, t + (" you idiot moron " + draw(3)) * toxic))
        labels.append((i, None, int(toxic)))
    rows += [(200 + i, base[i]) for i in (1, 2, 3)] + [(300, base[6] + " tail"), (301, base[7] + " x")]
    rows += [(400, draw(10) + " " + items[0] + " " + draw(9)), (401, items[1].upper()), (500, None), (501, "")]
    rows = [(i, t, "en", ["s", None, "u"][i % 3], None) for i, t in rows]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows


def test_stages(spark, folder):
    at, rows = folder
    assert ORACLE_SQL is None and [n for n, _ in STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    left = {r[0] for r in rows}
    gone = [{i for i in range(0, 160, 5)}, {201, 202, 203, 501}, {300, 301}, {400, 401}]
    for (_, stage), out in zip(STAGES, gone, strict=False):
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, at).collect(), SCHEMA)
        left -= out
        assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == left
    mixed = {r["doc_id"]: r for r in STAGES[-1][1](spark, docs, at).collect()}
    assert set(mixed) == left
    assert sorted(map(str, run(spark, at).collect())) == sorted(map(str, mixed.values()))


def test_one_short_item_does_not_empty_the_corpus(spark, tmp_path):
    long = "one two three four five six seven eight"
    spark.createDataFrame([(1, "the"), (2, long), (3, "lamp")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "the cat"), (2, f"so {long} nine"), (3, "the lamp"), (4, "a dog"), (5, None), (6, f"the {long}")], "doc_id long, text string")
    kept = dict(STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5]
