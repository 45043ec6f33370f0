"""The named queries of the engine, each with SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernlex.functions.text import document_matches, normal_act, tokens
from quernlex.operators import extraction, metrics, retrieval
from quernlex.session import table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Vectors with ids divisible by this ask the whole table.
QUERY_STEP = 50
DIGITS = 9


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from quernlex.plans import legal  # noqa: F401  adds its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)


# inputs ---------------------------------------------------------------------------------


def index_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), "text", "lang", "source")


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every vector whose id is divisible by QUERY_STEP, and all vectors, the asking ones among them."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ordinal"), "embedding", "label")
    return v.where(F.col("ordinal") % QUERY_STEP == 0).select(F.col("ordinal").alias("query_id"), "embedding", "label"), v


# scans and filters ------------------------------------------------------------------------


@query("SELECT doc_id, source AS document, lang AS type, length(text) AS n_text FROM documents")
def scan_documents_project(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("document"), F.col("lang").alias("type"), F.length("text").cast("long").alias("n_text"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'de' AND source = 'src1'")
def filter_document_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'de' and source = 'src1'").select("doc_id", "source")


@query(
    "WITH acts(act) AS (VALUES ('src1'), ('src2')), d AS (SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN '_v' || (doc_id % 3) ELSE '' END AS document FROM documents)"
    " SELECT doc_id, document, act FROM d JOIN acts ON document = act OR starts_with(document, act || '_')"
)
def prefix_match_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    volume = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("_v"), (F.col("doc_id") % 3).cast("string"))).otherwise(F.lit(""))
    d = d.select("doc_id", F.concat("source", volume).alias("document"))
    acts = spark.createDataFrame([("src1",), ("src2",)], "act string")
    return d.join(F.broadcast(acts), document_matches(F.col("document"), F.col("act"))).select("doc_id", "document", "act")


# words ------------------------------------------------------------------------------------

_TOKENS = "t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS token FROM documents)"


@query(f"WITH {_TOKENS} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY token")
def tokenise_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("token"))
    per = d.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(
    "WITH w AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS l FROM documents)),"
    " t AS (SELECT doc_id, pos, regexp_replace(raw, '^[.,;:!?()\"'']+|[.,;:!?()\"'']+$', '', 'g') AS term FROM w),"
    f" c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS pos FROM t WHERE length(term) > 2 AND term NOT IN ({', '.join(repr(x) for x in extraction.STOP_WORDS)}) GROUP BY ALL)"
    " SELECT doc_id, term, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS BIGINT) AS place FROM c QUALIFY place <= 5"
)
def key_terms_topn(spark, sf_dir):
    return extraction.key_terms(table(spark, sf_dir, "documents"), ["doc_id"], 5).withColumn("place", F.col("place").cast("long"))


# search -----------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(range(1, len(q.v) + 1), lambda j: q.v[j] * x.v[j]))"
_COSINE = f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda a: a * a))) AS norm FROM e),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS ordinal, x.label,
  round(CASE WHEN q.norm * x.norm > 0 THEN {_DOT} / (q.norm * x.norm) ELSE 0 END, {DIGITS}) AS score
  FROM n q JOIN n x ON q.vec_id % {QUERY_STEP} = 0 AND FILTER),
dense AS (SELECT query_id, ordinal, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM s QUALIFY rank <= TOP)
"""
_SCORED = "SELECT query_id, ordinal, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM"


def _cosine(top: int, keep: str = "true") -> str:
    return _COSINE.replace("FILTER", keep).replace("TOP", str(top))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "ordinal", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"{_cosine(10)} {_SCORED} dense")
def cosine_topk(spark, sf_dir):
    """An asking vector is in the table too, and finds itself."""
    asked, v = vectors_of(spark, sf_dir)
    return _shown(retrieval.cosine_topk(asked, v, 10, digits=DIGITS))


@query(f"{_cosine(5, 'x.label = 3')} {_SCORED} dense")
def cosine_topk_filtered(spark, sf_dir):
    asked, v = vectors_of(spark, sf_dir)
    return _shown(retrieval.cosine_topk(asked, v, 5, F.col("label") == 3, DIGITS))


_BM25 = f"""
{_TOKENS.replace("t AS", "t0 AS")}, n AS (SELECT count(*) AS n_docs FROM documents),
dl AS (SELECT d.doc_id, d.lang, count(token) AS dl FROM documents d LEFT JOIN t0 USING (doc_id) GROUP BY ALL),
a AS (SELECT avg(dl) AS avgdl FROM dl),
f AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''))) AS token FROM documents) GROUP BY token),
r AS (SELECT token, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM f, n),
i AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
q AS (SELECT item_id AS query_id, token, count(*) AS qf FROM (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS token FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, token, count(*) AS tf FROM t0 GROUP BY ALL),
p AS (SELECT query_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), {DIGITS}) AS score
  FROM q JOIN i USING (token) JOIN tf USING (token) JOIN dl USING (doc_id), a GROUP BY ALL),
s AS (SELECT b.item_id AS query_id, dl.doc_id AS ordinal, coalesce(p.score, 0) AS score FROM benchmark b CROSS JOIN dl LEFT JOIN p ON p.query_id = b.item_id AND p.doc_id = dl.doc_id WHERE FILTER),
sparse AS (SELECT query_id, ordinal, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM s QUALIFY rank <= TOP)
"""


def _bm25(top: int, keep: str = "true") -> str:
    return _BM25.replace("FILTER", keep).replace("TOP", str(top))


@query(
    "WITH n AS (SELECT count(*) AS n_docs FROM documents),"
    " f AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''))) AS token FROM documents) GROUP BY token),"
    " r AS (SELECT token, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM f, n), m AS (SELECT avg(raw) AS mean FROM r)"
    " SELECT token, df, round(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END, 6) AS idf FROM r, m"
)
def bm25_stats(spark, sf_dir):
    return retrieval.Bm25(index_of(spark, sf_dir)).idf().select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_bm25(20)} {_SCORED} sparse")
def bm25_topk(spark, sf_dir):
    return _shown(retrieval.Bm25(index_of(spark, sf_dir)).topk(items_of(spark, sf_dir), 20, digits=DIGITS))


@query(f"""WITH {_bm25(10, "dl.lang = 'es'")} {_SCORED} sparse""")
def bm25_topk_filtered(spark, sf_dir):
    return _shown(retrieval.Bm25(index_of(spark, sf_dir)).topk(items_of(spark, sf_dir), 10, F.col("lang") == "es", DIGITS))


_FUSED = """
b AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.ordinal, s.ordinal) AS ordinal, d.rank AS vrank, s.rank AS brank,
  coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) AS score FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.ordinal = s.ordinal),
fused AS (SELECT query_id, ordinal, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vrank IS NULL, coalesce(vrank, brank)) AS rank FROM b QUALIFY rank <= 10)
"""
_BOTH = _cosine(20).replace(" n AS", " nn AS").replace("FROM n q JOIN n x", "FROM nn q JOIN nn x").replace("\ns AS", "\ns0 AS").replace("FROM s QUALIFY", "FROM s0 QUALIFY").replace("\nn AS", "\nnn AS").replace("q.vec_id AS query_id", f"q.vec_id // {QUERY_STEP} AS query_id")


@query(f"{_BOTH}, {_bm25(20)}, {_FUSED} {_SCORED} fused")
def hybrid_topk(spark, sf_dir):
    """The n-th asking vector, counted by id from 0, asks for the benchmark item n; items beyond have no vector."""
    asked, v = vectors_of(spark, sf_dir)
    asked = asked.withColumn("query_id", F.expr(f"query_id div {QUERY_STEP}"))
    dense = retrieval.cosine_topk(asked, v, 20, digits=DIGITS)
    sparse = retrieval.Bm25(index_of(spark, sf_dir)).topk(items_of(spark, sf_dir), 20, digits=DIGITS)
    return _shown(retrieval.fuse(dense, sparse, 10).withColumn("score", F.col("combined_score")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_topk(spark, sf_dir)


# metrics ----------------------------------------------------------------------------------

_QRELS = f", q AS (SELECT vec_id, label FROM e WHERE vec_id % {QUERY_STEP} = 0), rel AS (SELECT q.vec_id AS query_id, e.vec_id AS ordinal FROM q JOIN e USING (label) WHERE e.vec_id <> q.vec_id)"
_PER_K = f"""{_cosine(10, "x.vec_id <> q.vec_id")}{_QRELS},
h AS (SELECT d.query_id, d.rank, CAST(rel.ordinal IS NOT NULL AS INT) AS r FROM dense d LEFT JOIN rel ON rel.query_id = d.query_id AND rel.ordinal = d.ordinal),
tot AS (SELECT query_id, (SELECT count(*) FROM rel WHERE rel.query_id = z.query_id) AS total FROM (SELECT DISTINCT query_id FROM h) z),
k AS (SELECT unnest([1, 3, 5, 10]) AS k),
c AS (SELECT tot.query_id, k, total, CAST(sum(r) FILTER (rank <= k) AS DOUBLE) AS hits, count(*) FILTER (rank <= k) AS n FROM h JOIN tot USING (query_id), k GROUP BY ALL),
pr AS (SELECT query_id, k, hits / n AS precision, CASE WHEN total = 0 THEN 1 ELSE hits / total END AS recall FROM c),
per_k AS (SELECT *, CASE WHEN precision + recall < 1e-10 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr),
cum AS (SELECT *, sum(r) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM h),
per_q AS (SELECT query_id, coalesce(1.0 / min(rank) FILTER (r = 1), 0) AS rr, CASE WHEN total = 0 THEN 1 ELSE coalesce(sum(seen / CAST(rank AS DOUBLE)) FILTER (r = 1), 0) / total END AS ap, total AS num_relevant FROM cum JOIN tot USING (query_id) GROUP BY query_id, total)
"""


def _run(spark, sf_dir):
    """The ten nearest others of every asking vector: a vector is neither a hit nor relevant for itself."""
    asked, v = vectors_of(spark, sf_dir)
    others = F.col("ordinal") != F.col("query_id")
    run = retrieval.cosine_topk(asked, v, 11, digits=DIGITS).where(others)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    run = written(run.select("query_id", F.col("ordinal").alias("chunk_id"), place.alias("rank")).where("rank <= 10"))  # all metrics are of one search
    # pairs that were found, and counts, in place of every pair of one label
    labels = asked.select("query_id", "label")
    own = labels.join(v.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("total")), "label").select("query_id", "total")
    near = v.select(F.col("ordinal").alias("chunk_id"), F.col("label").alias("theirs"))
    qrels = run.join(labels, "query_id").join(near, "chunk_id").where("label = theirs")
    return run, qrels.select("query_id", "chunk_id", F.lit(2).alias("relevance_score")), own


@query(f"{_PER_K} SELECT query_id, CAST(k AS BIGINT) AS k, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM per_k")
def metrics_at_k(spark, sf_dir):
    return _at_k(*_run(spark, sf_dir))


def _at_k(run, qrels, totals=None):
    out = metrics.at_k(run, qrels, totals=totals)
    return out.select("query_id", F.col("k").cast("long").alias("k"), *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"{_PER_K} SELECT query_id, round(rr, 9) AS reciprocal_rank, round(ap, 9) AS average_precision, CAST(num_relevant AS BIGINT) AS num_relevant FROM per_q")
def reciprocal_rank_and_average_precision(spark, sf_dir):
    return _by_rank(*_run(spark, sf_dir))


def _by_rank(run, qrels, totals=None):
    out = metrics.by_rank(run, qrels, totals=totals)
    return out.select("query_id", F.round("reciprocal_rank", 9).alias("reciprocal_rank"), F.round("average_precision", 9).alias("average_precision"), F.col("num_relevant").cast("long").alias("num_relevant"))


def _overall_sql(middle: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{m}@' || k AS metric, {middle.replace('X', m)} AS value FROM per_k GROUP BY k" for m in ("precision", "recall", "f1"))
    tail = "SELECT 'mrr', avg(rr) FROM per_q UNION ALL SELECT 'map', avg(ap) FROM per_q UNION ALL SELECT 'overall_precision', avg(precision) FROM per_k WHERE k = 10 UNION ALL SELECT 'overall_recall', avg(recall) FROM per_k WHERE k = 10"
    return f"{_PER_K} SELECT metric, round(value, 9) AS value FROM ({each} UNION ALL {tail})"


def _overall(how, run, qrels, totals=None):
    return metrics.overall(metrics.at_k(run, qrels, totals=totals), metrics.by_rank(run, qrels, totals=totals), how).select("metric", F.round("value", 9).alias("value"))


@query(_overall_sql("avg(X)"))
def overall_mean(spark, sf_dir):
    return _overall("mean", *_run(spark, sf_dir))


@query(_overall_sql("list_sort(list(X))[len(list(X)) // 2 + 1]"))
def overall_median(spark, sf_dir):
    return _overall("median", *_run(spark, sf_dir))


# names ------------------------------------------------------------------------------------

_ACTS = "SELECT doc_id, 'The ' || upper(source[1]) || source[2:] || '  Act (Cth) ' || (1990 + doc_id % 30) AS name FROM documents"


@query(f"WITH a AS ({_ACTS}) SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '\\((?:Cth|Vic)\\)', ' ', 'g'), '(?i)\\bthe\\b', ' ', 'g'), '\\s+', ' ', 'g'))) AS act FROM a")
def normalise_act_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("The "), F.upper(F.substring("source", 1, 1)), F.substring("source", 2, 99), F.lit("  Act (Cth) "), (1990 + F.col("doc_id") % 30).cast("string"))
    return d.select("doc_id", normal_act(name).alias("act"))


@query(
    "WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant'))"
    " SELECT conv_id, turn, role, text FROM c WHERE back <= 6"
)
def recent_history(spark, sf_dir):
    from quernlex.operators.answers import recent_turns

    return recent_turns(table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")), 3)


@query(
    f"""{_cosine(5, "x.vec_id <> q.vec_id")}, p AS (SELECT e.vec_id AS query_id, min(d.rank) FILTER (d.label = e.label) AS first FROM e LEFT JOIN dense d ON d.query_id = e.vec_id WHERE e.vec_id % {QUERY_STEP} = 0 GROUP BY ALL)
    SELECT round(avg(CAST(coalesce(first <= 1, false) AS INT)), 3) AS hit_1, round(avg(CAST(coalesce(first <= 3, false) AS INT)), 3) AS hit_3, count(*) AS n FROM p"""
)
def routing_probe(spark, sf_dir):
    """Whether the others nearest to each asking vector are of its label, which stands for the document expected."""
    asked, v = vectors_of(spark, sf_dir)
    found = retrieval.cosine_topk(asked, v, 6, digits=DIGITS).where("ordinal <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    found = found.select("query_id", "ordinal", place.alias("rank")).where("rank <= 5")
    results = found.join(v.select("ordinal", F.col("label").cast("string").alias("document_name")), "ordinal")
    return metrics.routing(results, asked.select("query_id", F.col("label").cast("string").alias("expected_document")))
