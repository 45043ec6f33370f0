"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlex.llm.exact import exact_dedup
from quernlex.llm.language import languages
from quernlex.llm.licenses import scan_licenses
from quernlex.llm.minhash import near_duplicates
from quernlex.llm.mixing import mix
from quernlex.llm.repeats import substring_dedup, suffix_array_dedup
from quernlex.llm.tokens import token_counts
from quernlex.llm.toxicity import toxicity
from quernlex.llm.wumanber import contamination
from quernlex.session import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), stays="largest")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("removed")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    similar = F.array_join(F.array_sort(F.array_distinct(F.transform("pairs", lambda x: x["label"]))), ",")
    return found.withColumns({"n_pairs": F.size("pairs").cast("long"), "pair_labels": similar}).drop("blocks", "pairs")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_array_dedup,
        op2_exact_dedup,
        op3_substring_dedup,
        op4_minhash_near_dedup,
        op5_token_counts,
        op6_toxicity,
        op7_mixing,
        op8_language_id,
        op9_decontamination,
        op10_license_scan,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op3_substring_dedup": OP3, "op9_decontamination": OP9}


OP2 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM g),
l AS (SELECT doc_id, s FROM h QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM l),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT doc_id, count(*) AS n_words, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY u.i) FILTER (gone.i IS NULL) AS kept FROM u LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT item, least(8, len(w)) AS m, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS s, w FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item, m, array_to_string(w[s:s + m - 1], ' ') AS k FROM p),
g AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS s, w FROM d, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m),
o AS (SELECT doc_id, s, g.m AS m, item FROM g JOIN pat ON pat.m = g.m AND pat.k = array_to_string(g.w[s:s + g.m - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS i FROM o) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
