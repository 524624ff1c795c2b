"""The registered corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.chunk_dedup import chunk_dedup
from loomgrid.llm.decontamination import contaminated, find_contamination
from loomgrid.llm.exact_dedup import exact_dedup
from loomgrid.llm.line_dedup import line_dedup, sha256_hex
from loomgrid.llm.neardup import near_duplicates
from loomgrid.llm.packing import pack_documents
from loomgrid.llm.quality import score_quality
from loomgrid.llm.suffix_dedup import suffix_dedup
from loomgrid.llm.toxicity import toxicity
from loomgrid.llm.url_filter import judge_urls, junk_outcome


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table labels pages, so a page's outcome is read off its own text (junk_outcome)."""
    return judge_urls(_read(spark, sf_dir, "pages"), junk_outcome(F.col("html")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, contaminated().alias("contaminated"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return scored.drop("row_key").select("*", held.alias("held_out"), F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_read(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_dedup(_read(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_read(spark, sf_dir, "documents"))
    return out.mapInArrow(sha256_hex, "doc_id long, kept_sha256 string, n_lines long, n_dropped long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_packing": op2_packing,
        "op3_decontamination": op3_decontamination,
        "op4_quality": op4_quality,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_toxicity": op6_toxicity,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_chunk_dedup": op9_chunk_dedup,
        "op10_line_dedup": op10_line_dedup,
    }


#: DuckDB forms of the white space the contracts name.
_WS = r"[\x20\x09-\x0D]"

_RULES_SQL = """CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN '{www}'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN '{example}'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN '{es}'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN '{fr}'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN '{com}'
  END"""


def _strength_sql(units: str, name: str) -> str:
    v = "(x / w) * (1 - x / w)"
    scale = f"({v}) * (w - q / w - k + 1)"
    rho = f"CASE WHEN {scale} > 0 THEN (y - w * (x / w) * (x / w) - ({v}) * (k - 1)) / ({scale}) ELSE 0.0 END"
    return f"""{name} AS (SELECT (1 - r) / r AS m FROM (SELECT least(greatest({rho}, 1 / 1001.0::DOUBLE), 1 / 2.0::DOUBLE) AS r FROM (
  SELECT sum(n)::DOUBLE AS w, sum(bad)::DOUBLE AS x, sum(n * n)::DOUBLE AS q, count(*)::DOUBLE AS k, sum(bad * bad / n::DOUBLE) AS y FROM {units} WHERE n > 0)))"""


_OP1 = f"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    CASE WHEN html IS NULL THEN NULL WHEN len(regexp_extract_all(html, '[%*#$]{{3}}')) * 20 > length(html) - length(replace(html, ' ', '')) THEN 1 ELSE 0 END AS bad
  FROM pages
), h AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM u GROUP BY host
), d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix
), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix
), a AS (SELECT coalesce(sum(bad) / sum(n)::DOUBLE, 0.5) AS p0 FROM s),
{_strength_sql("s", "ms")}, {_strength_sql("d", "md")}, {_strength_sql("h", "mh")},
ps AS (SELECT suffix, (bad + coalesce((SELECT m FROM ms), 1.0) * (SELECT p0 FROM a)) / (n + coalesce((SELECT m FROM ms), 1.0)) AS p FROM s),
pd AS (SELECT domain, (bad + coalesce((SELECT m FROM md), 1.0) * ps.p) / (n + coalesce((SELECT m FROM md), 1.0)) AS p FROM d JOIN ps USING (suffix)),
ph AS (SELECT host, n + coalesce((SELECT m FROM mh), 1.0) AS m, (bad + coalesce((SELECT m FROM mh), 1.0) * pd.p) / (n + coalesce((SELECT m FROM mh), 1.0)) AS p FROM h JOIN pd USING (domain)),
r AS (SELECT host, round(p, 6) AS bad_mean, round(greatest(0.0, p - 1.64 * sqrt(p * (1 - p) / (m + 1))), 6) AS bad_low FROM ph)
SELECT page_id, host, path,
  {_RULES_SQL.format(www="www.example.com/en/", example="example.com/en/", es="net/es/", fr="net/fr/", com="com/")} AS rule,
  coalesce({_RULES_SQL.format(www="allow", example="block", es="block", fr="block", com="allow")}, CASE WHEN bad_low > 0.25 THEN 'block' ELSE 'allow' END) AS verdict,
  bad_mean, bad_low
FROM u JOIN r USING (host)
"""

_OP7 = rf"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_WS}', '', 'g')) AS h FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_OP3 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, hash(array_to_string(w[i:i + least(len(w), 13) - 1], ' ')) AS h
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw), dw AS (
  SELECT doc_id, i, k, hash(array_to_string(w[i:i + k - 1], ' ')) AS h
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), hits AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.h = bw.h AND dw.k = bw.k
), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP10 = rf"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), r AS (
  SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT l.doc_id, i, line, r.k IS NOT NULL AND l.doc_id <> r.keep AS gone FROM l LEFT JOIN r ON l.k = r.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _OP1, "op3_decontamination": _OP3, "op7_exact_dedup": _OP7, "op10_line_dedup": _OP10}
