"""Queries of the operators that stay inside DataFrame functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.fingerprints import compare_edited
from corpusloom.llm.licenses import COPYRIGHT_LINE, KNOWN, SPELLINGS, scan_licenses
from corpusloom.llm.mixing import mix_sources


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every whole document and of its header lines."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _canonical_lines_sql(text: str) -> str:
    out = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13), 'abcdefghijklmnopqrstuvwxyz' || chr(10))"
    for pattern, instead in [(COPYRIGHT_LINE, ""), *SPELLINGS, ("[^a-z0-9\\n]+", " ")]:
        out = f"regexp_replace({out}, '{pattern}', '{instead}', 'g')"
    return out


def _canonical_sql(text: str) -> str:
    return f"trim(regexp_replace({_canonical_lines_sql(text)}, '[ \\n]+', ' ', 'g'))"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP3_SQL = f"""
WITH known AS (
  SELECT md5({_canonical_sql("body")}) AS digest, min(license) AS license
  FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(c)})" for a, _, c in KNOWN)}) v(license, body) GROUP BY 1),
docs AS (SELECT doc_id, text, md5({_canonical_sql("text")}) AS digest FROM documents),
lines AS (SELECT doc_id, trim(unnest(string_split({_canonical_lines_sql("text")}, chr(10)))) AS line FROM documents),
hits AS (
  SELECT l.doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS header_licenses, count(*) AS n
  FROM lines l JOIN known k ON k.digest = md5(l.line) GROUP BY l.doc_id)
SELECT d.doc_id, d.digest, k.license AS text_license, coalesce(h.header_licenses, '') AS header_licenses,
       CAST(coalesce(h.n, 0) AS BIGINT) AS n_header_lines
FROM docs d LEFT JOIN known k ON k.digest = d.digest LEFT JOIN hits h ON h.doc_id = d.doc_id
"""


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its share of the mix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP9_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix|' || CAST(doc_id AS VARCHAR)) AS turn
  FROM documents),
totals AS (
  SELECT source, sum(size) AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT source, source_size, 3.0 * source_size AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
chosen AS (SELECT max(level) AS level FROM levels),
targets AS (
  SELECT r.source, CAST(source_size AS BIGINT) AS source_size,
         CAST(least(cap, c.level * w) AS DOUBLE) AS target
  FROM ranked r CROSS JOIN chosen c),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS whole FROM targets),
ordered AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.whole,
         greatest(r.target - r.whole * r.source_size, 0) AS goal,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.turn, s.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN goal > 0 AND upto - size / 2.0 <= goal THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(CASE WHEN size = 0 THEN 0
                 ELSE whole + CASE WHEN goal > 0 AND upto - size / 2.0 <= goal THEN 1 ELSE 0 END END AS INTEGER) AS copies
FROM ordered
"""

QUERIES = {"op3_license_scan": op3_license_scan, "op8_fingerprints": op8_fingerprints, "op9_source_mix": op9_source_mix}
ORACLES = {"op3_license_scan": OP3_SQL, "op9_source_mix": OP9_SQL}
