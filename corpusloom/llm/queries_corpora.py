"""Queries on whole corpora against benchmarks, spellings and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.decontaminate import contaminated
from corpusloom.llm.prefix_trie import prefix_trie, prefixes, share_heads
from corpusloom.llm.spellings import count_words, spelling_forms


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of seven letters or more that occur twice; one word in 31 is misspelt on purpose."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spelling_forms(count_words(docs, least=7, drop_one_in=31).where("n >= 2"), ratio=10)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold ten consecutive words of a benchmark item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contaminated(docs, items, length=10)
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def _words_sql(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP12_SQL = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS size
  FROM (SELECT item_id, {_words_sql("text")} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS i FROM items)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_words_sql("text")}, []) AS w FROM documents),
places AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
        FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
hits AS (SELECT r, i, size, item FROM places JOIN windows USING (size, words)),
hit_words AS (
  SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS k FROM hits) GROUP BY r),
hit_items AS (
  SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(a.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(b.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(b.items, '')) AS items_sha256, coalesce(a.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words a USING (r) LEFT JOIN hit_items b USING (r)
"""



def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each with up to five first turns of the conversation that leads its hundred."""
    turns = prefixes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    members, convs = share_heads(turns, head, F.col("conv_id") - F.col("conv_id") % 100, most=5)
    return prefix_trie(members, convs).drop("k1", "k2")


def _crc32_sql(data: str) -> str:
    """CRC-32 of a BLOB, bit by bit."""
    one_byte = f"(16 * (strpos('0123456789ABCDEF', substr(hex({data}), 2 * k - 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(hex({data}), 2 * k, 1)) - 1)"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(range(1, octet_length({data}) + 1), lambda k: {one_byte})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {bits}), 4294967295)"


OP13_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos, role, text
  FROM said),
own AS (SELECT conv_id, {_crc32_sql("encode(CAST(conv_id AS VARCHAR))")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT o.conv_id, t.pos AS place, 0 AS later, t.role, t.text FROM own o JOIN turns t ON t.conv_id = o.conv_id - o.conv_id % 100 AND t.pos <= o.h
  UNION ALL
  SELECT o.conv_id, t.pos, 1, t.role, t.text FROM own o JOIN turns t ON t.conv_id = o.conv_id AND t.pos > o.h),
placed AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS n,
         sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER w) AS node
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY later, place ROWS UNBOUNDED PRECEDING)),
members AS (
  SELECT conv_id, depth, n, node, lag(node, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM placed
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM own),
sizes AS (SELECT conv_id, max(depth) AS depth FROM members GROUP BY 1),
nodes AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(n) AS n, min(parent) AS parent FROM members GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
below AS (
  SELECT m.node, sum((c.node IS NULL)::BIGINT) AS n_leaves, sum((x.n_convs - 1) * x.n) AS saved_tokens
  FROM nodes x JOIN members m ON m.conv_id = x.conv_id AND m.depth <= x.depth LEFT JOIN children c ON c.node = x.node GROUP BY 1),
ends AS (
  SELECT m.node, string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) AS ids FROM members m JOIN sizes s USING (conv_id, depth) GROUP BY 1)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(x.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes x JOIN below b USING (node) LEFT JOIN nodes p ON p.node = x.parent LEFT JOIN children c ON c.node = x.node LEFT JOIN ends e ON e.node = x.node
"""

OP11_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT *, {_crc32_sql("encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM counted),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
less AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, w.word FROM less a JOIN words w ON a.d = w.word
  UNION SELECT w.word, a.word FROM less a JOIN words w ON a.d = w.word),
best AS (
  SELECT r.word, count(*) AS n_near, first(near ORDER BY w.n DESC, near) AS near, max(w.n) AS near_n FROM near r JOIN words w ON w.word = r.near GROUP BY 1),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, word AS last FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.last AS root FROM chain c JOIN forms f ON f.word = c.last WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

QUERIES = {"op11_spelling_groups": op11_spelling_groups, "op12_decontamination": op12_decontamination, "op13_prefix_trie": op13_prefix_trie}
ORACLES = {"op11_spelling_groups": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_prefix_trie": OP13_SQL}
