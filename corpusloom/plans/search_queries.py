"""Queries of retrieval, near-duplicate joins, metrics, trees and rounds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from corpusloom.functions import prompts as PR
from corpusloom.functions import text as T
from corpusloom.operators import inference as I
from corpusloom.operators import metrics as M
from corpusloom.operators import reshape as R
from corpusloom.operators import selection as SEL
from corpusloom.operators import similarity as S
from corpusloom.operators import trees as TR
from corpusloom.plans import rounds
from corpusloom.plans.select_queries import PAIRS, pairs, table
from corpusloom.plans.text_queries import WORDS, docs
from corpusloom.sources import corpora

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


COSINE = "round(list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 6)"


@query(f"""
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {COSINE} AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 25 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM s)
SELECT query_id, item_id, score, 6 - r AS pos FROM r WHERE r <= 5
""")
def cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return S.dense_top_k(e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), 5)


@query(f"""
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {COSINE} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM s)
SELECT query_id, item_id, score, 6 - r AS pos FROM r WHERE r <= 5
""")
def knn_exclude_self(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return S.dense_top_k(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), 5, exclude_self=True)


LOWER = WORDS.replace("text", "lower(text)")


def bm25_sql(okapi: bool) -> str:
    ratio = "(n - df + 0.5) / (df + 0.5)"
    idf = (
        f"SELECT term, CASE WHEN ln({ratio}) < 0 THEN 0.25 * avg(ln({ratio})) OVER () ELSE ln({ratio}) END AS idf, avgdl FROM df CROSS JOIN stats"
        if okapi
        else f"SELECT term, ln(greatest(1.0, {ratio})) AS idf, avgdl FROM df CROSS JOIN stats"
    )
    b = 0.75 if okapi else 0.7
    gain = f"tf * {2.5 if okapi else 1.0} / (tf + 1.5 * (1 - {b} + {b} * dl / avgdl))"
    return f"""
WITH p AS (SELECT doc_id AS item_id, {LOWER} AS t FROM documents),
q AS (SELECT item_id AS query_id, {LOWER} AS t FROM benchmark),
post AS (SELECT item_id, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT item_id, len(t) AS dl, unnest(t) AS term FROM p) GROUP BY item_id, dl, term),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS avgdl FROM p),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS ({idf}),
ask AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(t) AS term FROM q) GROUP BY query_id, term),
s AS (SELECT query_id, item_id, round(sum(qtf * idf * {gain}), 6) AS score FROM ask JOIN idf USING (term) JOIN post USING (term) GROUP BY query_id, item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r, count(*) OVER (PARTITION BY query_id) AS c FROM s)
SELECT query_id, item_id, score, least(c, 5) - r + 1 AS pos FROM r WHERE r <= 5
"""


def _tokens(df, id_column, name):
    return df.select(F.col(id_column).alias(name), T.words(F.lower("text")).alias("tokens"))


@query(bm25_sql(False))
def bm25_topk(spark, sf):
    return S.bm25_top_k(_tokens(table(spark, sf, "benchmark"), "item_id", "query_id"), _tokens(docs(spark, sf), "doc_id", "item_id"), 5)


@query(bm25_sql(True))
def bm25_okapi_topk(spark, sf):
    return S.bm25_top_k(_tokens(table(spark, sf, "benchmark"), "item_id", "query_id"), _tokens(docs(spark, sf), "doc_id", "item_id"), 5, b=0.75, okapi=True)


@query("""
WITH t AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
l AS (SELECT a.item_id AS query_id, b.item_id, list_reduce(list_prepend(list_transform(range(0, len(b.w) + 1), lambda i: 0), list_transform(a.w, lambda x: list_transform(b.w, lambda y: CASE WHEN x = y THEN 1 ELSE 0 END))),
  lambda p, e: list_reduce(list_prepend([0], list_transform(range(1, len(e) + 1), lambda j: [j])), lambda d, j: list_append(d, CASE WHEN e[j[1]] = 1 THEN p[j[1]] + 1 ELSE greatest(p[j[1] + 1], d[len(d)]) END))) AS row
  FROM t a JOIN t b ON a.item_id <> b.item_id),
r AS (SELECT query_id, item_id, CAST(row[len(row)] AS BIGINT) AS score, row_number() OVER (PARTITION BY query_id ORDER BY row[len(row)] DESC, item_id) AS r FROM l)
SELECT query_id, item_id, score, 4 - r AS pos FROM r WHERE r <= 3
""")
def lcs_topk(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", T.words_by_space(F.col("text")).alias("tokens"))
    return S.lcs_top_k(t.withColumnRenamed("item_id", "query_id"), t, 3, least=0, exclude_self=True)


@query("")
def lcs_topk_long(spark, sf):
    t = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), T.words(F.col("text")).alias("tokens"))
    return S.lcs_top_k(t, docs(spark, sf).select(F.col("doc_id").alias("item_id"), T.words(F.col("text")).alias("tokens")), 5)


def two_rankings(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    one = b.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("pos")).withColumn("item_id", (F.col("query_id") * 7 + F.col("pos") * 3) % 10)
    two = b.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("pos")).withColumn("item_id", (F.col("query_id") * 5 + F.col("pos") * 7) % 10)
    return one, two


@query("""
WITH one AS (SELECT item_id AS query_id, CAST(p AS BIGINT) AS pos, (item_id * 7 + p * 3) % 10 AS item FROM benchmark, (SELECT unnest([1, 2, 3, 4]) AS p)),
two AS (SELECT item_id AS query_id, CAST(p AS BIGINT) AS pos, (item_id * 5 + p * 7) % 10 AS item FROM benchmark, (SELECT unnest([1, 2, 3, 4]) AS p)),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.item, b.item) AS item_id, a.pos AS p1, b.pos AS p2
  FROM one a FULL OUTER JOIN two b ON a.query_id = b.query_id AND a.item = b.item),
s AS (SELECT query_id, item_id, CAST(coalesce(p1, 0) + coalesce(p2, 0) + CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN 1.5 ELSE 0 END AS DOUBLE) AS score,
  CASE WHEN p2 IS NULL THEN 1 ELSE 0 END AS late, coalesce(p2, p1) AS came FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, late DESC, came DESC, item_id) AS r, count(*) OVER (PARTITION BY query_id) AS c FROM s)
SELECT query_id, item_id, score, least(c, 4) - r + 1 AS pos FROM r WHERE r <= 4
""")
def borda_fusion(spark, sf):
    return S.borda(*two_rankings(spark, sf), 4)


@query("""
WITH a AS (SELECT b.item_id AS query_id, substring(w, 1, 1) AS label FROM benchmark b, unnest(string_split(b.text, ' ')) AS u(w)),
c AS (SELECT b.item_id, substring(w, 1, 1) AS label FROM benchmark b, unnest(string_split(b.text, ' ')) AS u(w)),
ha AS (SELECT query_id, label, count(*) AS m FROM a GROUP BY query_id, label), hc AS (SELECT item_id, label, count(*) AS n FROM c GROUP BY item_id, label),
s AS (SELECT query_id, item_id, CAST(sum(m * n) AS DOUBLE) AS score FROM ha JOIN hc USING (label) GROUP BY query_id, item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM s)
SELECT query_id, item_id, score, 6 - r AS pos FROM r WHERE r <= 5
""")
def histogram_topk(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("w")).select("item_id", F.substring("w", 1, 1).alias("label"))
    return S.histogram_kernel(rows.withColumnRenamed("item_id", "query_id"), rows, 5)


@query("""
WITH i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS number, count(*) OVER () AS n FROM benchmark),
d AS (SELECT item_id AS query_id, CAST(p AS BIGINT) AS pos, (CAST(('0x' || substring(md5('3|' || CAST(item_id AS VARCHAR)), 1, 8)) AS BIGINT) + (p - 1) * 1000000007) % n AS number FROM i, (SELECT unnest([1, 2, 3]) AS p))
SELECT query_id, i.item_id, pos FROM d JOIN i USING (number)
""")
def random_retrieval(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id")
    return S.random_k(b.withColumnRenamed("item_id", "query_id"), b, 3, 3)


@query("""
WITH p AS (SELECT item_id AS query_id, (item_id + p * r) % 7 AS item_id, p AS part, r AS rank FROM benchmark, (SELECT unnest([1, 2, 3]) AS p), (SELECT unnest([1, 2, 3, 4]) AS r)),
b AS (SELECT query_id, item_id, rank, part FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY rank, part) AS i FROM p) WHERE i = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, part, item_id) AS pos FROM b)
SELECT query_id, item_id, pos FROM n WHERE pos <= 4
""")
def structural_interleave(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    p = b.select("query_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("part")).select("query_id", "part", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("rank"))
    return R.interleaved(p.withColumn("item_id", (F.col("query_id") + F.col("part") * F.col("rank")) % 7), "query_id", "item_id", "rank", "part", 4)


@query("")
def rouge_pairs(spark, sf):
    """Pairs between the first documents of equal texts, and every copy with its first."""
    d = docs(spark, sf).select("doc_id", "lang", T.ascii_tokens(F.col("text")).alias("t"))
    return S.near_classes(d, "t", 0.7, "lang")


@query("")
def rouge_greedy(spark, sf):
    d = docs(spark, sf).select("doc_id", "lang", T.ascii_tokens(F.col("text")).alias("t"))
    return S.greedy_unlike(d, "t", 0.7, "lang").select("doc_id", "lang")


def _grams_sql(side: str, most: int) -> str:
    parts = [f"SELECT pair_id, {n} AS n, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i : i + {n - 1}], chr(1)))) AS g FROM (SELECT pair_id, {WORDS.replace('text', side)} AS w FROM p) WHERE len(w) >= {n}" for n in range(1, most + 1)]
    return " UNION ALL ".join(parts)


def _clip_sql(most: int) -> str:
    return f"""h AS (SELECT pair_id, n, g, count(*) AS c FROM ({_grams_sql('target', most)}) GROUP BY pair_id, n, g),
r AS (SELECT pair_id, n, g, count(*) AS c FROM ({_grams_sql('source', most)}) GROUP BY pair_id, n, g),
w AS (SELECT n, CAST(sum(coalesce(h.c, 0)) AS DOUBLE) AS hyp, CAST(sum(coalesce(r.c, 0)) AS DOUBLE) AS ref, CAST(sum(CASE WHEN h.c IS NULL OR r.c IS NULL THEN 0 ELSE least(h.c, r.c) END) AS DOUBLE) AS m
  FROM h FULL OUTER JOIN r USING (pair_id, n, g) GROUP BY n)"""


def mt_pairs(spark, sf):
    """Pairs whose target is an edited source, so that overlaps are not trivial."""
    d = docs(spark, sf)
    return d.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("source"), F.replace(F.col("text"), F.lit(" the "), F.lit(" of the ")).alias("target"))


MT = "p AS (SELECT doc_id AS pair_id, text AS source, replace(text, ' the ', ' of the ') AS target FROM documents)"


@query(f"""
WITH {MT}, {_clip_sql(4)}
SELECT round(CASE WHEN min(m) = 0 THEN 0 ELSE 100 * exp(sum(ln(m / hyp)) / 4 + CASE WHEN max(CASE n WHEN 1 THEN hyp END) >= max(CASE n WHEN 1 THEN ref END) THEN 0 ELSE 1 - max(CASE n WHEN 1 THEN ref END) / max(CASE n WHEN 1 THEN hyp END) END) END, 6) AS bleu FROM w
""")
def bleu_corpus(spark, sf):
    return M.corpus_bleu(mt_pairs(spark, sf), "pair_id", "target", "source").select(F.round("bleu", 6).alias("bleu"))


@query("")  # in SQL all character grams of the corpus would be one table
def chrf_corpus(spark, sf):
    return M.corpus_chrf(mt_pairs(spark, sf), "pair_id", "target", "source").select(F.round("chrf", 6).alias("chrf"))


@query("""
WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, CAST(quality AS DOUBLE) AS v FROM labels), c AS (SELECT count(*) AS c FROM n),
d AS (SELECT b AS resample, CAST(('0x' || substring(md5('122|' || CAST(b AS VARCHAR) || '|' || CAST(i AS VARCHAR)), 1, 8)) AS BIGINT) % c AS row_id FROM (SELECT unnest(range(0, 300)) AS b), (SELECT unnest(range(0, 500)) AS i), c)
SELECT CAST(resample AS BIGINT) AS resample, round(avg(v), 6) AS mean FROM d JOIN n USING (row_id) GROUP BY resample
""")
def bootstrap_means(spark, sf):
    rows = corpora.numbered_rows(table(spark, sf, "labels").withColumn("g", F.lit(1)), ["g"], "doc_id").withColumn("v", F.col("quality").cast("double"))
    return M.bootstrap_means(rows, "row_id", "v", 300, 500, 122).select("resample", F.round("mean", 6).alias("mean"))


@query("""
SELECT lang, count(*) AS n, round(avg(d), 6) AS mean_diff, round(avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0), 6) AS t
FROM (SELECT lang, quality - toxic AS d FROM labels JOIN documents USING (doc_id)) GROUP BY lang
""")
def paired_t(spark, sf):
    j = table(spark, sf, "labels").join(docs(spark, sf).select("doc_id", "lang"), "doc_id")
    return M.paired_t(j, "quality", "toxic", ["lang"]).select("lang", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("t", 6).alias("t"))


CANDS = "c AS (SELECT item_id // 4 AS g, item_id % 4 AS pos, CASE item_id % 4 WHEN 3 THEN ' ' ELSE text END AS text FROM benchmark)".replace("item_id // 4", "CAST(floor(item_id / 4) AS BIGINT)")


def candidates(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(F.floor(F.col("item_id") / 4).alias("g"), (F.col("item_id") % 4).alias("pos"), F.when(F.col("item_id") % 4 == 3, " ").otherwise(F.col("text")).alias("text"))


@query(f"""
WITH {CANDS}, w AS (SELECT g, pos, {WORDS} AS w FROM c),
grams AS (SELECT g, pos, n, gram, count(*) AS c FROM (SELECT g, pos, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], chr(1)))) AS gram
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n) GROUP BY g, pos, n, gram),
met AS (SELECT a.g, a.pos AS i, b.pos AS j, a.n, sum(least(a.c, b.c)) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.n = b.n AND a.gram = b.gram AND a.pos <> b.pos GROUP BY a.g, a.pos, b.pos, a.n),
asked AS (SELECT a.g, a.pos AS i, b.pos AS j, len(a.w) AS ref, len(b.w) AS hyp, n FROM w a JOIN w b ON a.g = b.g AND a.pos <> b.pos, (SELECT unnest([1, 2, 3, 4]) AS n)),
found AS (SELECT asked.*, coalesce(m, 0) AS m, sum(CASE WHEN coalesce(m, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY asked.g, asked.i, asked.j ORDER BY asked.n) AS missed
  FROM asked LEFT JOIN met ON met.g = asked.g AND met.i = asked.i AND met.j = asked.j AND met.n = asked.n),
bleu AS (SELECT g, i, j, CASE WHEN min(hyp) < 4 OR max(CASE n WHEN 1 THEN m END) = 0 THEN 0
  ELSE 100 * exp(sum(ln(CASE WHEN m = 0 THEN pow(0.5, missed) ELSE m END / greatest(hyp - n + 1, 1))) / 4 + CASE WHEN min(hyp) >= min(ref) THEN 0 ELSE 1 - min(ref) / min(hyp) END) END AS b FROM found GROUP BY g, i, j),
s AS (SELECT g, i AS pos, round(sum(b), 6) AS score FROM bleu GROUP BY g, i),
r AS (SELECT s.g, s.pos, c.text, row_number() OVER (PARTITION BY s.g ORDER BY CASE WHEN trim(c.text) = '' THEN 1 ELSE 0 END, s.score DESC, s.pos) AS r FROM s JOIN c ON c.g = s.g AND c.pos = s.pos)
SELECT g, pos, CASE WHEN trim(text) = '' THEN '' ELSE text END AS text FROM r WHERE r = 1
""")
def mbr_select(spark, sf):
    c = candidates(spark, sf)
    return M.best_candidate(c.join(M.mutual_scores(c, "g", "pos", "text"), ["g", "pos"]), "g", F.col("score"), "pos", "text")


@query(f"""
WITH {CANDS}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY CASE WHEN trim(text) = '' THEN 1 ELSE 0 END, CASE WHEN text LIKE '%the%' THEN length(text) ELSE 0 END DESC, pos) AS r FROM c)
SELECT g, pos, CASE WHEN trim(text) = '' THEN '' ELSE text END AS text FROM r WHERE r = 1
""")
def qe_select(spark, sf):
    """Argmax of language check times quality score."""
    c = candidates(spark, sf)
    return M.best_candidate(c, "g", F.when(F.contains("text", F.lit("the")), F.length("text")).otherwise(0).cast("double"), "pos", "text")


def series(spark):
    rows = [(lang, [float((i * k) % 11) + k / 10 for i in range(1, 6)], [float((i * (k + 2)) % 7) for i in range(1, 6)]) for k, lang in enumerate(["a", "b", "c"], 1)]
    return spark.createDataFrame(rows, T_.StructType([T_.StructField("language", T_.StringType()), T_.StructField("bleu", T_.ArrayType(T_.DoubleType())), T_.StructField("metricx", T_.ArrayType(T_.DoubleType()))]))


SERIES = """s AS (SELECT language, 'bleu' AS metric, i AS step, CAST((i * k) % 11 AS DOUBLE) + k / 10.0 AS value FROM (VALUES ('a', 1), ('b', 2), ('c', 3)) v(language, k), (SELECT unnest([1, 2, 3, 4, 5]) AS i)
  UNION ALL SELECT language, 'metricx', i, CAST((i * (k + 2)) % 7 AS DOUBLE) FROM (VALUES ('a', 1), ('b', 2), ('c', 3)) v(language, k), (SELECT unnest([1, 2, 3, 4, 5]) AS i))"""


@query(f"WITH {SERIES} SELECT language, metric, step, CAST(value AS DOUBLE) AS value FROM s")
def metric_long(spark, sf):
    return R.long_series(series(spark), ["language"], ["bleu", "metricx"])


@query(f"""
WITH {SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY language, metric ORDER BY CASE metric WHEN 'metricx' THEN value ELSE -value END, step) AS r FROM s)
SELECT language, metric, step, CAST(value AS DOUBLE) AS value FROM r WHERE r = 1
""")
def best_checkpoint(spark, sf):
    long = R.long_series(series(spark), ["language"], ["bleu", "metricx"])
    return SEL.best_by(long, ["language", "metric"], "value", F.col("metric") == "metricx", ["step"])


@query("")
def vendi_score(spark, sf):
    e = table(spark, sf, "embeddings")
    return spark.createDataFrame([(M.vendi(e, "embedding"),)], "vendi double")


@query("""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
a AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS p FROM s),
b AS (SELECT doc_id, p, unnest(string_split(t, '. ')) AS t, generate_subscripts(string_split(t, '. '), 1) - 1 AS q FROM a)
SELECT CAST(doc_id AS VARCHAR) || '.' || CAST(p AS VARCHAR) || '.' || CAST(q AS VARCHAR) AS node_id, CAST(doc_id AS VARCHAR) || '.' || CAST(p AS VARCHAR) AS parent_id, CAST(doc_id AS VARCHAR) AS root_id, t AS text FROM b
""")
def tree_root(spark, sf):
    splits = iter([lambda c: F.split(c, "\n"), lambda c: F.split(c, r"\. ")])
    nodes = TR.decompose(TR.roots(docs(spark, sf), "doc_id"), lambda c: next(splits)(c), 2)
    return nodes.where("level = 2").select("node_id", "parent_id", "root_id", "text")


@query("""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS root_id, array_to_string(list_transform(list_filter(l, lambda x: trim(x) <> ''), lambda x: lower(x)), ' ') AS result FROM s
""")
def tree_merge(spark, sf):
    nodes = TR.decompose(TR.roots(docs(spark, sf), "doc_id"), lambda c: F.split(c, "\n"), 1)
    return TR.merge_up(nodes, lambda c: F.lower(c), lambda text, parts, results: F.array_join(results, " "), 1)


@query("SELECT DISTINCT 'Translate:' || chr(10) || lang AS prompt, sha256('Translate:' || chr(10) || lang) AS prompt_hash, lang AS candidate FROM documents")
def generate_echo(spark, sf):
    out = I.generate(docs(spark, sf).select(F.concat(F.lit("Translate:\n"), F.col("lang")).alias("prompt")), "prompt")
    return out.select("prompt", "prompt_hash", F.get("candidates", F.lit(0)).alias("candidate"))


@query("")
def pipeline_round(spark, sf):
    """One round over documents as kept texts, with numbered answers made of other documents."""
    d = docs(spark, sf)
    kept = d.where("doc_id % 2 = 0").select(F.col("lang").alias("language"), "text")
    lines = F.slice(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 20), 1, 2)
    seeds = d.where("doc_id % 2 = 1").select(F.col("lang").alias("language"), F.col("source").alias("topic"), PR.numbered(lines).alias("answer"))

    return rounds.new_paragraphs(seeds, kept, F.concat(F.lit("Write:\n"), F.col("answer")), 2, factory=ListBackend)


class ListBackend(I.EchoBackend):
    """Answers with everything after the first line of the prompt."""

    def generate(self, prompts, sampling):
        return [[p.split("\n", 1)[-1]] for p in prompts]


@query("")
def back_translation(spark, sf):
    d = docs(spark, sf).select("doc_id", "text")
    return rounds.back_translations(d, "doc_id", F.lit(True), F.lit(True))


@query(f"WITH {PAIRS} SELECT pair_id, CASE WHEN length(source) > length(target) THEN 'A' WHEN length(source) < length(target) THEN 'B' ELSE 'TIE' END AS winner FROM p")
def ensemble_pairs(spark, sf):
    """The better of two strategies per row, by score."""
    p = pairs(spark, sf)
    return p.select("pair_id", F.when(F.length("source") > F.length("target"), "A").when(F.length("source") < F.length("target"), "B").otherwise("TIE").alias("winner"))


@query("""
WITH r AS (SELECT doc_id, 'L' || CAST(doc_id % 3 AS VARCHAR) AS src, doc_id % 5 AS k, doc_id % 2 AS depth FROM documents)
SELECT src, CAST(k AS INTEGER) AS k, CAST(min(depth) AS INTEGER) AS depth_a, CAST(max(depth) AS INTEGER) AS depth_b FROM r GROUP BY src, k HAVING count(DISTINCT depth) = 2
""")
def run_pairing(spark, sf):
    d = docs(spark, sf)
    name = F.concat(F.lit("L"), (F.col("doc_id") % 3).cast("string"), F.lit("_to_English_"), (F.col("doc_id") % 5).cast("string"), F.lit("_shot_seed_122_llm_vanilla_0_"), (F.col("doc_id") % 2).cast("string"), F.lit("_0"))
    return corpora.paired_runs(corpora.run_settings(d.select(name.alias("name"))), ["src", "k"], "depth")
