"""Queries of gates, splitters and parsers over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import parsers as P
from corpusloom.functions import text as T
from corpusloom.operators import gates as G

QUERIES: dict = {}
ORACLES: dict = {}
STOP_WORDS = ["the", "and", "for", "with", "that", "this", "was", "are", "from", "les", "des", "que", "und", "der", "die", "das", "los", "las", "una"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


WS = r"[ \t\n\x0B\f\r]"
WORDS = rf"list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def answers(df: DataFrame) -> DataFrame:
    """Numbered answers made of the lines of documents: a stand-in for model output."""
    lines = F.slice(F.filter(F.split("text", "\n"), lambda x: x != ""), 1, 4)
    body = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return df.select("doc_id", F.concat(F.lit("Here they are\n"), body).alias("answer"), F.size(lines).alias("n_lines"))


ANSWERS = """answers AS (
  SELECT doc_id, 'Here they are' || chr(10) || array_to_string(list_transform(range(1, len(l) + 1), lambda i: CAST(i AS VARCHAR) || '. ' || l[i]), chr(10)) AS answer, len(l) AS n_lines
  FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '')[1:4] AS l FROM documents))"""


@query("SELECT doc_id, len(string_split(text, ' ')) AS n_words FROM documents WHERE len(string_split(text, ' ')) > 2")
def gate_words(spark, sf):
    return G.word_gate(docs(spark, sf)).select("doc_id", F.size(T.words_by_space(F.col("text"))).cast("long").alias("n_words"))


@query(f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
c AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, g, count(*) AS n FROM b GROUP BY doc_id, g) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS top, coalesce(c.n, 0) < 75 AS passes FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id
""")
def gate_bigram(spark, sf):
    n = G.bigram_count(F.col("text")).cast("long")
    return docs(spark, sf).select("doc_id", n.alias("top")).withColumn("passes", F.col("top") < T.REPEAT_LIMIT)


@query("""
WITH s AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents),
l AS (SELECT doc_id, w FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, pos) AS r FROM s) WHERE r = 1),
b AS (SELECT doc_id, unnest(list_transform(range(1, length(w)), lambda i: substring(w, i, 2))) AS g FROM l WHERE length(w) > 1),
c AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, g, count(*) AS n FROM b GROUP BY doc_id, g) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS top, coalesce(c.n, 0) < 75 AS passes FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id
""")
def gate_charbigram(spark, sf):
    return docs(spark, sf).select("doc_id", G.char_bigram_count(F.col("text")).cast("long").alias("top")).withColumn("passes", F.col("top") < T.REPEAT_LIMIT)


@query("""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents),
l AS (SELECT * FROM w WHERE length(w) >= 5),
c AS (SELECT doc_id, w, count(*) AS n FROM l GROUP BY doc_id, w),
t AS (SELECT doc_id, max(n) AS top FROM c GROUP BY doc_id),
o AS (SELECT l.doc_id, l.w, l.pos, c.n FROM l JOIN c ON c.doc_id = l.doc_id AND c.w = l.w JOIN t ON t.doc_id = l.doc_id WHERE c.n * t.top >= 150),
p AS (SELECT a.doc_id, a.w AS x, b.w AS y, count(*) AS n FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.pos < b.pos WHERE a.n * b.n >= 150 GROUP BY a.doc_id, a.w, b.w),
m AS (SELECT doc_id, max(n) AS n FROM p WHERE n >= 150 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(m.n, 0) AS BIGINT) AS top, m.n IS NULL AS passes FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id
""")
def gate_pairs(spark, sf):
    return docs(spark, sf).select("doc_id", T.highest_pair_count(F.col("text")).alias("top")).withColumn("passes", F.col("top") == 0)


@query("SELECT doc_id, replace(replace('<text 1>' || text || '<text 2>', '<text 1>', ''), '<text 2>', '') AS text FROM documents")
def placeholder_strip(spark, sf):
    marked = F.concat(F.lit("<text 1>"), F.col("text"), F.lit("<text 2>"))
    return docs(spark, sf).select("doc_id", T.without_placeholders(marked).alias("text"))


@query(f"""
WITH c AS (SELECT doc_id, {strip_sql("split_part(replace(text, '#', ''), chr(10) || chr(10), 1)")} AS candidate FROM documents)
SELECT doc_id, candidate FROM c WHERE length(candidate) > 10
""")
def answer_candidates(spark, sf):
    return docs(spark, sf).select("doc_id", T.candidate_text(F.col("text")).alias("candidate")).where("candidate is not null")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND length(text) >= 40")
def source_filter(spark, sf):
    return G.source_gate(docs(spark, sf), F.col("lang") == "en").select("doc_id", "lang")


@query(f"SELECT doc_id, lang FROM documents WHERE lang = 'fr' AND length(text) >= 40 AND {strip_sql('text')} LIKE '%.'")
def bt_gate(spark, sf):
    return G.translation_gate(docs(spark, sf), F.col("lang") == "fr", "text").select("doc_id", "lang")


@query(rf"""
WITH p AS (SELECT u.conv_id, u.turn, u.text AS source, a.text AS target FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
           WHERE u.role = 'user' AND a.role = 'assistant')
SELECT * FROM p WHERE length({strip_sql('source')}) >= 10 AND length({strip_sql('target')}) >= 10
  AND source NOT LIKE '%#%' AND target NOT LIKE '%#%' AND source NOT LIKE '%>%' AND target NOT LIKE '%>%'
""")
def pair_filter(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return G.pair_gate(u.join(a, ["conv_id", "turn"]))


@query(rf"""
SELECT doc_id, regexp_replace(CASE WHEN p IS NULL THEN text ELSE substring(text, 1, p - 1) END, '{WS}+$', '') AS head
FROM (SELECT doc_id, text, nullif(list_min(list_filter([strpos(text, chr(10)), strpos(text, ', the'), strpos(text, '#')], lambda p: p > 0)), 0) AS p FROM documents)
""")
def stop_truncate(spark, sf):
    return docs(spark, sf).select("doc_id", T.truncate_at(F.col("text"), ["\n", ", the", "#"]).alias("head"))


@query(rf"""
WITH {ANSWERS}, s AS (SELECT doc_id, n_lines, regexp_split_to_array(answer, '[0-9]+\. ?\n?') AS p FROM answers)
SELECT doc_id, array_to_string(list_transform(p[2:], lambda x: {strip_sql('x')}), ' | ') AS items, CAST(len(p) - 1 AS BIGINT) AS n FROM s WHERE len(p) - 1 = n_lines
""")
def list_parse(spark, sf):
    items = T.numbered_items(F.col("answer"), F.col("n_lines"))
    out = answers(docs(spark, sf)).select("doc_id", items.alias("items")).where("items is not null")
    return out.select("doc_id", F.array_join("items", " | ").alias("items"), F.size("items").cast("long").alias("n"))


@query(rf"""
WITH {ANSWERS},
h AS (SELECT doc_id, CASE WHEN strpos(answer, '4. ') > 0 THEN substring(answer, 1, strpos(answer, '4. ') - 1) ELSE answer END AS answer FROM answers),
s AS (SELECT doc_id, list_transform(regexp_split_to_array(answer, '[0-9]\. ')[2:], lambda x: {strip_sql(f"split_part({strip_sql('x')}, chr(10), 1)")}) AS p FROM h),
f AS (SELECT doc_id, list_filter(p, lambda x: x <> '') AS p FROM s)
SELECT doc_id, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i)[1:3], ' | ') AS items FROM f
""")
def proposition_parse(spark, sf):
    return answers(docs(spark, sf)).select("doc_id", F.array_join(T.proposition_items(F.col("answer"), 3), " | ").alias("items"))


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> ''), ' ') AS flat FROM documents")
def flatten_lines(spark, sf):
    return docs(spark, sf).select("doc_id", T.flattened(F.col("text")).alias("flat"))


@query(rf"""
WITH p AS (SELECT doc_id, array_to_string({WORDS}[1:(doc_id % 4) + 1], ', ') AS topic FROM documents)
SELECT doc_id, CASE WHEN len(x) > 1 THEN array_to_string(x[1:len(x) - 1], ', ') || ' and ' || x[len(x)] ELSE topic END AS phrase
FROM (SELECT doc_id, topic, string_split(topic, ', ') AS x FROM p)
""")
def topic_phrase(spark, sf):
    topic = F.array_join(F.slice(T.words(F.col("text")), F.lit(1), (F.col("doc_id") % 4 + 1).cast("int")), ", ")
    return docs(spark, sf).select("doc_id", T.topic_phrase(topic).alias("phrase"))


@query(rf"""
WITH t AS (SELECT doc_id, replace(replace(text, '. ', '। '), '.' || chr(10), '। ') AS text FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(text, '। '), lambda x: {strip_sql('x')}), lambda x: x <> '') AS s FROM t)
SELECT doc_id, array_to_string(list_transform(s, lambda x: CASE WHEN x LIKE '%।' THEN x ELSE x || '।' END), chr(10)) AS sentences, CAST(len(s) AS BIGINT) AS n FROM s
""")
def split_danda(spark, sf):
    text = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("। ")), F.lit(".\n"), F.lit("। "))
    return docs(spark, sf).select("doc_id", T.danda_sentences(text, T.DANDA["Nepali"]).alias("s")).select(
        "doc_id", F.array_join("s", "\n").alias("sentences"), F.size("s").cast("long").alias("n")
    )


REGROUP = "CASE WHEN len(p) < 3 THEN p ELSE list_transform([0, 1, 2], lambda i: array_to_string(p[i * (len(p) // 3) + least(i, len(p) % 3) + 1 : (i + 1) * (len(p) // 3) + least(i + 1, len(p) % 3)], ' ')) END"


@query(rf"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t]+(\p{{Lu}})', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, array_to_string({REGROUP}, chr(10)) AS groups FROM s
""")
def split_regroup(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.regrouped(T.sentences(F.col("text")), 3), "\n").alias("groups"))


@query(f"SELECT doc_id, array_to_string({REGROUP}, chr(10)) AS groups FROM (SELECT doc_id, string_split(text, ' ') AS p FROM documents)")
def char_split(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.regrouped(T.words_by_space(F.col("text")), 3), "\n").alias("groups"))


def _cut_sql(n: int) -> str:
    """Ends e1, e2, ... of the first n - 1 parts, each the first word that makes its part long enough."""
    out, before = [], "(SELECT doc_id, 0 AS e, 0 AS c FROM documents)"
    for k in range(1, n):
        out.append(f"e{k} AS (SELECT w.doc_id, min(w.i) AS e, min(w.c) AS c FROM w JOIN {before} b ON b.doc_id = w.doc_id AND w.i > b.e AND w.c - b.c - 1 >= w.size GROUP BY w.doc_id)")
        before = f"e{k}"
    return ", ".join(out)


@query(f"""
WITH t AS (SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS size, {WORDS} AS l FROM documents),
u AS (SELECT doc_id, size, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM t),
w AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM u), {_cut_sql(4)},
p AS (SELECT w.doc_id, w.i, w.word, CAST(coalesce(w.i > e1.e, false) AS INTEGER) + CAST(coalesce(w.i > e2.e, false) AS INTEGER) + CAST(coalesce(w.i > e3.e, false) AS INTEGER) AS pos
  FROM w LEFT JOIN e1 USING (doc_id) LEFT JOIN e2 USING (doc_id) LEFT JOIN e3 USING (doc_id))
SELECT doc_id, pos, string_agg(word, ' ' ORDER BY i) AS part FROM p GROUP BY doc_id, pos
""")
def equal_split(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(T.equal_parts(F.col("text"), 4)).alias("pos", "part"))


MARKED = "CASE doc_id % 4 WHEN 0 THEN 'So the sentence is thus: ' || text WHEN 1 THEN 'II. Final translation' || text WHEN 2 THEN 'III. Final translation' || text ELSE text END"


def marked(df: DataFrame) -> DataFrame:
    prefix = F.element_at(F.array(F.lit("So the sentence is thus: "), F.lit("II. Final translation"), F.lit("III. Final translation"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    return df.select("doc_id", F.concat(prefix, F.col("text")).alias("answer"))


@query(f"""
SELECT doc_id, CASE WHEN strpos(a, 'sentence is thus:') > 0 THEN substring(a, strpos(a, 'sentence is thus:') + 17)
  WHEN strpos(a, 'II. Final translation') > 0 THEN substring(a, strpos(a, 'II. Final translation') + 21) ELSE a END AS final
FROM (SELECT doc_id, {MARKED} AS a FROM documents)
""")
def extract_trigger(spark, sf):
    return marked(docs(spark, sf)).select("doc_id", T.after_trigger(F.col("answer")).alias("final"))


@query(f"""
WITH a AS (SELECT doc_id, {MARKED} AS a FROM documents),
r AS (SELECT doc_id, CASE WHEN strpos(a, 'sentence is thus:' || chr(10)) > 0 THEN substring(a, strpos(a, 'sentence is thus:' || chr(10)) + 18)
  WHEN strpos(a, 'III. Final translation') > 0 THEN substring(a, strpos(a, 'III. Final translation') + 22) ELSE a END AS r FROM a)
SELECT doc_id, split_part({strip_sql('r')}, chr(10), 1) AS line FROM r
""")
def final_lines(spark, sf):
    return marked(docs(spark, sf)).select("doc_id", T.final_line(F.col("answer"), "refine").alias("line"))


@query("SELECT doc_id, CASE WHEN length(text) > 1000 THEN substring(text, 1, 300) ELSE text END AS text FROM documents")
def crop_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.cropped(F.col("text")).alias("text"))


@query("SELECT lang, CAST(sum(CASE WHEN length(text) > 1000 THEN 1 ELSE 0 END) AS BIGINT) AS wrong, count(*) AS n FROM documents GROUP BY lang")
def wrong_format(spark, sf):
    return docs(spark, sf).groupBy("lang").agg(F.sum(F.when(F.length("text") > 1000, 1).otherwise(0)).alias("wrong"), F.count(F.lit(1)).alias("n"))


@query(f"""
WITH w AS (SELECT doc_id, text, {WORDS} AS w FROM documents),
b AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
c AS (SELECT doc_id, g, count(*) AS n FROM b GROUP BY doc_id, g),
t AS (SELECT doc_id, g, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) AS r FROM c) WHERE r = 1)
SELECT w.doc_id, length(CASE WHEN t.n >= 8 AND strpos(w.text, t.g) > 0 THEN substring(w.text, 1, strpos(w.text, t.g) - 1 + length(t.g)) ELSE w.text END) AS n_left
FROM w LEFT JOIN t ON t.doc_id = w.doc_id
""")
def trailing_repeat(spark, sf):
    return docs(spark, sf).select("doc_id", F.length(T.without_trailing_repeat(F.col("text"))).cast("long").alias("n_left"))


@query(rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 2 AND regexp_matches(lower(x), '[a-z]')
  AND NOT list_contains([{", ".join(f"'{w}'" for w in STOP_WORDS)}], lower(x))) AS t FROM documents)
SELECT doc_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[1:5], ' ') AS keywords FROM t
""")
def keywords(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.keywords(F.col("text"), STOP_WORDS, 5), " ").alias("keywords"))


RATED = """CASE doc_id % 5 WHEN 0 THEN 'Score: ' || CAST(doc_id % 120 AS VARCHAR) WHEN 1 THEN '[''' || CAST(doc_id % 120 AS VARCHAR) || ''']'
  WHEN 2 THEN CAST(doc_id % 120 AS VARCHAR) || '/100' WHEN 3 THEN '85 or 90' ELSE 'none' END"""


def rated(df: DataFrame) -> DataFrame:
    n = (F.col("doc_id") % 120).cast("string")
    forms = F.array(F.concat(F.lit("Score: "), n), F.concat(F.lit("['"), n, F.lit("']")), F.concat(n, F.lit("/100")), F.lit("85 or 90"), F.lit("none"))
    return df.select("doc_id", F.element_at(forms, (F.col("doc_id") % 5 + 1).cast("int")).alias("answer"))


@query(f"""
WITH a AS (SELECT doc_id, {RATED} AS a FROM documents),
n AS (SELECT doc_id, CAST(CASE WHEN len(regexp_extract_all(a, '[0-9]+')) = 1 THEN regexp_extract(a, '[0-9]+') WHEN regexp_full_match(a, '[0-9]+/100') THEN split_part(a, '/', 1) END AS BIGINT) AS n FROM a)
SELECT doc_id, CASE WHEN n BETWEEN 0 AND 100 THEN n END AS score FROM n
""")
def parse_score(spark, sf):
    return rated(docs(spark, sf)).select("doc_id", P.score(F.col("answer")).alias("score"))


STARRED = "CASE doc_id % 5 WHEN 0 THEN repeat('*', CAST(doc_id % 7 AS INTEGER)) WHEN 1 THEN 'I give it Three stars' WHEN 2 THEN CAST(doc_id % 9 AS VARCHAR) || ' stars' WHEN 3 THEN 'five or 4 stars' ELSE '★★★★' END"


@query(f"""
WITH a AS (SELECT doc_id, lower({STARRED}) AS a FROM documents),
h AS (SELECT doc_id, a, ' ' || a || ' ' AS p, regexp_extract_all(a, '[0-9]+') AS d FROM a),
v AS (SELECT doc_id, list_distinct(list_filter([nullif(length(a) - length(replace(a, '*', '')), 0), nullif(length(a) - length(replace(a, '★', '')), 0),
  CASE WHEN p LIKE '% one %' OR p LIKE '%1 star%' THEN 1 END, CASE WHEN p LIKE '% two %' OR p LIKE '%2 star%' THEN 2 END, CASE WHEN p LIKE '% three %' OR p LIKE '%3 star%' THEN 3 END,
  CASE WHEN p LIKE '% four %' OR p LIKE '%4 star%' THEN 4 END, CASE WHEN p LIKE '% five %' OR p LIKE '%5 star%' THEN 5 END,
  CASE WHEN len(d) = 1 THEN CAST(d[1] AS BIGINT) END], lambda x: x IS NOT NULL)) AS v FROM h)
SELECT doc_id, CASE WHEN len(v) = 1 AND v[1] BETWEEN 1 AND 5 THEN CAST(v[1] AS BIGINT) END AS stars FROM v
""")
def parse_stars(spark, sf):
    n = F.col("doc_id")
    forms = F.array(F.expr("repeat('*', cast(doc_id % 7 as int))"), F.lit("I give it Three stars"), F.concat((n % 9).cast("string"), F.lit(" stars")), F.lit("five or 4 stars"), F.lit("★★★★"))
    return docs(spark, sf).select("doc_id", P.stars(F.element_at(forms, (n % 5 + 1).cast("int"))).alias("stars"))


@query("""
WITH a AS (SELECT doc_id, lower(CASE doc_id % 3 WHEN 0 THEN 'It is a PERFECT translation.' WHEN 1 THEN 'No meaning preserved, not a perfect translation' ELSE 'unclear' END) AS a FROM documents),
h AS (SELECT doc_id, list_filter(list_transform(range(1, 6), lambda i: CASE WHEN strpos(a, (['no meaning preserved', 'some meaning preserved, but not understandable', 'some meaning preserved and understandable',
  'most meaning preserved, minor issues', 'perfect translation'])[i]) > 0 THEN i - 1 END), lambda x: x IS NOT NULL) AS h FROM a)
SELECT doc_id, CAST(CASE WHEN len(h) = 1 THEN h[1] END AS INTEGER) AS class FROM h
""")
def parse_class(spark, sf):
    forms = F.array(F.lit("It is a PERFECT translation."), F.lit("No meaning preserved, not a perfect translation"), F.lit("unclear"))
    return docs(spark, sf).select("doc_id", P.class_index(F.element_at(forms, (F.col("doc_id") % 3 + 1).cast("int")), P.CLASSES).alias("class"))


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'TIE' END AS verdict FROM documents
""")
def parse_verdict(spark, sf):
    forms = F.array(F.lit("because [RESULT] A is better\nB"), F.lit("x [RESULT]\n TIE"), F.lit("A"))
    return docs(spark, sf).select("doc_id", P.verdict(F.element_at(forms, (F.col("doc_id") % 3 + 1).cast("int"))).alias("verdict"))


@query("""
SELECT doc_id, CASE WHEN p < 0.001 THEN 'p<0.001' WHEN p < 0.05 THEN 'p<0.05' ELSE 'not significant' END AS label
FROM (SELECT doc_id, CAST(doc_id AS DOUBLE) / 10000 AS p FROM documents)
""")
def significance_label(spark, sf):
    return docs(spark, sf).select("doc_id", P.significance(F.col("doc_id").cast("double") / 10000).alias("label"))


@query(f"SELECT doc_id, CAST(list_position(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), w[3] || ' ' || w[4]) - 1 AS BIGINT) AS place FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) >= 4")
def sublist_place(spark, sf):
    w = docs(spark, sf).select("doc_id", T.words(F.col("text")).alias("w")).where("size(w) >= 4")
    return w.select("doc_id", T.find_sublist(F.col("w"), F.slice("w", 3, 2)).cast("long").alias("place"))
