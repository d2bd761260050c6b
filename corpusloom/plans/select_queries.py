"""Queries of decontamination, selection, reshaping, packing and prompts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import prompts as PR
from corpusloom.functions import text as T
from corpusloom.operators import decon as D
from corpusloom.operators import packing as K
from corpusloom.operators import reshape as R
from corpusloom.operators import selection as S
from corpusloom.plans.text_queries import WORDS, docs

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


NORM = r"regexp_extract_all(lower(strip_accents({t})), '[\p{{L}}\p{{N}}_]+')"
GRAMS = "list_transform(range(1, len(t) - 8), lambda i: array_to_string(t[i : i + 9], ' '))"
HITS = rf"""
b AS (SELECT item_id, unnest({GRAMS}) AS g FROM (SELECT item_id, {NORM.format(t='text')} AS t FROM benchmark) WHERE len(t) >= 10),
i AS (SELECT g, max(item_id) AS item_id FROM b GROUP BY g),
d AS (SELECT DISTINCT doc_id, unnest({GRAMS}) AS g FROM (SELECT doc_id, {NORM.format(t='text')} AS t FROM documents) WHERE len(t) >= 10),
h AS (SELECT doc_id, ngram, item_id FROM (SELECT d.doc_id, d.g AS ngram, i.item_id, row_number() OVER (PARTITION BY d.doc_id ORDER BY d.g) AS r FROM d JOIN i ON i.g = d.g) WHERE r = 1)"""


@query(f"SELECT doc_id, md5(array_to_string({NORM.format(t='text')}, ' ')) AS tokens, CAST(len({NORM.format(t='text')}) AS BIGINT) AS n FROM documents")
def tokenize_norm(spark, sf):
    t = docs(spark, sf).select("doc_id", T.normalised_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5(F.array_join("t", " ")).alias("tokens"), F.size("t").cast("long").alias("n"))


def _hits(spark, sf):
    return D.contamination(docs(spark, sf), D.ngram_index(table(spark, sf, "benchmark")))


@query(f"WITH {HITS} SELECT doc_id, ngram, item_id FROM h")
def decon_hits(spark, sf):
    return _hits(spark, sf)


@query(f"WITH {HITS} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)")
def decon_filtered(spark, sf):
    return D.without_contaminated(docs(spark, sf), _hits(spark, sf)).select("doc_id", "lang")


@query(rf"""
WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM x),
g AS (SELECT DISTINCT doc_id, pos, unnest({GRAMS}) AS g FROM (SELECT doc_id, pos, {NORM.format(t='line')} AS t FROM p) WHERE len(t) >= 10),
b AS (SELECT DISTINCT unnest({GRAMS}) AS g FROM (SELECT {NORM.format(t='text')} AS t FROM benchmark) WHERE len(t) >= 10),
bad AS (SELECT DISTINCT doc_id, pos FROM g JOIN b USING (g)),
kept AS (SELECT doc_id, count(*) AS n, sum(length(line)) AS n_chars FROM p WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.doc_id = p.doc_id AND bad.pos = p.pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_left, CAST(coalesce(k.n_chars, 0) AS BIGINT) AS n_chars FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
""")
def decon_pairs(spark, sf):
    nested = docs(spark, sf).select("doc_id", F.split("text", "\n").alias("translations"))
    nested = nested.withColumn("scores", F.transform("translations", lambda x: F.length(x)))
    flat = R.flattened(nested, "doc_id", ["translations"]).withColumn("row", F.struct("doc_id", "pos"))
    bad = D.contamination(flat.withColumnRenamed("translations", "text"), D.ngram_index(table(spark, sf, "benchmark")), id_column="row").select("row.doc_id", "row.pos")
    out = D.without_contaminated_elements(nested, bad, "doc_id", ["translations", "scores"])
    total = F.aggregate("scores", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", F.size("translations").cast("long").alias("n_left"), total.alias("n_chars"))


@query("")
def decon_diff(spark, sf):
    return D.contamination_report(docs(spark, sf), table(spark, sf, "benchmark")).drop("completion", "bench_text")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > (SELECT quantile_cont(n_chars, 0.9) FROM documents)")
def select_percentile(spark, sf):
    return S.above_percentile(docs(spark, sf), "n_chars", 90).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 20")
def select_highest(spark, sf):
    return S.highest(docs(spark, sf), "n_chars", 20, "doc_id", ["lang"]).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 30")
def select_soonest(spark, sf):
    return S.soonest(docs(spark, sf), 30, "doc_id", ["lang"]).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('122|' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 25")
def select_random(spark, sf):
    return S.random(docs(spark, sf), 25, "doc_id", 122, ["lang"]).select("doc_id", "lang")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('122|' || CAST(doc_id AS VARCHAR)), doc_id) <= floor(0.1 * (SELECT count(*) FROM documents)) THEN 'test' ELSE 'train' END AS split FROM documents")
def train_test_split(spark, sf):
    return S.train_test(docs(spark, sf).select("doc_id"), "doc_id", 0.1, 122)


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id) AS BIGINT) AS place FROM documents")
def seeded_shuffle(spark, sf):
    ids = docs(spark, sf).select("doc_id").withColumn("t", S.turn(7, "doc_id"))
    # places from counts of the order's leading digits: no task sees more than one bucket
    ids = ids.withColumn("b", F.conv(F.substring("t", 1, 3), 16, 10).cast("long"))
    from pyspark.sql.window import Window

    counts = ids.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("b").orderBy("t", "doc_id"))
    return ids.withColumn("i", inside).join(before, "b").select("doc_id", (F.col("start") + F.col("i")).alias("place"))


PAIRS = """p AS (SELECT u.conv_id * 1000 + u.turn AS pair_id, u.text AS source, a.text AS target, 'xx' AS source_language, 'en' AS target_language
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def pairs(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    both = c.where("role = 'user'").join(a, ["conv_id", "turn"])
    return both.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("source"), "target", F.lit("xx").alias("source_language"), F.lit("en").alias("target_language"))


@query(f"WITH {PAIRS} SELECT * FROM p UNION ALL SELECT pair_id, target, source, target_language, source_language FROM p")
def reverse_pairs(spark, sf):
    return S.both_directions(pairs(spark, sf))


@query("SELECT doc_id, text FROM documents")
def nest_roundtrip(spark, sf):
    d = docs(spark, sf).select("doc_id", F.split("text", " ").alias("w"))
    return R.nested(R.flattened(d, "doc_id", ["w"]), "doc_id", ["w"], d).select("doc_id", F.array_join("w", " ").alias("text"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 600 THEN 'devtest' ELSE 'dev' END AS split FROM documents")
def ntrex_split(spark, sf):
    from corpusloom.sources.corpora import positional_split

    return positional_split(docs(spark, sf).select("doc_id"), "doc_id", 600)


@query("SELECT d.doc_id AS row_id, d.text AS source, b.text AS target FROM documents d JOIN benchmark b ON b.item_id = d.doc_id")
def zip_pairs(spark, sf):
    left = docs(spark, sf).select(F.col("doc_id").alias("row_id"), F.col("text").alias("sentence"))
    right = table(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("sentence"))
    return R.zipped(left, right, ["row_id"])


@query(f"SELECT lang, round(avg(len({WORDS})), 6) AS mean_words, round(avg(length(text)), 6) AS mean_chars, count(*) AS n FROM documents GROUP BY lang")
def length_stats(spark, sf):
    w = F.size(T.words(F.col("text")))
    return docs(spark, sf).groupBy("lang").agg(F.round(F.avg(w), 6).alias("mean_words"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT round(CAST(sum(length(text)) AS DOUBLE) / sum(len({WORDS})), 6) AS chars_per_token FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 400)")
def chars_per_token(spark, sf):
    return K.characters_per_token(docs(spark, sf), "text", T.words(F.col("text")), "doc_id").select(F.round("chars_per_token", 6).alias("chars_per_token"))


@query("""
SELECT conv_id, turn, role FROM (SELECT conv_id, turn, trim(role) AS role, lag(trim(role)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
WHERE before IS NULL OR before <> role""")
def runlength_dedup(spark, sf):
    return R.run_heads(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "turn", "role", "conv_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf):
    return R.not_done(docs(spark, sf).select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query(f"""
WITH t AS (SELECT doc_id, unnest(list_append({WORDS}, '</s>')) AS tok, generate_subscripts(list_append({WORDS}, '</s>'), 1) AS i FROM documents),
n AS (SELECT tok, row_number() OVER (ORDER BY doc_id, i) - 1 AS ix FROM t),
b AS (SELECT CAST(floor(ix / 512) AS BIGINT) AS block_id, count(*) AS n, md5(string_agg(tok, ' ' ORDER BY ix)) AS tokens FROM n GROUP BY 1)
SELECT CAST(block_id AS BIGINT) AS block_id, tokens FROM b WHERE n = 512
""")
def pack_blocks(spark, sf):
    d = docs(spark, sf).select("doc_id", F.concat(T.words(F.col("text")), F.array(F.lit("</s>"))).alias("t"))
    return K.packed(d, "doc_id", "t", 512).select("block_id", F.md5(F.array_join("tokens", " ")).alias("tokens"))


WORDS_OF = r"list_transform(list_filter(regexp_split_to_array({c}, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''), lambda x: CAST(length(x) AS INTEGER))"


@query(f"""
WITH {PAIRS}, w AS (SELECT pair_id, {WORDS_OF.format(c='source')} AS s, {WORDS_OF.format(c='target')} AS t FROM p)
SELECT pair_id, array_to_string(list_append(list_concat(s, t), 0), ',') AS input_ids,
  array_to_string(list_append(list_concat(list_transform(s, lambda x: -100), t), 0), ',') AS labels FROM w
""")
def pack_labels(spark, sf):
    ids = lambda c: F.transform(T.words(F.col(c)), lambda x: F.length(x))
    x, y = K.target_labels(ids("source"), ids("target"), F.lit(0))
    join = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return pairs(spark, sf).select("pair_id", join(x).alias("input_ids"), join(y).alias("labels"))


@query(f"""
WITH w AS (SELECT doc_id, {WORDS_OF.format(c='text')} AS t FROM documents)
SELECT doc_id, array_to_string(list_concat(t, list_transform(range(0, 64), lambda i: 0))[1:64], ',') AS ids FROM w
""")
def pad_truncate(spark, sf):
    ids = F.transform(T.words(F.col("text")), lambda x: F.length(x))
    return docs(spark, sf).select("doc_id", F.array_join(F.transform(K.padded(ids, 64, 0), lambda v: v.cast("string")), ",").alias("ids"))


@query("""
WITH s AS (SELECT string_agg('English sentence' || chr(10) || a.text || chr(10) || 'French translation' || chr(10) || b.text || chr(10) || '###' || chr(10), '' ORDER BY a.item_id) AS shots
  FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 WHERE a.item_id < 3)
SELECT doc_id, md5(shots || 'English sentence' || chr(10) || text || chr(10) || 'French translation' || chr(10)) AS prompt FROM documents CROSS JOIN s
""")
def render_template(spark, sf):
    b = table(spark, sf, "benchmark")
    shots = b.where("item_id < 3").join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("y")), "item_id").select("item_id", F.col("text").alias("x"), "y")
    shots = shots.agg(F.array_sort(F.collect_list(F.struct("item_id", "x", "y"))).alias("shots"))  # one row
    prompt = PR.Format.numbered(11, "English", "French").column(F.col("shots"), F.col("text"))
    return docs(spark, sf).crossJoin(shots).select("doc_id", F.md5(prompt).alias("prompt"))


@query("""
SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '<|im_start|>system' || chr(10) || trim(text) ELSE '<|im_start|>' || role || chr(10) || text END || '<|im_end|>' || chr(10), ''
  ORDER BY CASE role WHEN 'system' THEN 0 ELSE 1 END, turn) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY conv_id
""")
def chat_render(spark, sf):
    return PR.render_conversations(table(spark, sf, "conversations"), "qwen-2.5")


@query("""
SELECT conv_id, '<bos>' || string_agg('<start_of_turn>' || CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END || chr(10) || text || '<end_of_turn>' || chr(10), '' ORDER BY turn) || '<start_of_turn>model' || chr(10) AS prompt
FROM conversations WHERE role <> 'system' GROUP BY conv_id
""")
def chat_render_turns(spark, sf):
    return PR.render_conversations(table(spark, sf, "conversations").where("role <> 'system'"), "gemma")


@query(r"""
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '')[1:3] AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, len(l) + 1), lambda i: CAST(i AS VARCHAR) || '. ' || l[len(l) + 1 - i]), chr(10)) AS examples FROM l
""")
def neighbour_examples(spark, sf):
    lines = F.slice(F.filter(F.split("text", "\n"), lambda x: x != ""), 1, 3)
    return docs(spark, sf).select("doc_id", PR.numbered(F.reverse(lines)).alias("examples"))


@query("SELECT doc_id, 'candidate: ' || text || ' source: ' || lang AS input FROM documents")
def metric_inputs(spark, sf):
    return docs(spark, sf).select("doc_id", PR.metric_input(F.col("text"), F.col("lang"), "source").alias("input"))


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang, source")
def language_counts(spark, sf):
    return docs(spark, sf).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))
