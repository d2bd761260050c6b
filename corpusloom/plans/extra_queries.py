"""Queries of language identification, comparisons of strategies, structural retrieval, self-instruction and aligned corpora, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import prompts as PR
from corpusloom.functions import stemming as ST
from corpusloom.functions import text as T
from corpusloom.operators import gates as G
from corpusloom.operators import inference as I
from corpusloom.operators import judging as J
from corpusloom.operators import langid as LI
from corpusloom.operators import language as L
from corpusloom.operators import retriever as R
from corpusloom.operators import similarity as S
from corpusloom.operators.numbering import use_shared_checkpoints
from corpusloom.plans import self_instruct as SI
from corpusloom.plans.search_queries import CANDS, bm25_sql, candidates
from corpusloom.plans.select_queries import PAIRS, pairs, table
from corpusloom.plans.text_queries import WORDS, WS, docs, strip_sql
from corpusloom.sources import codes, corpora

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _codes_sql(text: str) -> str:
    """Code points of a text as the language model sees it."""
    plain = f"trim(regexp_replace(lower(coalesce({text}, '')), '{LI.NO_LETTERS}', ' ', 'g'))"
    return f"list_transform(string_split(CASE WHEN {plain} = '' THEN '' ELSE ' ' || {plain} || ' ' END, ''), lambda x: unicode(x))"


def _grams_sql(keys: str, rows: str) -> str:
    """keys and bucket of every trigram of rows (keys, c: code points)."""
    gram = f"((c[i] * {LI.BASE} + c[i + 1]) * {LI.BASE} + c[i + 2]) % {LI.BUCKETS}"
    return f"SELECT {keys}, unnest(list_transform(range(1, len(c) - 1), lambda i: {gram})) AS bucket FROM ({rows})"


def model_sql(rows: str) -> str:
    """CTEs of the model learned from the documents in ``rows``."""
    return f"""lid_counts AS (SELECT lang, bucket, count(*) AS n FROM ({_grams_sql('lang', f"SELECT lang, {_codes_sql('text')} AS c FROM {rows} WHERE lang IS NOT NULL")}) GROUP BY ALL),
lid_totals AS (SELECT lang, sum(n) AS total FROM lid_counts GROUP BY lang)"""


def identified_sql(name: str, source: str, text: str) -> str:
    """CTEs of which the last, ``name``, has k and language of the rows (k, text) of ``source``."""
    line = f"string_split({strip_sql(f'coalesce({text}, {chr(39)}{chr(39)})')}, chr(10))[1]"
    weight = f"CAST(round({LI.SCALE} * ln((coalesce(w.n, 0) + 1) / CAST(t.total + {LI.BUCKETS} AS DOUBLE))) AS BIGINT)"
    return f"""{name}_grams AS MATERIALIZED ({_grams_sql('k', f"SELECT k, {_codes_sql(line)} AS c FROM {source}")}),
{name}_sums AS (SELECT g.k, t.lang, sum({weight}) AS s, count(*) AS n, count(w.n) AS known
  FROM {name}_grams g CROSS JOIN lid_totals t LEFT JOIN lid_counts w ON w.lang = t.lang AND w.bucket = g.bucket GROUP BY g.k, t.lang),
{name}_best AS (SELECT * FROM {name}_sums QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, lang) = 1),
{name} AS (SELECT a.k, CASE WHEN 2 * b.known >= b.n THEN b.lang ELSE 'und' END AS language FROM {source} a LEFT JOIN {name}_best b USING (k))"""


def model(spark, sf):
    """What all documents teach about their languages."""
    return LI.fit_languages(docs(spark, sf))


DOCS_K = f"{model_sql('documents')}, src AS (SELECT doc_id AS k, text FROM documents), {identified_sql('lid', 'src', 'text')}"
PAIRS_K = f"""{PAIRS}, {model_sql('documents')}, src AS (SELECT pair_id AS k, source AS text FROM p), tgt AS (SELECT pair_id AS k, target AS text FROM p),
{identified_sql('a', 'src', 'text')}, {identified_sql('b', 'tgt', 'text')}"""


@query(f"WITH {DOCS_K} SELECT k AS doc_id, language FROM lid")
def lang_id(spark, sf):
    return docs(spark, sf).select("doc_id", L.language_of(F.col("text"), model(spark, sf)).alias("language"))


HELD_OUT = "substring(md5('lid|' || CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2')"


@query(f"""
WITH known AS (SELECT * FROM documents WHERE NOT {HELD_OUT}), {model_sql('known')},
src AS (SELECT doc_id AS k, text, lang FROM documents WHERE {HELD_OUT} AND lang IS NOT NULL), {identified_sql('lid', 'src', 'text')}
SELECT src.lang, count(*) AS n, CAST(sum(CASE WHEN lid.language = src.lang THEN 1 ELSE 0 END) AS BIGINT) AS n_right FROM src JOIN lid USING (k) GROUP BY src.lang
""")
def lang_id_held_out(spark, sf):
    return LI.held_out_accuracy(docs(spark, sf), "doc_id")


@query(f"WITH {DOCS_K} SELECT doc_id FROM documents JOIN lid ON k = doc_id WHERE language = 'en' AND length(text) >= 40")
def source_gate_lid(spark, sf):
    """The source gate, with the language identified from the text."""
    return G.source_gate(docs(spark, sf), L.is_language(F.col("text"), "en", model(spark, sf))).select("doc_id")


@query(f"WITH {PAIRS_K} SELECT pair_id FROM p JOIN b ON b.k = pair_id WHERE b.language = 'en' AND length(target) >= 40 AND ends_with({strip_sql('target')}, '.')")
def bt_gate_lid(spark, sf):
    """The gate on translations, with the language identified from the text."""
    return G.translation_gate(pairs(spark, sf), L.is_language(F.col("target"), "en", model(spark, sf)), "target").select("pair_id")


@query(f"WITH {PAIRS_K} SELECT pair_id FROM p JOIN a ON a.k = pair_id JOIN b ON b.k = pair_id WHERE {strip_sql('target')} <> '' AND a.language <> 'de' AND b.language = 'en'")
def premise_gate_lid(spark, sf):
    p, m = pairs(spark, sf), model(spark, sf)
    return G.premise_gate(p, "target", L.is_language(F.col("target"), "en", m), L.is_language(F.col("source"), "de", m)).select("pair_id")


@query(f"""
WITH {PAIRS_K}, l AS (SELECT pair_id, source, target, a.language = 'en' AS a, b.language = 'en' AS b, CAST(('0x' || substring(md5('122|' || CAST(pair_id AS VARCHAR)), 1, 1)) AS INTEGER) % 2 AS coin
  FROM p JOIN a ON a.k = pair_id JOIN b ON b.k = pair_id)
SELECT pair_id, md5(CASE WHEN a AND NOT b THEN source WHEN b AND NOT a THEN target WHEN coin = 0 THEN source ELSE target END) AS choice FROM l
""")
def tied_ensemble(spark, sf):
    return L.tied_choice(pairs(spark, sf), "source", "target", "en", "pair_id", table=model(spark, sf)).select("pair_id", F.md5("choice").alias("choice"))


@query(f"""
WITH {CANDS}, {model_sql('documents')}, src AS (SELECT g * 1000 + pos AS k, text FROM c), {identified_sql('lid', 'src', 'text')},
r AS (SELECT g, pos, text, row_number() OVER (PARTITION BY g ORDER BY CASE WHEN language = 'en' THEN length(text) ELSE 0 END DESC, pos) AS r FROM c JOIN lid ON k = g * 1000 + pos)
SELECT g, pos, text FROM r WHERE r = 1
""")
def language_ensemble(spark, sf):
    return L.best_in_language(candidates(spark, sf), "g", "pos", "text", "en", F.length("text").cast("double"), model(spark, sf))


@query("""
SELECT lang, a.source AS a, b.source AS b FROM (SELECT DISTINCT lang, source FROM documents) a JOIN (SELECT DISTINCT lang, source FROM documents) b USING (lang) WHERE a.source < b.source
""")
def strategy_pairs(spark, sf):
    return J.strategy_pairs(docs(spark, sf), ["lang"], "source")


@query("""
WITH s AS (SELECT lang, source, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS row_id FROM documents),
p AS (SELECT x.lang, x.source AS a, y.source AS b, x.n_chars AS u, y.n_chars AS v FROM s x JOIN s y ON x.lang = y.lang AND x.row_id = y.row_id AND x.source < y.source)
SELECT lang, a, b, CAST(sum(CASE WHEN u > v THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN u < v THEN 1 ELSE 0 END) AS BIGINT) AS losses, CAST(sum(CASE WHEN u = v THEN 1 ELSE 0 END) AS BIGINT) AS ties FROM p GROUP BY lang, a, b
""")
def strategy_wins(spark, sf):
    s = corpora.numbered_rows(docs(spark, sf).select("lang", "source", "n_chars", "doc_id"), ["lang", "source"], "doc_id")
    return J.win_rates(J.segment_pairs(s, ["lang"], "row_id", "source", "n_chars"), ["lang", "a", "b"], "n_chars_a", "n_chars_b")


@query("SELECT lang, source, count(quality) AS n, round(avg(quality), 2) AS score FROM labels JOIN documents USING (doc_id) GROUP BY lang, source")
def system_scores(spark, sf):
    j = table(spark, sf, "labels").join(docs(spark, sf).select("doc_id", "lang", "source"), "doc_id")
    return J.system_scores(j, ["lang", "source"], "quality", 2)


@query(f"WITH {PAIRS} SELECT pair_id, CASE WHEN length({strip_sql('target')}) > length({strip_sql('source')}) THEN 'B' ELSE 'A' END AS winner FROM p")
def rank_pairs(spark, sf):
    p = pairs(spark, sf)
    return J.rank_pairs(p.select("pair_id", F.col("source").alias("a"), F.col("target").alias("b"), F.lit("x").alias("s")), "s", "a", "b").select("pair_id", "winner")


@query("""
WITH r AS (SELECT doc_id, ['Amharic', 'Khmer', 'Hausa', 'Tamil', 'Lingala'][1 + doc_id % 5] AS tgt FROM documents)
SELECT doc_id, tgt FROM r WHERE tgt IN ('Amharic', 'Khmer', 'Lingala', 'Luganda', 'Tamil')
""")
def evaluated_runs(spark, sf):
    names = F.array(*[F.lit(x) for x in ("Amharic", "Khmer", "Hausa", "Tamil", "Lingala")])
    runs = docs(spark, sf).select("doc_id", F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("tgt"))
    return L.evaluated(runs, "tico")


LOWER = WORDS.replace("text", "lower(text)")
STOPS = "[" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + "]"


def stems_sql(source: str) -> str:
    """CTEs for the English stems of the distinct words w of ``source``: stems(w, stem)."""
    v, c = "[aeiouy]", "[^aeiouy]"
    short = f"(^{v}{c}|{c}{v}[^aeiouywxY])$"
    listed = lambda words: ", ".join(f"'{w}'" for w in words.split())

    def cases(name: str, before: str, endings: dict[str, tuple[str, str]]) -> str:
        """A step: endings, each with its condition on the head h and what then takes the place of the word."""
        e = f"regexp_extract(s, '({'|'.join(' '.join(endings).split())})$')"
        when = " ".join(f"WHEN e IN ({listed(k)}) THEN CASE WHEN {ok} THEN {new} ELSE s END" for k, (ok, new) in endings.items())
        return f"""{name}_e AS (SELECT *, {e} AS e, left(s, length(s) - length({e})) AS h FROM {before}),
{name} AS (SELECT w, r1, r2, CASE {when} ELSE s END AS s FROM {name}_e)"""

    in1 = lambda put: ("length(h) >= r1", f"h || '{put}'")
    in2 = lambda put: ("length(h) >= r2", f"h || '{put}'")
    undone = f"""CASE WHEN regexp_matches(h, '(at|bl|iz)$') THEN h || 'e' WHEN regexp_matches(h, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(h, length(h) - 1)
  WHEN length(h) <= r1 AND regexp_matches(h, '{short}') THEN h || 'e' ELSE h END"""
    region = lambda text, extra="": f"regexp_extract({text}, '^(?:{extra}.*?{v}{c})')"
    where = lambda start, found: f"CASE WHEN {found} = '' THEN length(s) ELSE {start} + length({found}) END"
    whole = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ST.EN_WHOLE.items())
    steps = [
        cases("s1a", "s0", {
            "sses": ("true", "h || 'ss'"), "ied ies": ("true", "h || CASE WHEN length(h) > 1 THEN 'i' ELSE 'ie' END"), "us ss": ("true", "s"),
            "s": (f"regexp_matches(h, '{v}.+$')", "h")}),
        cases("s1b", "s1a", {"eed eedly": in1("ee"), "ed edly ing ingly": (f"regexp_matches(h, '{v}')", undone)}),
        cases("s1c", "s1b", {"y Y": (f"regexp_matches(h, '.{c}$')", "h || 'i'")}),
        cases("s2", "s1c", {
            "tional": in1("tion"), "enci": in1("ence"), "anci": in1("ance"), "abli": in1("able"), "entli": in1("ent"), "izer ization": in1("ize"),
            "ational ation ator": in1("ate"), "alism aliti alli": in1("al"), "fulness fulli": in1("ful"), "ousli ousness": in1("ous"), "iveness iviti": in1("ive"),
            "biliti bli": in1("ble"), "ogi": ("length(h) >= r1 AND h LIKE '%l'", "h || 'og'"), "lessli": in1("less"),
            "li": ("length(h) >= r1 AND regexp_matches(h, '[cdeghkmnrt]$')", "h")}),
        cases("s3", "s2", {"tional": in1("tion"), "ational": in1("ate"), "alize": in1("al"), "icate iciti ical": in1("ic"), "ful ness": in1(""), "ative": in2("")}),
        cases("s4", "s3", {"al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize": in2(""), "ion": ("length(h) >= r2 AND regexp_matches(h, '[st]$')", "h")}),
        cases("s5", "s4", {"e": (f"length(h) >= r2 OR length(h) >= r1 AND NOT regexp_matches(h, '{short}')", "h"), "l": ("length(h) >= r2 AND h LIKE '%l'", "h")}),
    ]
    return f"""vocabulary AS (SELECT DISTINCT w FROM ({source})),
marked AS (SELECT w, regexp_replace(regexp_replace(regexp_replace(w, '^''', ''), '^y', 'Y'), '({v})y', '\\1Y', 'g') AS s FROM vocabulary WHERE length(w) > 2),
first_region AS (SELECT *, {where("0", region("s", "gener|commun|arsen|"))} AS r1 FROM marked),
regions AS (SELECT *, {where("r1", region("substr(s, r1 + 1)"))} AS r2 FROM first_region),
s0 AS (SELECT w, r1, r2, regexp_replace(s, '(''s''|''s|'')$', '') AS s FROM regions),
{", ".join(steps)},
stems AS (SELECT vocabulary.w, CASE vocabulary.w {whole} ELSE CASE WHEN s1a.s IN ({listed(" ".join(ST.EN_KEPT))}) THEN s1a.s ELSE replace(coalesce(s5.s, vocabulary.w), 'Y', 'y') END END AS stem
  FROM vocabulary LEFT JOIN s1a ON s1a.w = vocabulary.w LEFT JOIN s5 ON s5.w = vocabulary.w)"""


RUNS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({STOPS}, x))"


@query(f"""
WITH said AS (SELECT unnest({RUNS}) AS w FROM documents), {stems_sql("SELECT w FROM said")},
n AS (SELECT w, count(*) AS n FROM said GROUP BY w)
SELECT stem, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_words, min(w) AS first_word FROM n JOIN stems USING (w) GROUP BY stem
""")
def stemmed_vocabulary(spark, sf):
    """English stems of all words of documents: how often, and of how many words. Words are counted before they are stemmed, so each is stemmed once."""
    counted = docs(spark, sf).select(F.explode(R.word_runs(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    stems = counted.select("w", "n", ST.english_stem(F.col("w")).alias("stem"))
    return stems.groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_words"), F.min("w").alias("first_word"))


def ranked_sql(pool: str, asked: str, k: int) -> str:
    """BM25 (k1 1.5, b 0.7) of asked (query_id, t) against pool (item_id, t): best(query_id, item_id, score, r)."""
    return f"""
p AS ({pool}), q AS ({asked}),
post AS (SELECT item_id, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT item_id, len(t) AS dl, unnest(t) AS term FROM p) GROUP BY item_id, dl, term),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS avgdl FROM p),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, ln(greatest(1.0, (n - df + 0.5) / (df + 0.5))) AS idf, avgdl FROM df CROSS JOIN stats),
ask AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(t) AS term FROM q) GROUP BY query_id, term),
s AS (SELECT query_id, item_id, round(sum(qtf * idf * tf / (tf + 1.5 * (0.3 + 0.7 * dl / avgdl))), 6) AS score FROM ask JOIN idf USING (term) JOIN post USING (term) GROUP BY query_id, item_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM s) WHERE r <= {k})"""


@query(f"""
WITH pool_words AS (SELECT doc_id AS item_id, unnest({RUNS}) AS w FROM documents), asked_words AS (SELECT item_id AS query_id, unnest({RUNS}) AS w FROM benchmark),
{stems_sql("SELECT w FROM pool_words UNION ALL SELECT w FROM asked_words")}, stemmed AS (SELECT item_id, list(stem) AS t FROM pool_words JOIN stems USING (w) GROUP BY item_id),
{ranked_sql("SELECT doc_id AS item_id, coalesce(t, []) AS t FROM documents LEFT JOIN stemmed ON item_id = doc_id",
            "SELECT query_id, list(stem) AS t FROM asked_words JOIN stems USING (w) GROUP BY query_id", 5)}
SELECT query_id, item_id, count(*) OVER (PARTITION BY query_id) - r + 1 AS pos FROM best
""")
def bm25_stemmed(spark, sf):
    """BM25 over English stems without stop words, by the retriever's name."""
    pool = docs(spark, sf).select(F.col("doc_id").alias("item_id"), "text")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.Retriever("bm25s", pool, language="english").query(q, 5)


PARTS = f"(SELECT item_id, unnest([1, 2, 3]) AS part, {LOWER} AS w FROM benchmark)"


@query(f"""
WITH {ranked_sql(f"SELECT doc_id AS item_id, {LOWER} AS t FROM documents", f"SELECT item_id * 3 + part AS query_id, list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN (i - 1) % 3 + 1 = part THEN w[i] END), lambda x: x IS NOT NULL) AS t FROM {PARTS}", 4)},
once AS (SELECT (query_id - 1) // 3 AS query_id, item_id, min((r, (query_id - 1) % 3 + 1)) AS b FROM best GROUP BY 1, 2),
dealt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b, item_id) AS i FROM once)
SELECT query_id, item_id, count(*) OVER (PARTITION BY query_id) - i + 1 AS pos FROM dealt WHERE i <= 4
""")
def structural_bm25(spark, sf):
    """Items for the parts of a benchmark text (every third word), by BM25 each and in turn."""
    pool = docs(spark, sf).select(F.col("doc_id").alias("item_id"), R.index_tokens(F.col("text")).alias("tokens"))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), R.index_tokens(F.col("text")).alias("w"))
    part = b.select("query_id", "w", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("part"))
    part = part.withColumn("tokens", F.expr("filter(w, (x, i) -> i % 3 + 1 = part)"))
    return R.structural_top_k(part.select("query_id", "part", "tokens"), pool, 4, 3)


@query("""
WITH w AS (SELECT item_id, list_transform(string_split(text, ' '), lambda x: substring(x, 1, 1)) AS l FROM benchmark),
e AS (SELECT item_id, unnest(list_transform(range(2, len(l) + 1), lambda i: l[i - 1] || '>' || l[i])) AS label FROM w),
h AS (SELECT item_id, label, count(*) AS n FROM e GROUP BY item_id, label),
s AS (SELECT a.item_id AS query_id, b.item_id, CAST(sum(a.n * b.n) AS DOUBLE) AS score FROM h a JOIN h b USING (label) GROUP BY a.item_id, b.item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r, count(*) OVER (PARTITION BY query_id) AS c FROM s)
SELECT query_id, item_id, score, least(c, 5) - r + 1 AS pos FROM r WHERE r <= 5
""")
def edge_histogram_topk(spark, sf):
    """The kernel of edges, with each word's predecessor as its head and first letters as labels."""
    b = table(spark, sf, "benchmark").select("item_id", F.transform(F.split("text", " "), lambda w: F.substring(w, 1, 1)).alias("l"))
    heads = F.transform(F.col("l"), lambda x, i: F.greatest(i - 1, F.lit(0)))
    rows = b.select("item_id", F.explode(S.edge_labels(F.col("l"), heads)).alias("label"))
    return S.histogram_kernel(rows.withColumnRenamed("item_id", "query_id"), rows, 5)


FUSED = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, late DESC, came DESC, item_id) AS r, count(*) OVER (PARTITION BY query_id) AS c FROM s) SELECT query_id, item_id, score, least(c, 5) - r + 1 AS pos FROM r WHERE r <= 5"


@query(f"""
WITH one AS ({bm25_sql(False)}), two AS ({bm25_sql(True)}),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.item_id, b.item_id) AS item_id, a.pos AS p1, b.pos AS p2 FROM one a FULL OUTER JOIN two b ON a.query_id = b.query_id AND a.item_id = b.item_id),
s AS (SELECT query_id, item_id, CAST(coalesce(p1, 0) + coalesce(p2, 0) + CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN 1.5 ELSE 0 END AS DOUBLE) AS score, CASE WHEN p2 IS NULL THEN 1 ELSE 0 END AS late, coalesce(p2, p1) AS came FROM f),
{FUSED}
""")
def fused_bm25(spark, sf):
    """Both forms of BM25 over the documents, fused."""
    q, p = (df.select(F.col(c).alias(n), R.index_tokens(F.col("text")).alias("tokens")) for df, c, n in ((table(spark, sf, "benchmark"), "item_id", "query_id"), (docs(spark, sf), "doc_id", "item_id")))
    return S.borda(S.bm25_top_k(q, p, 5), S.bm25_top_k(q, p, 5, b=0.75, okapi=True), 5)


@query(f"WITH {PAIRS} SELECT pair_id, md5('Translate this from English to French:' || chr(10) || 'English: ' || source || chr(10) || 'French: ' || target) AS text FROM p")
def sample_texts(spark, sf):
    return pairs(spark, sf).select("pair_id", F.md5(PR.sample_text(F.col("source"), F.col("target"))).alias("text"))


@query("""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')), lambda x: x <> '' AND NOT contains(x, '##') AND NOT regexp_matches(x, '^[0-9]+\\.')) AS l FROM documents)
SELECT doc_id, CAST(len(l) AS INTEGER) AS n, md5(array_to_string(l, chr(1))) AS passages FROM l
""")
def listed_passages(spark, sf):
    """Lines of documents as an answer to the list prompt, and read back."""
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: (x != "") & ~F.contains(x, F.lit("##")) & ~x.rlike(r"^[0-9]+\."))
    answer = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n\n##\n\n")
    d = docs(spark, sf).select("doc_id", SI.listed_passages(F.concat(answer, F.lit("\n\n##"))).alias("l"))
    return d.select("doc_id", F.size("l").alias("n"), F.md5(F.array_join("l", "\x01")).alias("passages"))


ABBREVIATED = "|".join(["of", "and", *T.ABBREVIATIONS["English"]])


@query(rf"""
WITH h AS (SELECT doc_id, regexp_replace(replace(text, ' of ', ' of. '), '(^|[^\p{{L}}])({ABBREVIATED})\.[ \t]+', '\1\2.' || chr(1), 'g') AS t FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(replace(regexp_replace(t, '([.!?])[ \t]+(\p{{Lu}})', '\1' || chr(10) || '\2', 'g'), chr(1), ' '), chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS p FROM h)
SELECT doc_id, CAST(len(p) AS INTEGER) AS n, md5(array_to_string(p, chr(10))) AS sentences FROM s
""")
def split_abbreviations(spark, sf):
    """Sentences of texts in which some full stops belong to abbreviations."""
    d = docs(spark, sf).select("doc_id", T.sentences(F.replace(F.col("text"), F.lit(" of "), F.lit(" of. ")), ["of", "and", *T.ABBREVIATIONS["English"]]).alias("p"))
    return d.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "\n")).alias("sentences"))


@query("SELECT doc_id % 50 AS row_id, string_agg(source, ',' ORDER BY source, text) AS models, md5(string_agg(text, chr(1) ORDER BY source, text)) AS candidates FROM documents GROUP BY doc_id % 50")
def candidate_sets(spark, sf):
    d = docs(spark, sf).select((F.col("doc_id") % 50).alias("row_id"), "source", "text")
    return corpora.candidate_sets(d, "row_id", "source", "text").select("row_id", F.array_join("models", ",").alias("models"), F.md5(F.array_join("candidates", "\x01")).alias("candidates"))


@query("""
WITH r AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS b FROM documents)
SELECT doc_id, b * 100 + row_number() OVER (PARTITION BY b ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS turn FROM r
""")
def buffered_shuffle(spark, sf):
    return corpora.buffered_shuffle(docs(spark, sf).select("doc_id"), "doc_id", 100, 7)


@query("""
WITH t AS (SELECT doc_id, list_transform(string_split(text, ' ')[1:60], lambda x: length(x)) AS l FROM documents), c AS (SELECT doc_id, l[1:40] AS l FROM t)
SELECT doc_id, array_to_string(CASE WHEN l[len(l)] = 3 THEN l[1 : len(l) - 1] ELSE l END, ',') AS ids FROM c
""")
def metric_tokens(spark, sf):
    """Word lengths as token ids, of which 3 is the end."""
    ids = F.transform(F.slice(F.split("text", " "), 1, 60), lambda x: F.length(x))
    return docs(spark, sf).select("doc_id", F.array_join(PR.metric_tokens(ids, 40, 3), ",").alias("ids"))


@query("SELECT doc_id AS row_id, lang AS text FROM (SELECT doc_id, lang, lag(lang) OVER (ORDER BY doc_id) AS before FROM documents) WHERE before IS NULL OR before <> lang")
def context_rows(spark, sf):
    return corpora.contexts(docs(spark, sf), "doc_id", "lang")


@query(f"""
WITH p AS (SELECT CASE doc_id % 2 WHEN 0 THEN 'Bengali' ELSE 'Hausa' END AS language, CASE doc_id % 3 WHEN 0 THEN 'validation' ELSE 'test' END AS split, doc_id AS row_id, text FROM documents)
SELECT 'English' AS language, CASE split WHEN 'validation' THEN 'dev' ELSE 'devtest' END AS split, row_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS sentence FROM p WHERE language = 'Bengali'
UNION ALL SELECT 'Hausa', CASE split WHEN 'validation' THEN 'dev' ELSE 'devtest' END, row_id, md5(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g')) FROM p WHERE language = 'Hausa'
""")
def aligned_benchmark(spark, sf):
    d = docs(spark, sf)
    p = d.select(
        F.when(F.col("doc_id") % 2 == 0, "Bengali").otherwise("Hausa").alias("language"), F.when(F.col("doc_id") % 3 == 0, "validation").otherwise("test").alias("split"),
        F.col("doc_id").alias("row_id"), F.col("text").alias("source"), F.lower("text").alias("target"),
    )
    both = [corpora.aligned_benchmark(p, n).select(F.lit(n).alias("language"), "split", "row_id", F.md5("sentence").alias("sentence")) for n in ("English", "Hausa")]
    return both[0].unionByName(both[1])


@query("""
SELECT doc_id, 'English' AS source_language, CASE doc_id % 7 WHEN 0 THEN 'Hausa' WHEN 1 THEN 'Igbo' WHEN 4 THEN 'Swahili' END AS target_language FROM documents WHERE doc_id % 7 IN (0, 1, 4)
""")
def sentence_pairs(spark, sf):
    names = F.array(*[F.lit(c) for c in [*codes.SMOL.values(), "zz"]])
    corpus = docs(spark, sf).select(F.element_at(names, (F.col("doc_id") % 7 + 1).cast("int")).alias("code"), F.col("text").alias("src"), F.col("doc_id").alias("trg"))
    found = corpora.sentence_pairs(corpus, ["Hausa", "Igbo", "Swahili"], codes.SMOL)
    return found.select(F.col("target").alias("doc_id"), "source_language", "target_language")


@query("")
def self_instruct_round(spark, sf):
    """One round: prompts of sampled document lines per language, the offline backend's answers, and what is new in them."""
    line = F.get(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 20), F.lit(0))
    seeds = docs(spark, sf).select(F.col("lang").alias("language"), line.alias("text")).where("text is not null").distinct()
    asked = seeds.select("language").distinct().select("language", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("p")).select("language", F.concat_ws("|", "language", "p").alias("prompt_id"))
    made = seeds.where("false")
    mixed = SI.mixed_examples(asked, seeds, made, 6, 2)
    return mixed.select("prompt_id", "language", F.size("examples").alias("n"), F.md5(SI.list_prompt(F.col("language"), F.col("examples"))).alias("prompt"))


@query(f"""
WITH p AS (SELECT doc_id, regexp_replace('Translate:' || chr(10) || text, '{WS}+$', '') AS prompt FROM documents)
SELECT p.doc_id, md5(regexp_extract(prompt, '[^\\n]*$')) AS answer, labels.doc_id IS NOT NULL AS resumed FROM p LEFT JOIN (SELECT DISTINCT doc_id FROM labels) labels USING (doc_id)
WHERE prompt IS NOT NULL
""")
def resumed_generation(spark, sf):
    """A prompt for every document, of which those with labels were answered by a run that stopped: the ledger answers them, the others are asked."""
    use_shared_checkpoints(spark)
    ledger = f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}"
    prompts = docs(spark, sf).select("doc_id", F.concat(F.lit("Translate:\n"), F.col("text")).alias("prompt"))
    early = prompts.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    before = I.generate_resumable(early, "prompt", ledger)
    after = I.generate_resumable(prompts, "prompt", ledger)
    answer = F.md5(F.get("candidates", F.lit(0)).cast("binary")).alias("answer")
    known = before.where("candidates IS NOT NULL").select("prompt", F.lit(True).alias("known"))
    marked = prompts.join(early.select("doc_id", F.lit(True).alias("early")), "doc_id", "left").join(after, "prompt").join(known, "prompt", "left")
    return marked.select("doc_id", answer, F.coalesce(F.col("early") & F.col("known"), F.lit(False)).alias("resumed"))
