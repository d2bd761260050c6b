"""Sources and sinks: record files, line corpora, raw vectors, run directories, benchmark splits, resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.operators.numbering import running

PARAGRAPHS = T.StructType([T.StructField("text", T.StringType()), T.StructField("topic", T.StringType())])
TRANSLATIONS = T.StructType(
    [
        T.StructField("sentence", T.StringType()),
        T.StructField("propositions", T.ArrayType(T.StringType())),
        T.StructField("translations", T.ArrayType(T.StringType())),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
        T.StructField("topic", T.StringType()),
    ]
)
PREDICTIONS = T.StructType([T.StructField("sentence", T.StringType()), T.StructField("translation", T.StringType())])
RUN_NAME = r"/?([^/]+)_to_([^/_]+)_(\d+)_shot_seed_(\d+)_([^/_]+)_([^/_]+)_(\d+)_(\d+)_(\d+)/[^/]+$"
RUN_FIELDS = [("src", "string"), ("tgt", "string"), ("k", "int"), ("seed", "int"), ("divide", "string"), ("merge", "string"), ("breadth", "int"), ("depth", "int"), ("refine", "int")]


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object a line, by a fixed schema; missing fields are null, broken lines are in _corrupt_record."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_records(df: DataFrame, path: str) -> None:
    """Overwrite another path than the one that is read."""
    df.write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not blank, as column line."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """Topics of a record file (field topic) or of a line file."""
    if path.endswith(".jsonl"):
        return read_records(spark, path, PARAGRAPHS).select("topic").where("topic is not null")
    return read_lines(spark, path).withColumnRenamed("line", "topic")


def positional_split(df: DataFrame, order: str, first: int, names: tuple[str, str] = ("devtest", "dev")) -> DataFrame:
    """The first rows in order are one split, the rest the other. The boundary id is found by a top-k, not by a global window."""
    head = df.select(order).orderBy(order).limit(first).agg(F.max(order).alias("_last"))
    return df.crossJoin(head).withColumn("split", F.when(F.col(order) <= F.col("_last"), names[0]).otherwise(names[1])).drop("_last")


def composite(dev: DataFrame, devtest: DataFrame) -> DataFrame:
    """A benchmark of the dev rows of one and the devtest rows of another."""
    return dev.where("split = 'dev'").unionByName(devtest.where("split = 'devtest'"))


def as_validation(df: DataFrame) -> DataFrame:
    """Dev rows relabelled as devtest; no dev rows are left."""
    return df.where("split = 'dev'").withColumn("split", F.lit("devtest"))


def read_vectors(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """row_id, embedding of raw little-endian float32 files, decoded in Arrow batches; rows are numbered through all files in order of path."""

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for content, offset in zip(batch["content"], batch["offset"].to_pylist(), strict=True):
                flat = np.frombuffer(content.as_buffer(), "<f4")
                rows = flat.reshape(-1, dimension)
                for lo in range(0, len(rows), 4096):
                    part = rows[lo : lo + 4096]
                    values = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, dimension), pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part)) + offset), values], names=["row_id", "embedding"])

    files = spark.read.format("binaryFile").load(path)
    rows = F.floor(F.col("length") / (4 * dimension))
    before = F.sum(rows).over(Window.orderBy("path")) - rows  # one row per file; contents are not read for it
    offsets = files.select("path", before.alias("offset"))
    return files.select("path", "content").join(F.broadcast(offsets), "path").select("content", "offset").mapInArrow(decode, "row_id long, embedding array<float>")


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors are kept as Parquet with their ids; raw files have neither ids nor a schema."""
    df.select("row_id", "embedding").write.mode("overwrite").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Predictions below run directories, with the settings that a directory's name tells; other directories are left out."""
    rows = spark.read.schema(PREDICTIONS).json(path).withColumn("file", F.col("_metadata.file_path")).where(F.col("file").rlike(RUN_NAME))
    for i, (name, kind) in enumerate(RUN_FIELDS, 1):
        rows = rows.withColumn(name, F.regexp_extract("file", RUN_NAME, i).cast(kind))
    return rows


def run_settings(names: DataFrame, column: str = "name") -> DataFrame:
    """Settings from run names alone."""
    out = names.where(F.concat(F.col(column), F.lit("/x")).rlike(RUN_NAME))
    for i, (name, kind) in enumerate(RUN_FIELDS, 1):
        out = out.withColumn(name, F.regexp_extract(F.concat(F.col(column), F.lit("/x")), RUN_NAME, i).cast(kind))
    return out


def paired_runs(runs: DataFrame, key: list[str], value: str) -> DataFrame:
    """Run keys that occur with exactly two different values, as a pair in order."""
    pair = runs.groupBy(*key).agg(F.array_sort(F.collect_set(value)).alias("_v")).where(F.size("_v") == 2)
    return pair.select(*key, F.get("_v", F.lit(0)).alias(f"{value}_a"), F.get("_v", F.lit(1)).alias(f"{value}_b"))


def take_skip(df: DataFrame, order: str, skip: int, take: int) -> DataFrame:
    """Rows skip .. skip + take - 1 in order."""
    return df.orderBy(order).offset(skip).limit(take)


def numbered_rows(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Add row_id from 0 within ``by``, which makes positional alignment explicit."""
    return df.withColumn("row_id", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)


# Codes of the languages of the pair corpora, by name.
LANGUAGE_CODES = {
    "Basque": "eus_Latn", "English": "eng_Latn", "French": "fra_Latn", "German": "deu_Latn", "Hausa": "hau_Latn", "Igbo": "ibo_Latn", "Kinyarwanda": "kin_Latn",
    "Nepali": "npi_Deva", "Somali": "som_Latn", "Spanish": "spa_Latn", "Sundanese": "sun_Latn", "Swahili": "swh_Latn", "Urdu": "urd_Arab", "Xhosa": "xho_Latn",
}


def with_code(df: DataFrame, language: str = "language", codes: dict[str, str] | None = None) -> DataFrame:
    """Add code by language name, from a literal map; null for unknown names."""
    pairs = [F.lit(x) for item in (codes or LANGUAGE_CODES).items() for x in item]
    return df.withColumn("code", F.try_element_at(F.create_map(*pairs), F.col(language)))


def parallel_pairs(corpus: DataFrame, src: str, tgt: str, split: str = "dev", size: int | None = None) -> DataFrame:
    """source, target of two languages of (dataset, language, split, row_id, sentence), joined on position; the first ``size`` rows."""
    rows = corpus.where(F.col("split") == split)
    if size is not None:
        rows = rows.where(F.col("row_id") < size)
    side = lambda name, out: rows.where(F.col("language") == name).select("dataset", "row_id", F.col("sentence").alias(out))
    both = side(src, "source").join(side(tgt, "target"), ["dataset", "row_id"])
    return both.withColumn("source_language", F.lit(src)).withColumn("target_language", F.lit(tgt))


def line_benchmark(spark: SparkSession, folder: str, code: str, splits: tuple[str, ...] = ("dev", "devtest")) -> DataFrame:
    """split, row_id, sentence of a benchmark laid out as <folder>/<split>/<code>.<split>, one sentence a line; files of local languages have the same layout.

    A file (some thousand lines) is read as a whole, so a line's number is its own; blank lines at the end are none.
    """
    rows = [spark.read.text(f"{folder}/{s}/{code}.{s}", wholetext=True).select(F.lit(s).alias("split"), F.regexp_replace("value", r"\n+$", "").alias("value")) for s in splits]
    whole = rows[0]
    for other in rows[1:]:
        whole = whole.unionByName(other)
    lines = whole.where("value <> ''").select("split", F.posexplode(F.split("value", "\n")).alias("row_id", "sentence"))
    return lines.withColumn("row_id", F.col("row_id").cast("long"))


def buffered_shuffle(df: DataFrame, order: str, size: int, seed: int) -> DataFrame:
    """Add turn: rows in order, shuffled within buffers of ``size`` neighbours by the md5 of (seed, row), as a stream of bounded memory can be."""
    placed = running(df, [order], number="_number", before="_before")
    placed = placed.withColumn("_buffer", F.floor(F.col("_number") / size)).drop("_number", "_before").withColumn("_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(order).cast("string"))))
    inside = F.row_number().over(Window.partitionBy("_buffer").orderBy("_key", order)) - 1
    return placed.withColumn("turn", (F.col("_buffer") * size + inside).cast("long")).drop("_buffer", "_key")


def candidate_sets(df: DataFrame, row: str, model: str, text: str) -> DataFrame:
    """row, models, candidates: the predictions of all models for a row, in order of the models' names; models that miss a row are left out of it."""
    lists = df.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), F.col(text).alias("t")))).alias("_c"))
    return lists.select(row, F.col("_c")["m"].alias("models"), F.col("_c")["t"].alias("candidates"))


def aligned_benchmark(pairs: DataFrame, language: str, pivot: str = "English", through: str = "Bengali") -> DataFrame:
    """split, row_id, sentence of one side of an aligned corpus (language, split, row_id, source, target), trimmed; validation is dev and test is devtest.

    The source side is the pivot's and is always read through the pair with ``through``, so that it is the same for every target.
    """
    side, name = ("source", through) if language == pivot else ("target", language)
    split = F.when(F.col("split") == "validation", "dev").when(F.col("split") == "test", "devtest").otherwise(F.col("split"))
    return pairs.where(F.col("language") == name).select(split.alias("split"), "row_id", F.regexp_replace(side, r"^\s+|\s+$", "").alias("sentence"))


def curated_benchmark(pairs: DataFrame, benchmark: DataFrame, side: str) -> DataFrame:
    """split, row_id, sentence: curated pairs (row_id, source, target) as dev, and the devtest rows of a benchmark (split, row_id, sentence, ...)."""
    dev = pairs.select(F.lit("dev").alias("split"), "row_id", F.col(side).alias("sentence"))
    return dev.unionByName(benchmark.where("split = 'devtest'").select("split", "row_id", "sentence"))


def contexts(rows: DataFrame, order: str, text: str = "context") -> DataFrame:
    """row_id, text of a reading-comprehension table, where each context stands once per run of questions on it."""
    placed = running(rows.select(F.col(order).alias("row_id"), F.col(text).alias("text")), ["row_id"])
    ahead = placed.select((F.col("number") + 1).alias("number"), F.xxhash64("text").alias("_hash"), F.col("text").isNull().alias("_null"))
    met = placed.join(ahead, "number", "left")
    return met.where(F.col("_hash").isNull() | F.col("_null") | (F.col("text").isNotNull() & (F.col("_hash") != F.xxhash64("text")))).select("row_id", "text")


def sentence_pairs(corpus: DataFrame, languages: list[str], codes: dict[str, str], src: str = "English") -> DataFrame:
    """source, target, source_language, target_language of the languages' pairs in a corpus (code, src, trg); a KeyError for a language without code."""
    names = {codes[name]: name for name in languages}
    table = corpus.sparkSession.createDataFrame(list(names.items()), "code string, target_language string")
    picked = corpus.join(F.broadcast(table), "code")  # a handful of languages
    return picked.select(F.col("src").alias("source"), F.col("trg").alias("target"), F.lit(src).alias("source_language"), "target_language")
