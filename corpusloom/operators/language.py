"""Language identification, learned or by function words, and the gates and choices that rest on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.langid import UNKNOWN, LanguageModel

# Frequent function words by language, in the order in which ties are settled. Callers may pass tables of their own.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are by this be at from or not have which you an were they but their all",
    "fr": "le la les de des et un une du en que qui dans pour pas sur est au plus par ce avec sont il elle ne se ou mais nous",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "es": "el la de que y en los del las un por con para una su al lo como más se no sus es pero sin sobre este ya entre cuando",
}
# Target languages that an evaluation of these benchmarks covers.
EVALUATED = {
    "flores": ["Amharic", "Burmese", "Fijian", "Khmer", "Lao", "Samoan", "Sinhala", "Tsonga", "Turkmen", "Uyghur", "N'ko"],
    "ntrex": ["Amharic", "Khmer", "Shona", "Somali", "Tswana"],
    "ood": ["Amharic", "Khmer", "Lingala", "Luganda", "Tamil"],
    "tico": ["Amharic", "Khmer", "Lingala", "Luganda", "Tamil"],
}


def language_of(text: Column, table: LanguageModel | dict[str, str] | None = None) -> Column:
    """The language of the first line that is not blank, by a learned model (see langid.fit_languages()).

    Without a model it is the language whose function words (``table``) are most frequent there; 'und' if there are none.
    Null and blank texts are 'und'; ties go to the language named first.
    """
    if isinstance(table, LanguageModel):
        return table.language_of(text)
    table = table or FUNCTION_WORDS
    line = F.get(F.split(T.strip(F.coalesce(text, F.lit(""))), "\n"), F.lit(0))
    tokens = T.words(F.regexp_replace(F.lower(line), "[.,;:!?]", ""))

    def hits(t: Column, words: list[str]) -> Column:
        return F.size(F.filter(t, lambda x: x.isin(words)))

    def best(t: Column) -> Column:
        counts = F.array(*[hits(t, w.split()) for w in table.values()])
        return T.let(counts, lambda c: F.when(F.array_max(c) == 0, UNKNOWN).otherwise(F.element_at(_literals(" ".join(table)), F.array_position(c, F.array_max(c)).cast("int"))))

    return T.let(tokens, best)


def _literals(words: str) -> Column:
    return F.array(*[F.lit(w) for w in words.split()])


def is_language(text: Column, language: str | Column, table: LanguageModel | dict[str, str] | None = None) -> Column:
    """Whether the text is in the language."""
    return language_of(text, table) == language


def evaluated(df: DataFrame, benchmark: str, target: str = "tgt") -> DataFrame:
    """Runs into a language that the benchmark's evaluation covers; benchmarks without a list cover all."""
    names = EVALUATED.get(benchmark)
    return df if names is None else df.where(F.col(target).isin(names))


def tied_choice(df: DataFrame, a: str, b: str, language: str, key: str, seed: int = 122, table: LanguageModel | dict[str, str] | None = None) -> DataFrame:
    """Add choice: the candidate that alone is in the language, otherwise either of them by a coin, the md5 of (seed, key)."""
    coin = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 1), 16, 10).cast("int") % 2
    rows = df.withColumns({"_a": is_language(F.col(a), language, table), "_b": is_language(F.col(b), language, table)})
    fair = F.when(coin == 0, F.col(a)).otherwise(F.col(b))
    return rows.withColumn("choice", F.when(F.col("_a") & ~F.col("_b"), F.col(a)).when(F.col("_b") & ~F.col("_a"), F.col(b)).otherwise(fair)).drop("_a", "_b")


def best_in_language(df: DataFrame, group: str, pos: str, text: str, language: str, quality: Column, table: LanguageModel | dict[str, str] | None = None) -> DataFrame:
    """The candidate with the highest quality among those in the language per group (quality counts as 0 for others); the earliest of several."""
    weighed = F.when(is_language(F.col(text), language, table), quality).otherwise(F.lit(0.0))
    best = df.groupBy(group).agg(F.max_by(F.struct(pos, text), F.struct(weighed.alias("w"), (-F.col(pos)).alias("p"))).alias("b"))
    return best.select(group, F.col(f"b.{pos}").alias(pos), F.col(f"b.{text}").alias(text))
