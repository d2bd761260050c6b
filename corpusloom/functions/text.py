"""Column builders for text: tokens, n-grams, repetition counts, list parsing, splitting, truncation.

They stay in the JVM, but for the pair count of very repetitive texts. Null in gives null out unless stated otherwise.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]"

# Phrases and limits of the generation format.
PLACEHOLDERS = ["<text 1>", "<text 2>"]
REPEAT_LIMIT = 75
PAIR_LIMIT = 150
PAIR_WORD_LENGTH = 5
PAIR_BLOCK = 256
DANDA = {"Nepali": "। ", "Urdu": "۔ "}
TRIGGER = "sentence is thus:"
FINAL_TRIGGERS = ["II. Final translation", "III. Final translation"]
DEFAULT_STOPS = ["\n\n", "###", "\n#", "```", "[INST]", "<|im_end|>", "<|eot_id|>", "</s>", "Q:", "Question:"]


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def words(text: Column) -> Column:
    """Tokens between runs of blanks."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def words_by_space(text: Column) -> Column:
    """Tokens between single blanks; neighbouring blanks give empty tokens."""
    return F.split(text, " ", -1)


def normalised_tokens(text: Column) -> Column:
    """Lower-case letters, digits and underscores in runs, without marks that take no space (after decomposition)."""
    plain = F.reflect(F.lit("org.apache.commons.lang3.StringUtils"), F.lit("stripAccents"), text)
    return F.regexp_extract_all(F.lower(F.regexp_replace(plain, r"\p{Mn}+", "")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def unicode_tokens(text: Column) -> Column:
    """Runs of letters, marks and digits of any script of the lower-case text: the tokens of the overlap score where ASCII ones would be none."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))


def ascii_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-case text: the tokens of the overlap score for Latin script."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens, joined by blanks; none if there are fewer tokens."""

    def grams(t: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(t) - (n - 1))
        return F.when(F.size(t) >= n, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(t, i, n), " ")))).otherwise(
            F.array().cast("array<string>")
        )

    return let(tokens, grams)


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by a blank, repeats included."""
    return let(
        tokens,
        lambda t: F.when(
            F.size(t) >= 2, F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        ).otherwise(F.array().cast("array<string>")),
    )


def highest_count(items: Column) -> Column:
    """How often the most frequent item occurs; 0 for an empty array. One pass over the sorted items."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x == acc["last"], acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.sort_array(items), start, step, lambda acc: acc["best"])


def counted(items: Column) -> Column:
    """array of struct(item, n), one per distinct item, from the borders between runs of the sorted items."""

    def of_sorted(s: Column) -> Column:
        marks = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return let(
            marks,
            lambda m: F.transform(m, lambda at, k: F.struct(F.get(s, at).alias("item"), (F.coalesce(F.get(m, k + 1), F.size(s)) - at).alias("n"))),
        )

    return let(F.sort_array(items), of_sorted)


def most_frequent(items: Column) -> Column:
    """struct(item, n) of the most frequent item, the smallest of several."""
    ranked = F.transform(counted(items), lambda c: F.struct((-c["n"]).alias("n"), c["item"].alias("item")))
    return let(F.array_min(ranked), lambda m: F.struct(m["item"].alias("item"), (-m["n"]).alias("n")))


def longest_word(text: Column) -> Column:
    """The first of the longest tokens between single blanks."""
    first = F.aggregate(
        words_by_space(text), F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc)
    )
    return first


def char_bigrams(text: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(text) - 1)
    return F.when(F.length(text) >= 2, F.transform(at, lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def highest_pair_count(text: Column, least_length: int = PAIR_WORD_LENGTH, limit: int = PAIR_LIMIT) -> Column:
    """How often the most frequent ordered pair of words (at any distance) occurs, if that is ``limit`` or more; else 0.

    Only words of least_length count. A pair occurs at most count * count times, so texts whose most frequent word cannot reach the limit
    are settled in the JVM; the few others are counted in Arrow batches, in one pass with the counts seen so far.
    """

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([0 if t is None else _pair_count(t, least_length, limit) for t in texts], dtype="int64")

    top = highest_count(F.filter(words_by_space(text), lambda x: F.length(x) >= least_length))
    return F.coalesce(F.pandas_udf(count, "long")(F.when(top * top >= limit, text)), F.lit(0).cast("long"))


def _pair_count(text: str, least_length: int, limit: int) -> int:
    words_ = [w for w in text.split(" ") if len(w) >= least_length]
    counts = Counter(words_)
    most = max(counts.values(), default=0)
    number = {w: i for i, w in enumerate(w for w, n in counts.items() if n * most >= limit)}
    places = [i for i in map(number.get, words_) if i is not None]
    best = 0
    for lo in range(0, len(number), PAIR_BLOCK):  # first words of the pairs, so many at a time
        seen = np.zeros(min(PAIR_BLOCK, len(number) - lo), np.int32)
        pairs = np.zeros((len(number), len(seen)), np.int32)
        for i in places:
            pairs[i] += seen
            if lo <= i < lo + len(seen):
                seen[i - lo] += 1
        best = max(best, int(pairs.max(initial=0)))
    return best if best >= limit else 0


def without_placeholders(text: Column) -> Column:
    for p in PLACEHOLDERS:
        text = F.replace(text, F.lit(p), F.lit(""))
    return text


def truncate_at(text: Column, stops: list[str]) -> Column:
    """The part before the earliest stop string, without blanks at its end."""
    found = F.array_min(F.filter(F.array(*[F.locate(s, text) for s in stops]), lambda p: p > 0))
    return rstrip(F.when(found.isNotNull(), F.substring(text, F.lit(1), found - 1)).otherwise(text))


def flattened(text: Column) -> Column:
    """The lines that are not blank, trimmed and joined by single blanks."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), " ")


def numbered_items(answer: Column, n: Column | None = None) -> Column:
    """The items of a numbered list; with n, null unless there are exactly so many. The form of the first number fixes the pattern."""
    forms = [("1. \n", r"\d+\. \n"), ("1. ", r"\d+\. ?(?:\n)?"), ("", r"\d+\.\n")]
    parts = F.when(F.contains(answer, F.lit(forms[0][0])), F.split(answer, forms[0][1])).when(
        F.contains(answer, F.lit(forms[1][0])), F.split(answer, forms[1][1])
    ).otherwise(F.split(answer, forms[2][1]))
    items = let(parts, lambda p: F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), strip))
    return items if n is None else let(items, lambda x: F.when(F.size(x) == n, x))


def proposition_items(answer: Column, n: int) -> Column:
    """First lines of the items of a numbered list (single digits), blanks dropped, distinct, at most n."""
    cut = F.locate(f"{n + 1}. ", answer)
    head = F.when(cut > 0, F.substring(answer, F.lit(1), cut - 1)).otherwise(answer)
    parts = F.when(F.contains(head, F.lit("    1.")), F.split(head, r"    (?:\d|-)\. ")).otherwise(F.split(head, r"\d\. "))
    lines = let(parts, lambda p: F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda x: strip(F.get(F.split(strip(x), "\n"), F.lit(0)))))
    return F.slice(F.array_distinct(F.filter(lines, lambda x: x != "")), 1, n)


def candidate_text(answer: Column) -> Column:
    """Without '#', up to the first empty line; null if not longer than 10 characters."""
    body = F.get(F.split(F.replace(answer, F.lit("#"), F.lit("")), "\n\n"), F.lit(0))
    return let(strip(body), lambda x: F.when(F.length(x) > 10, x))


def without_trailing_repeat(text: Column, limit: int = 8) -> Column:
    """Cut after the first place of the most frequent word bigram, if it occurs ``limit`` times or more."""
    top = most_frequent(bigrams(words(text)))
    return let(
        top,
        lambda t: F.when(
            (t["n"] >= limit) & (F.position(t["item"], text) > 0), F.substring(text, F.lit(1), F.position(t["item"], text) - 1 + F.length(t["item"]))
        ).otherwise(text),
    )


def cropped(text: Column, most: int = 1000, to: int = 300) -> Column:
    return F.when(F.length(text) > most, F.substring(text, 1, to)).otherwise(text)


def after_trigger(text: Column) -> Column:
    """What follows the first of the trigger phrases; the text itself without one."""
    out = text
    for t in [*reversed(FINAL_TRIGGERS), TRIGGER]:  # the last one set wins
        out = F.when(F.contains(text, F.lit(t)), F.substring(text, F.locate(t, text) + len(t), F.length(text))).otherwise(out)
    return out


def final_line(text: Column, method: str) -> Column:
    """The translation in the answer of a merge: its first line, after the trigger of the refining methods.

    The refining prompts end in section III, the others in section II.
    """
    line = lambda x: F.get(F.split(strip(x), "\n"), F.lit(0))
    if method == "vanilla":
        return line(text)
    last = FINAL_TRIGGERS[1] if method == "refine" else FINAL_TRIGGERS[0]
    out = line(text)
    for t in [last, f"{TRIGGER}\n"]:
        out = F.when(F.contains(text, F.lit(t)), line(F.substring(text, F.locate(t, text) + len(t), F.length(text)))).otherwise(out)
    return out


def topic_phrase(topic: Column) -> Column:
    """'a, b, c' as 'a, b and c'."""
    return let(
        F.split(topic, ", "),
        lambda p: F.when(F.size(p) > 1, F.concat(F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), ", "), F.lit(" and "), F.element_at(p, -1))).otherwise(topic),
    )


def danda_sentences(text: Column, mark: str) -> Column:
    """Sentences between ``mark`` (terminator and blank), each with its terminator."""
    end = mark.strip()
    parts = F.filter(F.transform(F.split(text, mark), strip), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(F.endswith(x, F.lit(end)), x).otherwise(F.concat(x, F.lit(end))))


# Abbreviations after which a sentence goes on although a capital follows, by language. Callers may pass their own.
ABBREVIATIONS = {
    "English": ["Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Jr", "Sr", "Gen", "Col", "Sen", "Rep", "No", "vs", "Fig", "Mt"],
    "French": ["M", "MM", "Mme", "Mlle", "Dr", "St", "Ste", "av", "env", "cf", "art"],
    "German": ["Dr", "Prof", "Hr", "Fr", "Nr", "Str", "St", "Abb", "bzw", "ca", "usw"],
    "Spanish": ["Sr", "Sra", "Srta", "Dr", "Dra", "Ud", "Uds", "Lic", "Ing", "pág", "núm"],
}
HELD = "\x01"  # stands for the blanks behind an abbreviation while a text is split


def sentences(text: Column, abbreviations: list[str] | None = None) -> Column:
    """Split behind . ! ? where blanks and an upper-case letter follow, and at line breaks; not behind an abbreviation, whose blanks become one."""
    if abbreviations:
        text = F.regexp_replace(text, rf"(^|[^\p{{L}}])({'|'.join(abbreviations)})\.[ \t]+", f"$1$2.{HELD}")
    marked = F.regexp_replace(text, r"([.!?])[ \t]+(\p{Lu})", "$1\n$2")
    if abbreviations:
        marked = F.replace(marked, F.lit(HELD), F.lit(" "))
    return F.filter(F.transform(F.split(marked, "\n"), strip), lambda x: x != "")


def regrouped(parts: Column, n: int, sep: str = " ") -> Column:
    """At most n groups of neighbouring parts; the first (size mod n) groups have one part more."""

    def groups(p: Column) -> Column:
        b, r = F.floor(F.size(p) / n).cast("int"), F.size(p) % n
        start = lambda i: i * b + F.least(i, r)
        made = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_join(F.slice(p, start(i) + 1, b + (i < r).cast("int")), sep))
        return F.when(F.size(p) < n, p).otherwise(made)

    return let(parts, groups)


def equal_parts(text: Column, n: int) -> Column:
    """n parts of about equal length, cut behind the word in which an equal cut would fall; the last part takes the rest."""
    size = lambda t: F.ceil(F.length(t) / n).cast("int")

    def parts(t: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

        def step(acc: Column, w: Column) -> Column:
            now = F.when(acc["now"] == "", w).otherwise(F.concat(acc["now"], F.lit(" "), w))
            full = (F.length(now) >= size(t)) & (F.size(acc["done"]) < n - 1)
            return F.struct(F.when(full, F.concat(acc["done"], F.array(now))).otherwise(acc["done"]).alias("done"), F.when(full, F.lit("")).otherwise(now).alias("now"))

        end = lambda acc: F.when(acc["now"] != "", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.aggregate(words(t), start, step, end)

    return let(text, parts)


def keywords(text: Column, stop_words: list[str], n: int) -> Column:
    """First n distinct tokens longer than two characters that hold a letter a-z and are no stop word."""
    stop = F.array(*[F.lit(s) for s in stop_words])
    tokens = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    good = F.filter(tokens, lambda x: (F.length(x) > 2) & F.lower(x).rlike("[a-z]") & ~F.array_contains(stop, F.lower(x)))
    return F.slice(F.array_distinct(good), 1, n)


def by_place(parts: Column, text: Column) -> Column:
    """Parts in the order in which they first occur in the text, earlier ones of the array first on ties."""
    placed = F.transform(parts, lambda x, i: F.struct(F.position(x, text).alias("p"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda s: s["x"])


def find_sublist(haystack: Column, needle: Column) -> Column:
    """Position (from 0) of the first place at which needle stands in haystack, -1 if nowhere."""
    at = F.sequence(F.lit(1), F.size(haystack) - F.size(needle) + 1)
    hit = F.filter(at, lambda i: F.slice(haystack, i, F.size(needle)) == needle)
    return F.when(F.size(haystack) >= F.size(needle), F.coalesce(F.get(hit, F.lit(0)) - 1, F.lit(-1))).otherwise(-1)
