"""Column parsers for judges' answers: numbers, stars, classes, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words and classes of the rating formats.
NUMBER_WORDS = ["one", "two", "three", "four", "five"]
CLASSES = ["No meaning preserved", "Some meaning preserved, but not understandable", "Some meaning preserved and understandable", "Most meaning preserved, minor issues", "Perfect translation"]


def single_number(answer: Column, most: int | None = None) -> Column:
    """The integer of an answer that holds just one; of ['n'] or, with ``most``, of n/most."""
    numbers = F.regexp_extract_all(answer, F.lit(r"(\d+)"), F.lit(1))
    out = F.when(F.size(numbers) == 1, F.get(numbers, F.lit(0)))
    if most is not None:
        out = F.coalesce(out, F.when(answer.rlike(f"^[0-9]+/{most}$"), F.substring_index(answer, "/", 1)))
    return out.cast("long")


def score(answer: Column, least: int = 0, most: int = 100) -> Column:
    """The number of the answer, null outside the range."""
    n = single_number(answer, most)
    return F.when(n.between(least, most), n)


def stars(answer: Column) -> Column:
    """1 to 5, if all hints in the answer (signs, number words, 'n star', a single number) agree."""
    low = F.lower(answer)
    padded = F.replace(F.concat(F.lit(" "), low, F.lit(" ")), F.lit("\n"), F.lit(" "))
    signs = [F.length(low) - F.length(F.replace(low, F.lit(s), F.lit(""))) for s in "*★"]
    hints = [F.when(n > 0, n.cast("long")) for n in signs]
    hints += [F.when(F.contains(padded, F.lit(f" {w} ")) | F.contains(padded, F.lit(f"{i} star")), F.lit(i).cast("long")) for i, w in enumerate(NUMBER_WORDS, 1)]
    found = F.array_distinct(F.filter(F.array(*hints, single_number(padded)), lambda x: x.isNotNull()))
    return F.when((F.size(found) == 1) & F.get(found, F.lit(0)).between(1, 5), F.get(found, F.lit(0)))


def class_index(answer: Column, classes: list[str]) -> Column:
    """Index of the only class named in the answer, whatever the case."""
    hits = F.filter(
        F.array(*[F.when(F.contains(F.lower(answer), F.lit(c.lower())), F.lit(i)) for i, c in enumerate(classes)]), lambda x: x.isNotNull()
    )
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def verdict(answer: Column, mark: str = "[RESULT]") -> Column:
    """First word of the first line behind the mark."""
    rest = F.when(F.contains(answer, F.lit(mark)), F.substring_index(answer, mark, -1))
    line = F.get(F.split(F.regexp_replace(rest, r"^[ \t\n\x0B\f\r]+", ""), "\n"), F.lit(0))
    return F.nullif(F.get(F.split(line, "[ \t]+"), F.lit(0)), F.lit(""))


def significance(p: Column) -> Column:
    return F.when(p < 0.001, "p<0.001").when(p < 0.05, "p<0.05").otherwise("not significant")
