"""Mix sources to target weights by entropy balancing (DataFrame functions only).

Every document d of source s gets a rate r_d = exp(lambda_s), the exponential tilt that is closest in
(token weighted) relative entropy to "take everything once" among those that meet the token constraint
``sum(size_d * r_d) = target_s``. The duals come from Newton steps on the convex dual

    D(lambda) = sum_d size_d * exp(lambda_s(d)) - sum_s lambda_s * target_s,

each step being one distributed aggregation over a (source, size) histogram that is staged once. Rates are
then rounded to whole copies: floor(r) of every document and one more of those that come first in a seeded
md5 order until the source's remaining words are used up. Only the one md5 bucket in which that happens is
ordered exactly, so no source is ever gathered in one task.

Defined results: null texts and texts without words have size 0 and are never taken; null sources form one
group, last in order; equal rows are separate documents; rows with equal ids come together in the md5 order, ties by size; texts of any
length are counted whole; an empty table gives an empty result; columns other than doc_id, text and source are ignored, whatever
their names, and go along in mixed_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.store import numbered, stage

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 65_536  # of the md5 order in one bucket, about


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-blank characters; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cap: float, cycle: int) -> DataFrame:
    """One row per source: source_size, target and the share of rank-cycled weights, capped at cap * source_size.

    The cap is water-filling: with sources ordered by cap over weight, the level shares what the capped ones
    before leave among the rest, and the highest such level is the one at which nobody stands above its cap.
    """
    totals = sizes.groupBy("src_null", "src").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(1))
    ranked = totals.withColumn("w", (F.row_number().over(everything.orderBy("src_null", "src")) - 1) % cycle + 1)
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    by_level = everything.orderBy(F.col("cap") / F.col("w"), "src_null", "src")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    filled = ranked.withColumn("level", level)
    # the level rises while sources stand above their cap and falls afterwards
    chosen = F.max("level").over(everything)
    return filled.select("src_null", "src", "source_size", F.least("cap", chosen * F.col("w")).alias("target"))


def newton_duals(histogram: DataFrame, targets: DataFrame, tolerance: float, max_steps: int) -> DataFrame:
    """The dual of every source, by Newton steps over the histogram until the worst relative gap is below tolerance."""
    duals = stage(targets.withColumn("dual", F.when(F.col("target") > 0, F.lit(0.0))), "mix-dual")
    for _ in range(max_steps):  # Newton steps for this dual shrink the gap quadratically; reaching the limit is an error, not a result
        tilted = (
            histogram.join(duals.select("src_null", "src", "dual"), ["src_null", "src"])
            .groupBy("src_null", "src")
            .agg(F.sum(F.col("size") * F.col("docs") * F.exp("dual")).alias("mass"))
        )
        # gradient mass - target, Hessian mass: the system is diagonal because sources do not overlap
        stepped = duals.drop("mass").join(tilted, ["src_null", "src"]).withColumn("gap", F.abs(F.col("mass") / F.col("target") - 1))
        stepped = stepped.withColumn("dual", F.col("dual") + F.col("target") / F.col("mass") - 1).select(*duals.drop("mass", "gap").columns, "gap")
        duals = stage(stepped, "mix-dual")
        if (duals.agg(F.max("gap")).first()[0] or 0.0) < tolerance:
            break
        duals = duals.drop("gap")
    else:
        raise ArithmeticError(f"the duals have not converged to {tolerance} after {max_steps} steps")
    return duals.drop("gap")


def _measured(docs: DataFrame, seed: str, whole_rows: bool = False) -> DataFrame:
    """Source, size and place in the md5 order of every row, and the row itself if asked for."""
    at = {n: F.col(f"c{i}") for i, n in enumerate(docs.columns)}
    return numbered(docs).select(
        *([F.struct(*at.values()).alias("whole_row")] if whole_rows else []),
        at["doc_id"].alias("doc_id"),
        at["source"].isNull().alias("src_null"),
        F.coalesce(at["source"], F.lit("")).alias("src"),
        word_count(at["text"]).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(at["doc_id"].cast("string"), F.lit("")))).alias("turn"),
    )


def _bucketed(measured: DataFrame, rows: int) -> DataFrame:
    """Add the md5 bucket; their number grows with the number of rows."""
    digits = 3
    while 16**digits * BUCKET_ROWS < rows:
        digits += 1
    return measured.withColumn("bucket", F.substring("turn", 1, digits))


def mix_plan(sizes: DataFrame, cap: float, cycle: int, tolerance: float, max_steps: int) -> DataFrame:
    """One row per source: target, rate, whole copies, the words left for one more copy, and the bucket in which they run out."""
    histogram = stage(sizes.groupBy("src_null", "src", "size").agg(F.count(F.lit(1)).alias("docs")), "mix-hist")
    duals = newton_duals(histogram, source_targets(sizes, cap, cycle), tolerance, max_steps)
    rate = F.coalesce(F.least(F.exp("dual"), F.lit(float(cap))), F.lit(0.0))
    rates = duals.withColumn("rate", rate).withColumn("whole", F.floor(rate + 1e-9).cast("int"))
    rates = rates.withColumn("goal", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    running = Window.partitionBy("src_null", "src").orderBy("bucket")
    cut = (
        sizes.groupBy("src_null", "src", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("upto", F.sum("words").over(running))
        .join(rates.select("src_null", "src", "goal"), ["src_null", "src"])
        .where((F.col("upto") - F.col("words") < F.col("goal")) & (F.col("goal") <= F.col("upto")))
        .groupBy("src_null", "src")
        .agg(F.min(F.struct("bucket", (F.col("goal") - F.col("upto") + F.col("words")).alias("left"))).alias("cut"))
    )
    return stage(rates.join(cut, ["src_null", "src"], "left"), "mix-plan")


def _with_copies(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """Add the plan's columns and the number of copies to measured rows."""
    placed = measured.join(plan, ["src_null", "src"])
    ends_here = F.col("bucket") == F.col("cut.bucket")
    known = placed.where(~F.coalesce(ends_here, F.lit(False))).withColumn(
        "extra", F.coalesce(F.col("bucket") < F.col("cut.bucket"), F.col("goal") > 0).cast("int")
    )
    in_order = Window.partitionBy("src_null", "src").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    split = placed.where(ends_here).withColumn(
        "extra", (F.sum("size").over(in_order) - F.col("size") / 2 <= F.col("cut.left")).cast("int")
    )
    return known.unionByName(split).withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.col("extra")).cast("int"))


def mix_sources(
    docs: DataFrame, cap: float = 3.0, cycle: int = 3, seed: str = "mix", tolerance: float = 1e-10, max_steps: int = 100
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, rate for every row of ``docs``.

    ``seed`` fixes the order in which documents get their last copy, so reruns agree on any partitioning.
    """
    sizes = stage(_measured(docs, seed), "mix-size")
    sizes = _bucketed(sizes, sizes.count())
    out = _with_copies(sizes, mix_plan(sizes, cap, cycle, tolerance, max_steps))
    return out.select(
        "doc_id",
        F.when(~F.col("src_null"), F.col("src")).alias("source"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "copies",
        "rate",
    )


def mixed_documents(
    docs: DataFrame, cap: float = 3.0, cycle: int = 3, seed: str = "mix", tolerance: float = 1e-10, max_steps: int = 100
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with the columns of ``docs``."""
    sizes = stage(_measured(docs, seed), "mix-size")
    n = sizes.count()
    plan = mix_plan(_bucketed(sizes, n), cap, cycle, tolerance, max_steps)
    rows = _with_copies(_bucketed(_measured(docs, seed, whole_rows=True), n), plan).where("copies > 0")
    return rows.select("whole_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole_row.*").toDF(*docs.columns)
