"""Translation strategies as chains of projections and model steps.

Each strategy takes rows with an id and a sentence and returns them with a translation. A chain is one lazy plan; every model step sends distinct prompts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import prompts as PR
from corpusloom.functions import text as T
from corpusloom.operators.inference import Backend, EchoBackend, Sampling, generate, score

Factory = Callable[[], Backend]


def ask(df: DataFrame, prompt: Column, out: str, factory: Factory = EchoBackend, sampling: Sampling = Sampling()) -> DataFrame:
    """Add ``out``, the first answer to the prompt, trimmed."""
    asked = df.withColumn("_prompt", prompt)
    answers = generate(asked, "_prompt", factory, sampling).select(F.col("prompt").alias("_prompt"), T.strip(F.get("candidates", F.lit(0))).alias(out))
    return asked.join(answers, "_prompt").drop("_prompt")


def vanilla(df: DataFrame, src: str, tgt: str, key: int = 11, demonstrations: str | None = None, factory: Factory = EchoBackend) -> DataFrame:
    """Few-shot prompt; the first line of the answer."""
    prompt = PR.Format.numbered(key, src, tgt).column(F.col(demonstrations) if demonstrations else None, F.col("sentence"))
    out = ask(df, prompt, "translation", factory)
    return out.withColumn("translation", F.get(F.split("translation", "\n"), F.lit(0)))


def reasoned(df: DataFrame, src: str, tgt: str, factory: Factory = EchoBackend) -> DataFrame:
    """Reason first, then read the translation off the reasoning in a second pass."""
    first = F.concat(F.lit(f"Think step by step about how to translate this {src} sentence into {tgt}.\n"), F.col("sentence"))
    thought = ask(df, first, "_thought", factory)
    second = F.concat(F.lit(f"Give only the final {tgt} translation found in this reasoning.\n"), F.col("_thought"))
    return ask(thought, second, "translation", factory).drop("_thought")


def with_knowledge(df: DataFrame, src: str, tgt: str, factory: Factory = EchoBackend, id_column: str = "id") -> DataFrame:
    """Three kinds of knowledge, four translations (one without any), the one with the best quality score; the first of several."""
    kinds = {"keywords": "List the keywords and their translations", "topics": "Name the topics", "demonstration": "Write a related sentence and its translation"}
    out = df
    for name, task in kinds.items():
        out = ask(out, F.concat(F.lit(f"{task} ({src} to {tgt}).\n"), F.col("sentence")), f"_{name}", factory)
    plain = F.concat(F.lit(f"Translate from {src} to {tgt}.\n"), F.col("sentence"))
    out = ask(out, plain, "_t0", factory)
    for i, name in enumerate(kinds, 1):
        out = ask(out, F.concat(F.lit(f"{name}: "), F.col(f"_{name}"), F.lit("\n"), plain), f"_t{i}", factory)
    rows = out.select(id_column, "sentence", F.posexplode(F.array(*[F.col(f"_t{i}") for i in range(4)])).alias("pos", "candidate"))
    best = score(rows, "sentence", "candidate", factory=factory).groupBy(id_column).agg(F.max_by("candidate", F.struct("score", (-F.col("pos")).alias("p"))).alias("translation"))
    return df.join(best, id_column)


def step_by_step(df: DataFrame, src: str, tgt: str, factory: Factory = EchoBackend) -> DataFrame:
    """Research, draft, refine, proofread; each step sees what came before."""
    said = F.concat(F.lit(f"{src}: "), F.col("sentence"))
    out = ask(df, F.concat(F.lit("Note what is hard to translate.\n"), said), "_research", factory)
    out = ask(out, F.concat(F.lit(f"Draft a {tgt} translation.\nNotes: "), F.col("_research"), F.lit("\n"), said), "_draft", factory)
    out = ask(out, PR.refine_prompt(F.col("sentence"), F.col("_draft"), src, tgt), "_refined", factory)
    out = ask(out, F.concat(F.lit(f"Proofread this {tgt} text.\n"), F.col("_refined")), "translation", factory)
    return out.drop("_research", "_draft", "_refined")


def estimate_and_refine(df: DataFrame, src: str, tgt: str, factory: Factory = EchoBackend) -> DataFrame:
    """Translate, estimate errors, refine with the estimate."""
    out = ask(df, F.concat(F.lit(f"Translate from {src} to {tgt}.\n"), F.col("sentence")), "_draft", factory)
    out = ask(out, F.concat(F.lit("List the errors.\n"), F.col("sentence"), F.lit("\n"), F.col("_draft")), "_errors", factory)
    prompt = F.concat(F.lit("Errors: "), F.col("_errors"), F.lit("\n"), PR.refine_prompt(F.col("sentence"), F.col("_draft"), src, tgt))
    return ask(out, prompt, "translation", factory).drop("_draft", "_errors")


def refined(df: DataFrame, src: str, tgt: str, times: int, factory: Factory = EchoBackend) -> DataFrame:
    """Refine an existing translation so many times."""
    for _ in range(times):
        df = ask(df.withColumnRenamed("translation", "_old"), PR.refine_prompt(F.col("sentence"), F.col("_old"), src, tgt), "translation", factory).drop("_old")
    return df


def divided(df: DataFrame, n: int, factory: Factory = EchoBackend) -> DataFrame:
    """Add propositions, at most n short ones of the sentence."""
    out = ask(df, F.concat(F.lit(f"Divide this sentence into at most {n} short propositions. Number them.\n"), F.col("sentence")), "_answer", factory)
    return out.withColumn("propositions", T.proposition_items(F.col("_answer"), n)).drop("_answer")


def with_analysis(df: DataFrame, analysis: Column, src: str, tgt: str, factory: Factory = EchoBackend) -> DataFrame:
    """Translate with a linguistic analysis of the sentence (tags, morphology, dependencies, names), given as a column by any parser."""
    prompt = F.concat(F.lit("Analysis: "), analysis, F.lit(f"\nTranslate from {src} to {tgt}.\n"), F.col("sentence"))
    return ask(df, prompt, "translation", factory)


def dependency_parts(words: list[str], heads: list[int], most: int = 4) -> list[str]:
    """Cut a parsed sentence (head index of each word, itself for the root) at its root, and the parts again until they are short; in order of their place.

    The subtrees of a root's children are parts; the root stays with the words that no child takes.
    """

    def parts(nodes: list[int], root: int) -> list[list[int]]:
        if len(nodes) <= most:
            return [nodes]
        children = [n for n in nodes if heads[n] == root and n != root]
        inside = set(nodes)
        taken: set[int] = set()
        out: list[list[int]] = []
        for child in children:
            tree, todo = {child}, [child]
            while todo:
                now = todo.pop()
                for n in inside:
                    if heads[n] == now and n not in tree and n != root:
                        tree.add(n)
                        todo.append(n)
            taken |= tree
            out += parts(sorted(tree), child)
        rest = [n for n in nodes if n not in taken]
        return [*out, rest] if rest else out

    roots = [i for i, h in enumerate(heads) if h == i]
    found = [p for r in roots for p in parts(sorted(_tree(heads, r)), r)]
    return [" ".join(words[i] for i in p) for p in sorted(found)]


def split_by_dependencies(df: DataFrame, words: str, heads: str, most: int = 4) -> DataFrame:
    """Add parts array<string>: dependency_parts() of every parsed row, in Arrow batches; null where the parse is."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [None if w is None or h is None else dependency_parts(w, h, most) for w, h in zip(batch[words].to_pylist(), batch[heads].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.string()))], names=[*batch.schema.names, "parts"])

    return df.mapInArrow(run, f"{kinds}, parts array<string>")


def _tree(heads: list[int], root: int) -> set[int]:
    out = {root}
    grown = True
    while grown:
        more = {i for i, h in enumerate(heads) if h in out} - out
        grown = bool(more)
        out |= more
    return out


def seq2seq(df: DataFrame, src: str, tgt: str, factory: Factory = EchoBackend, beams: int = 5) -> DataFrame:
    """The sentence itself is the prompt of a translation model, which knows both languages."""
    return ask(df, F.col("sentence"), "translation", factory, Sampling(num_beams=beams))


# What an analysis of each kind tells, for the prompt.
ANALYSES = {"pos": "Parts of speech", "morph": "Morphology", "dep": "Dependencies", "ner": "Names"}


def analysed(df: DataFrame, kind: str, src: str, tgt: str, parser: Callable[[Column], Column] | None = None, factory: Factory = EchoBackend) -> DataFrame:
    """Translate with one kind of linguistic analysis, made of the sentence by ``parser``; kind 'none' shows no analysis."""
    if kind == "none":
        return ask(df, F.concat(F.lit(f"Translate from {src} to {tgt}.\n"), F.col("sentence")), "translation", factory)
    if parser is None:
        raise ValueError(f"an analysis of kind {kind} needs a parser")
    return with_analysis(df, F.concat(F.lit(f"{ANALYSES[kind]}: "), parser(F.col("sentence"))), src, tgt, factory)


def best_of(df: DataFrame, src: str, tgt: str, n: int, factory: Factory = EchoBackend, id_column: str = "id") -> DataFrame:
    """Reason n times, read a translation off each, and keep the one with the best quality score; the first of several."""
    first = F.concat(F.lit(f"Think step by step about how to translate this {src} sentence into {tgt}.\n"), F.col("sentence"))
    asked = df.withColumn("_prompt", first)
    thoughts = generate(asked, "_prompt", factory, Sampling(num_return_sequences=n, temperature=1.0 if n > 1 else 0.0))
    rows = asked.join(thoughts.select(F.col("prompt").alias("_prompt"), "candidates"), "_prompt").select(id_column, "sentence", F.posexplode("candidates").alias("pos", "_thought"))
    rows = ask(rows, F.concat(F.lit(f"Give only the final {tgt} translation found in this reasoning.\n"), F.col("_thought")), "candidate", factory)
    best = score(rows, "sentence", "candidate", factory=factory).groupBy(id_column).agg(F.max_by("candidate", F.struct("score", (-F.col("pos")).alias("p"))).alias("translation"))
    return df.join(best, id_column)


def merged(parents: DataFrame, children: DataFrame, src: str, tgt: str, good: Callable[[Column], Column] | None = None, factory: Factory = EchoBackend) -> DataFrame:
    """Add translation to parents (id, sentence) from those of their parts: children (id, pos, text, translation).

    Parts whose translation is blank or not ``good`` are left out; a parent without any is translated by itself. The answer ends at its first blank line.
    """
    usable = T.strip(F.coalesce("translation", F.lit(""))) != ""
    kept = children.where(usable & good(F.col("translation")) if good else usable)
    lists = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "translation"))).alias("_parts"))
    plain = F.concat(F.lit(f"Translate from {src} to {tgt}.\n"), F.col("sentence"))
    prompt = F.when(F.col("_parts").isNull(), plain).otherwise(PR.merge_prompt(F.col("sentence"), F.col("_parts")["text"], F.col("_parts")["translation"], src, tgt))
    out = ask(parents.join(lists, "id", "left"), prompt, "translation", factory).drop("_parts")
    return out.withColumn("translation", T.strip(F.get(F.split("translation", "\n\n"), F.lit(0))))


def quality(df: DataFrame, source: str, candidate: str, reference: str | None = None, low: float | None = None, high: float | None = None, lower_is_better: bool = False, factory: Factory = EchoBackend) -> DataFrame:
    """Add score, cut to low..high, and quality, which is higher for better candidates whatever the direction of the score; both are null without a candidate."""
    out = score(df, source, candidate, reference, factory)
    value = F.col("score")
    if low is not None:
        value = F.when(value < low, F.lit(float(low))).otherwise(value)
    if high is not None:
        value = F.when(value > high, F.lit(float(high))).otherwise(value)
    return out.withColumn("score", value).withColumn("quality", -F.col("score") if lower_is_better else F.col("score"))


STRATEGIES = {"vanilla": vanilla, "cot": reasoned, "maps": with_knowledge, "step_by_step": step_by_step, "tear": estimate_and_refine, "nllb": seq2seq}


def translate(df: DataFrame, method: str, src: str, tgt: str, factory: Factory = EchoBackend, **settings) -> DataFrame:
    """Translate by the method's name: those of STRATEGIES, the kinds of ANALYSES, or 'none'."""
    if method in STRATEGIES:
        return STRATEGIES[method](df, src, tgt, factory=factory, **settings)
    if method in ANALYSES or method == "none":
        return analysed(df, method, src, tgt, factory=factory, **settings)
    raise ValueError(f"unknown method {method}")
