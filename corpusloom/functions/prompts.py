"""Prompts and chat transcripts as columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Translation prompt formats by number, as (header, prefix, middle, suffix). {src}, {tgt} are language names,
# {src_own}, {tgt_own} their own names, {left}, {right} phrases in that language.
FORMATS = {
    1: ("", "Given the following source text: ", ", a good {tgt} translation is: ", "\n\n"),
    2: ("", "Given the following source text in {src}: ", ", a good {tgt} translation is: ", "\n\n"),
    3: ("", "If the original version says ", "then the {tgt} version should say: ", "\n\n"),
    4: ("", "What is the {tgt} translation of the sentence: ", "?\n", "\n\n"),
    5: ("", "", "= {tgt}: ", "\n\n"),
    6: ("", "{src}: ", "= {tgt}: ", "\n\n"),
    7: ("", "{src}\n", "\ntranslates into\n{tgt}\n", "\n###\n"),
    8: ("", "{src_own}\n", "\ntranslates into\n{tgt_own}\n", "\n###\n"),
    9: ("", "{src}: ", "\n{tgt}: ", "\n###\n"),
    10: ("", "{src_own}: ", "\n{tgt_own}: ", "\n###\n"),
    11: ("", "{src} sentence\n", "\n{tgt} translation\n", "\n###\n"),
    12: ("", "{left}\n", "\n{right}\n", "\n###\n"),
    13: ("", "Write a {tgt} translation of the following {src} sentence.\n", "\n", "\n###\n"),
    14: ("", "Translate this from {src} to {tgt}:\n{src}: ", "\n{tgt}: ", "\n###\n"),
    15: (
        "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.\n",
        "###Instruction:\nTranslate the following sentences from {src} to {tgt}\n###Input:\n",
        "\n###Response:",
        "\n\n",
    ),
    16: ("", "Translate to {tgt}: ", "", "\n###\n"),
    17: ("", "Translate this from {src} to {tgt}:\n{src}: ", "\n{tgt}: <think>", "\n###\n"),
}
OWN_NAMES = {"English": "English", "French": "Français", "German": "Deutsch", "Swahili": "Kiswahili", "Wolof": "Wolof", "Hindi": "हिन्दी", "Spanish": "Español", "Japanese": "日本語"}
LEFT = {"English": "English sentence", "French": "Phrase en français", "German": "Satz auf Deutsch", "Swahili": "Sentensi ya Kiswahili", "Wolof": "Mbindum wolof"}
RIGHT = {"English": "French translation", "French": "Traduction en français", "German": "Deutsche Übersetzung", "Swahili": "Tafsiri ya Kiswahili", "Wolof": "Mbinde buñu sirri si wolof"}


@dataclass(frozen=True)
class Format:
    """A few-shot prompt: header, then prefix x middle y suffix for each demonstration, then prefix x middle."""

    header: str
    prefix: str
    middle: str
    suffix: str

    @classmethod
    def numbered(cls, key: int, src: str, tgt: str) -> Format:
        names = {"src": src, "tgt": tgt, "src_own": OWN_NAMES.get(src, src), "tgt_own": OWN_NAMES.get(tgt, tgt), "left": LEFT.get(src, ""), "right": RIGHT.get(tgt, "")}
        return cls(*[part.format(**names) for part in FORMATS[key]])

    def renamed(self, old: str, new: str) -> Format:
        """For another language; the suffix stays."""
        return replace(self, header=self.header.replace(old, new), prefix=self.prefix.replace(old, new), middle=self.middle.replace(old, new))

    def column(self, demonstrations: Column | None, example: Column) -> Column:
        """The prompt for an array of struct(x, y) and an example; a final blank behind a colon goes."""
        shots = F.lit("")
        if demonstrations is not None:
            shot = lambda d: F.concat(F.lit(self.prefix), d["x"], F.lit(self.middle), d["y"], F.lit(self.suffix))
            shots = F.coalesce(F.array_join(F.transform(demonstrations, shot), ""), F.lit(""))
        prompt = F.concat(F.lit(self.header), shots, F.lit(self.prefix), example, F.lit(self.middle))
        return F.regexp_replace(prompt, ": $", ":") if self.middle.endswith(": ") or not self.middle else prompt


@dataclass(frozen=True)
class ChatStyle:
    """How turns are written: pieces around system, user and assistant contents, and what opens and closes the transcript."""

    system: tuple[str, str]
    user: tuple[str, str]
    assistant: tuple[str, str]
    start: str = ""
    end: str = ""
    default_system: str = ""


_HELP = "You are a helpful assistant."
# Public chat formats.
STYLES = {
    "mistral": ChatStyle(("[INST] ", " [/INST]"), ("[INST] ", " [/INST]"), ("", "</s> "), "<s> "),
    "x-alma": ChatStyle(("<<SYS>>\n", "<</SYS>>\n\n"), ("", " [/INST]"), ("", "</s><s>[INST] "), "<s>[INST] "),
    "zephyr": ChatStyle(("<|system|>\n", "</s> \n"), ("<|user|>\n", "</s> "), ("\n<|assistant|>\n", "</s> \n")),
    "llama-2": ChatStyle(("<s> [INST] <<SYS>>\n", "\n<</SYS>>\n\n"), ("", " [/INST]"), (" ", " </s><s> [INST] "), default_system="You are a helpful, respectful and honest assistant."),
    "mixtral": ChatStyle(("", "\n"), ("<s>[INST]", "[/INST]"), ("", "</s>")),
    "llama-3": ChatStyle(
        ("<|start_header_id|>system<|end_header_id|>\n\n", "<|eot_id|>"), ("<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|>"),
        ("<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>"), "<|begin_of_text|>", "<|start_header_id|>assistant<|end_header_id|>\n\n", _HELP),
    "llama-3.1": ChatStyle(
        ("<|start_header_id|>system<|end_header_id|>\n\nCutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024\n\n", "<|eot_id|>"),
        ("<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|>"), ("<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>"),
        "<|begin_of_text|>", "<|start_header_id|>assistant<|end_header_id|>\n\n", _HELP),
    "llama-4": ChatStyle(
        ("<|header_start|>system<|header_end|>\n\n", "<|eot|>"), ("<|header_start|>user<|header_end|>\n\n", "<|eot|>"),
        ("<|header_start|>assistant<|header_end|>\n\n", "<|eot|>"), "<|begin_of_text|>", "<|header_start|>assistant<|header_end|>\n\n", "You are a helpful assistant"),
    "gemma": ChatStyle(("<start_of_turn>user\n", "<end_of_turn>\n"), ("<start_of_turn>user\n", "<end_of_turn>\n"), ("<start_of_turn>model\n", "<end_of_turn>\n"), "<bos>", "<start_of_turn>model\n"),
    "qwen-2.5": ChatStyle(("<|im_start|>system\n", "<|im_end|>\n"), ("<|im_start|>user\n", "<|im_end|>\n"), ("<|im_start|>assistant\n", "<|im_end|>\n"), "", "<|im_start|>assistant\n"),
    "qwen-3": ChatStyle(("<|im_start|>system\n", "<|im_end|>\n"), ("<|im_start|>user\n", "<|im_end|>\n"), ("<|im_start|>assistant\n", "<|im_end|>\n"), "", "<|im_start|>assistant\n"),
    "qwen-3-no-thinking": ChatStyle(
        ("<|im_start|>system\n", "<|im_end|>\n"), ("<|im_start|>user\n", "<|im_end|>\n"), ("<|im_start|>assistant\n", "<|im_end|>\n"), "", "<|im_start|>assistant\n<think>\n\n</think>\n\n"),
    "deepseek-r1": ChatStyle(("", ""), ("<｜User｜>", ""), ("<｜Assistant｜>", "<｜end▁of▁sentence｜>"), "<｜begin▁of▁sentence｜>", "<｜Assistant｜>"),
    "command-r": ChatStyle(
        ("<BOS_TOKEN><|START_OF_TURN_TOKEN|><|SYSTEM_TOKEN|>", "<|END_OF_TURN_TOKEN|>"), ("<|START_OF_TURN_TOKEN|><|USER_TOKEN|>", "<|END_OF_TURN_TOKEN|>"),
        ("<|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>", "<|END_OF_TURN_TOKEN|>"), "", "<|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>"),
    "command-a": ChatStyle(
        ("<BOS_TOKEN><|START_OF_TURN_TOKEN|><|SYSTEM_TOKEN|>", "<|END_OF_TURN_TOKEN|>"), ("<|START_OF_TURN_TOKEN|><|USER_TOKEN|>", "<|END_OF_TURN_TOKEN|>"),
        ("<|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|><|START_RESPONSE|>", "<|END_RESPONSE|><|END_OF_TURN_TOKEN|>"), "", "<|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>"),
    "plain": ChatStyle(("", "\n"), ("", "\n"), ("", "\n")),
}


def rendered(turns: Column, style: ChatStyle) -> Column:
    """The transcript of an array of struct(role, text) in order. System contents are trimmed and stand first."""
    write = lambda p, c: F.concat(F.lit(p[0]), c, F.lit(p[1]))
    system = F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "system"), lambda t: write(style.system, F.trim(t["text"]))), "")
    if style.default_system:
        system = F.when(system == "", F.lit(style.system[0] + style.default_system + style.system[1])).otherwise(system)
    rest = F.filter(turns, lambda t: t["role"] != "system")
    body = F.array_join(F.transform(rest, lambda t: F.when(t["role"] == "user", write(style.user, t["text"])).otherwise(write(style.assistant, t["text"]))), "")
    return F.concat(F.lit(style.start), system, body, F.lit(style.end))


def render_conversations(messages: DataFrame, style: str) -> DataFrame:
    """conv_id, prompt from rows conv_id, turn, role, text."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", rendered(F.col("turns"), STYLES[style]).alias("prompt"))


def numbered(items: Column, start: int = 1) -> Column:
    """'1. a\\n2. b'."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + start).cast("string"), F.lit(". "), x)), "\n")


def merge_prompt(sentence: Column, parts: Column, translations: Column, src: str, tgt: str) -> Column:
    """Asks for a translation of a sentence given those of its parts, in order."""
    pairs = F.zip_with(parts, translations, lambda a, b: F.concat(F.lit(f"{src}: "), a, F.lit(f"\n{tgt}: "), b))
    return F.concat(F.lit("Given these translations of its parts:\n\n"), F.array_join(pairs, "\n\n"), F.lit(f"\n\nTranslate the sentence from {src} to {tgt}.\n{src}: "), sentence, F.lit(f"\n{tgt}:"))


def refine_prompt(sentence: Column, draft: Column, src: str, tgt: str) -> Column:
    return F.concat(F.lit(f"Improve this {tgt} translation of a {src} sentence.\n{src}: "), sentence, F.lit("\nDraft: "), draft, F.lit(f"\n{tgt}:"))


def topic_prompt(language: Column, topic: Column, examples: Column, n: int) -> Column:
    """Asks for n paragraphs on a topic in the style of numbered examples."""
    return F.concat(F.lit(f"Write {n} paragraphs in "), language, F.lit(" about "), topic, F.lit(". Number them.\nExamples:\n"), numbered(examples))


def neighbour_prompt(examples: Column) -> Column:
    """Examples from the most similar on (they come least similar first), and a slot for a new one."""
    return F.concat(F.lit("Write one more text like these.\n"), numbered(F.reverse(examples)), F.lit("\n"), (F.size(examples) + 1).cast("string"), F.lit("."))


def judge_prompt(source: Column, a: Column, b: Column) -> Column:
    return F.concat(F.lit("Which translation is better?\nSource: "), source, F.lit("\nA: "), a, F.lit("\nB: "), b, F.lit("\nEnd with [RESULT] A, B or TIE."))


def metric_input(candidate: Column, other: Column, kind: str = "reference") -> Column:
    """'candidate: ... reference: ...' (or source)."""
    return F.concat(F.lit("candidate: "), candidate, F.lit(f" {kind}: "), other)


def metric_tokens(ids: Column, most: int = 1024, end: int = 1) -> Column:
    """Token ids as a learned metric takes them: at most ``most``, and without an end token behind them."""
    cut = F.slice(ids, 1, most)
    return F.when(F.element_at(cut, -1) == end, F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def sample_text(source: Column, target: Column | None = None, src: str = "English", tgt: str = "French") -> Column:
    """Fixed form of a training example: an instruction with both sides, or the source alone."""
    if target is None:
        return source
    return F.concat(F.lit(f"Translate this from {src} to {tgt}:\n{src}: "), source, F.lit(f"\n{tgt}: "), target)


MERGES = ("vanilla", "refine", "norefine", "zero-shot")


def merge_task(kind: str, sentence: Column, parts: Column, translations: Column, src: str, tgt: str) -> Column:
    """Asks for a translation of a sentence from those of its parts, in one of four forms.

    'vanilla' shows the parts' translations as examples; 'norefine' asks to combine them, in section II of the answer; 'refine' asks for a draft in section II and a
    better one in section III; 'zero-shot' shows no parts. final_line() reads the answers.
    """
    if kind not in MERGES:
        raise ValueError(f"unknown merge {kind}")
    pairs = F.array_join(F.zip_with(parts, translations, lambda a, b: F.concat(F.lit(f"{src}: "), a, F.lit(f"\n{tgt}: "), b)), "\n\n")
    last = F.concat(F.lit(f"{src}: "), sentence, F.lit(f"\n{tgt}:"))
    if kind == "zero-shot":
        return F.concat(F.lit(f"Translate from {src} to {tgt}.\n\n"), last)
    if kind == "vanilla":
        return F.concat(pairs, F.lit("\n\n"), last)
    steps = "Write under 'I. Parts' which parts help, and under 'II. Final translation' the translation made of them."
    if kind == "refine":
        steps = "Write under 'I. Parts' which parts help, under 'II. Final translation' a draft made of them, and under 'III. Final translation' a better one."
    return F.concat(F.lit(f"These are parts of a {src} sentence with {tgt} translations, some of which may be wrong.\n\n"), pairs, F.lit(f"\n\n{steps}\n\n"), last)


DIVISIONS = {
    "vanilla": "Divide this sentence into short propositions of its own words that say what it says, one a line and numbered.",
    "French": "Divise cette phrase en courtes propositions faites de ses propres mots, une par ligne et num\u00e9rot\u00e9es.",
    "paraphrase": "Write short sentences that each say a part of this sentence in other words, one a line and numbered.",
    "paraphrase-3": "Write three paraphrases of this sentence, one a line and numbered.",
}


def division_task(kind: str, sentence: Column, demonstrations: list[tuple[str, list[str]]] = ()) -> Column:
    """Asks to divide a sentence, in one of four forms, after demonstrations of (sentence, parts)."""
    shown = "".join(f"Sentence: {s}\n" + "".join(f"{i}. {p}\n" for i, p in enumerate(parts, 1)) + "\n" for s, parts in demonstrations)
    return F.concat(F.lit(f"{DIVISIONS[kind]}\n\n{shown}Sentence: "), sentence, F.lit("\n1."))


_SCALE = "from 0 (no meaning kept) to 100 (perfect meaning and grammar)"
_STARS = "with one to five stars"
_CLASSES = "as one of: No meaning preserved, Some meaning preserved but not understandable, Some meaning preserved and understandable, Most meaning preserved, Perfect translation"
# Judges by name: what they ask for, and whether they see a reference.
JUDGES = {
    "score": (f"Score the translation {_SCALE}. Answer with the number.", False),
    "score-ref": (f"Score the translation against the reference {_SCALE}. Answer with the number.", True),
    "quality": (f"Say how good the translation is {_SCALE}, where 33 keeps some meaning and 66 most of it. Answer with the number.", False),
    "quality-ref": (f"Say how good the translation is next to the reference {_SCALE}, where 33 keeps some meaning and 66 most of it. Answer with the number.", True),
    "stars": (f"Rate the translation {_STARS}.", False),
    "stars-ref": (f"Rate the translation against the reference {_STARS}.", True),
    "class": (f"Classify the translation {_CLASSES}.", False),
    "class-ref": (f"Classify the translation against the reference {_CLASSES}.", True),
}


def judge_task(name: str, source: Column, translation: Column, src: str, tgt: str, reference: Column | None = None) -> Column:
    """Asks a judge by name; those that end in '-ref' need a reference, the others see none. The parsers of scores, stars and classes read the answers."""
    task, wants = JUDGES[name]
    if wants and reference is None:
        raise ValueError(f"the judge {name} needs a reference")
    shown = [F.lit(f"{task}\n\n{src} source: "), source]
    if wants:
        shown += [F.lit(f"\n{tgt} reference: "), reference]
    return F.concat(*shown, F.lit(f"\n{tgt} translation: "), translation, F.lit("\nAnswer:"))


def rubric_task(instruction: Column, a: Column, b: Column, rubric: Column, reference: Column | None = None) -> Column:
    """Asks for feedback by a rubric and the better of two responses; the answer ends in [RESULT] A or B."""
    middle = [F.lit("\n\nReference:\n"), reference] if reference is not None else []
    return F.concat(
        F.lit("Compare two responses by the rubric alone. Write feedback, then '[RESULT] A' or '[RESULT] B', and nothing else.\n\nInstruction:\n"), instruction, F.lit("\n\nResponse A:\n"), a,
        F.lit("\n\nResponse B:\n"), b, *middle, F.lit("\n\nRubric:\n"), rubric, F.lit("\n\nFeedback:"),
    )


def topic_task(language: Column, topic: Column, examples: Column, phrases: Column, n: int, most_paragraphs: int = 3) -> Column:
    """Asks for n numbered texts of at most so many paragraphs on a topic, after examples in other languages and numbered phrases in the language itself, if there are any."""
    told = F.when(F.size(phrases) > 0, F.concat(F.lit("Phrases in "), language, F.lit(":\n"), numbered(phrases), F.lit("\n\n"))).otherwise(F.lit(""))
    shown = F.when(F.size(examples) > 0, F.concat(F.lit("Examples:\n"), F.array_join(examples, "\n\n"), F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(F.lit(f"Write {n} texts of one to {most_paragraphs} paragraphs in "), language, F.lit(" about "), topic, F.lit(". Number them and write nothing else.\n\n"), shown, told, F.lit("1."))
