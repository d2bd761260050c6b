"""Snowball stemmers as Column expressions: tables of endings, each with the region in which it counts and what takes its place.

A step finds the longest of its endings and does nothing if that one's conditions fail. R1 starts after the first non-vowel that follows a vowel, R2 is
R1 of R1, RV is as the Spanish stemmer defines it. Regions are fixed before the first step. Words are expected in lower case; null stays null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let


@dataclass(frozen=True)
class Rule:
    """Endings that go if they lie in a region and what stands before them matches ``after``; then ``put`` takes their place, or ``then`` goes on with the rest."""

    endings: str
    region: str = ""
    put: str = ""
    after: str = ""
    then: tuple[Rule, ...] = ()
    fix: Callable[[Column, Column], Column] | None = None


def _longest(word: Column, endings: list[str]) -> Column:
    """The longest of the endings that the word has, else an empty string: last letters are looked up, longest first, which costs a tenth of a pattern's search."""
    sizes = sorted({len(e) for e in endings}, reverse=True)
    last = {n: F.right(word, F.lit(n)) for n in sizes}
    return F.coalesce(*[F.when(last[n].isin([e for e in endings if len(e) == n]), last[n]) for n in sizes], F.lit(""))


def _head(word: Column, ending: Column) -> Column:
    return F.left(word, F.length(word) - F.length(ending))


def step(word: Column, at: Column, rules: tuple[Rule, ...], within: str = "") -> Column:
    """The word after one step; with ``within``, only endings that lie in that region are looked at."""
    endings = [e for r in rules for e in r.endings.split()]
    seen = F.substring(word, at[within] + 1, F.length(word)) if within else word

    def decide(parts: Column) -> Column:
        ending, head = parts["ending"], parts["head"]
        out = F.when(ending == "", word)
        for r in rules:
            ok = F.lit(True)
            if r.region:
                ok = F.length(head) >= at[r.region]
            if r.after:
                ok = ok & head.rlike(f"{r.after}$")
            new = r.fix(head, at) if r.fix else step(head, at, r.then) if r.then else F.concat(head, F.lit(r.put))
            out = out.when(ending.isin(r.endings.split()), F.when(ok, new).otherwise(word))
        return out.otherwise(word)

    return let(_longest(seen, endings), lambda e: let(F.struct(e.alias("ending"), _head(word, e).alias("head")), decide))


def _chain(word: Column, at: Column, steps: list[Callable[[Column, Column], Column]]) -> Column:
    if not steps:
        return word
    return let(steps[0](word, at), lambda w: _chain(w, at, steps[1:]))


def _region(word: Column, pattern: str, start: Column) -> Column:
    """Where the region behind the first match of pattern starts, counted from ``start``; the end of the word if there is none."""
    found = F.length(F.regexp_extract(F.substring(word, start + 1, F.length(word)), f"^(?:{pattern})", 0))
    return F.when(found > 0, start + found).otherwise(F.length(word))


def _rules(*rules: Rule, within: str = "") -> Callable[[Column, Column], Column]:
    return lambda w, at: step(w, at, rules, within)


# The tables of the English stemmer (Porter 2).
EN_VOWEL, EN_OTHER = "[aeiouy]", "[^aeiouy]"
EN_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
EN_KEPT = "inning outing canning herring earring proceed exceed succeed".split()
EN_R1 = f"gener|commun|arsen|.*?{EN_VOWEL}{EN_OTHER}"
EN_SHORT = f"(^{EN_VOWEL}{EN_OTHER}|{EN_OTHER}{EN_VOWEL}[^aeiouywxY])$"


def _after_verb_ending(head: Column, at: Column) -> Column:
    short = head.rlike(EN_SHORT) & (F.length(head) <= at["r1"])
    double = head.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
    return F.when(head.rlike("(at|bl|iz)$"), F.concat(head, F.lit("e"))).when(double, F.left(head, F.length(head) - 1)).when(short, F.concat(head, F.lit("e"))).otherwise(head)


def _last_e(head: Column, at: Column) -> Column:
    gone = (F.length(head) >= at["r2"]) | ((F.length(head) >= at["r1"]) & ~head.rlike(EN_SHORT))
    return F.when(gone, head).otherwise(F.concat(head, F.lit("e")))


EN_0 = _rules(Rule("'s' 's '"))
EN_1A = _rules(
    Rule("sses", put="ss"),
    Rule("ied ies", fix=lambda head, at: F.concat(head, F.when(F.length(head) > 1, "i").otherwise("ie"))),
    Rule("us ss", after="(?!)"),
    Rule("s", after=f"{EN_VOWEL}.+"),
)
EN_1B = _rules(Rule("eed eedly", "r1", put="ee"), Rule("ed edly ing ingly", after=f"{EN_VOWEL}.*", fix=_after_verb_ending))
EN_1C = _rules(Rule("y Y", put="i", after=f".{EN_OTHER}"))
EN_2 = _rules(
    Rule("tional", "r1", "tion"), Rule("enci", "r1", "ence"), Rule("anci", "r1", "ance"), Rule("abli", "r1", "able"), Rule("entli", "r1", "ent"),
    Rule("izer ization", "r1", "ize"), Rule("ational ation ator", "r1", "ate"), Rule("alism aliti alli", "r1", "al"), Rule("fulness fulli", "r1", "ful"),
    Rule("ousli ousness", "r1", "ous"), Rule("iveness iviti", "r1", "ive"), Rule("biliti bli", "r1", "ble"), Rule("ogi", "r1", "og", after="l"),
    Rule("lessli", "r1", "less"), Rule("li", "r1", after="[cdeghkmnrt]"),
)
EN_3 = _rules(
    Rule("tional", "r1", "tion"), Rule("ational", "r1", "ate"), Rule("alize", "r1", "al"), Rule("icate iciti ical", "r1", "ic"), Rule("ful ness", "r1"), Rule("ative", "r2"),
)
EN_4 = _rules(Rule("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize", "r2"), Rule("ion", "r2", after="[st]"))
EN_5 = _rules(Rule("e", fix=_last_e), Rule("l", "r2", after="l"))


def english_stem(word: Column) -> Column:
    """Porter 2; words of one or two letters stay."""

    def stem(w: Column) -> Column:
        at = let(_region(w, EN_R1, F.lit(0)), lambda r1: F.struct(r1.alias("r1"), _region(w, f".*?{EN_VOWEL}{EN_OTHER}", r1).alias("r2")))
        rest = lambda v, a: F.when(v.isin(EN_KEPT), v).otherwise(_chain(v, a, [EN_1B, EN_1C, EN_2, EN_3, EN_4, EN_5]))
        return F.translate(let(at, lambda a: _chain(w, a, [EN_0, EN_1A, rest])), "Y", "y")

    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "^'", ""), "^y", "Y"), f"({EN_VOWEL})y", "$1Y")
    whole = F.when(F.length(word) <= 2, word)
    for w, s in EN_WHOLE.items():
        whole = whole.when(word == w, F.lit(s))
    return whole.otherwise(let(marked, stem))


# The tables of the German stemmer.
DE_VOWEL, DE_OTHER = "[aeiouyäöü]", "[^aeiouyäöü]"
DE_1 = _rules(Rule("em ern er", "r1"), Rule("e en es", "r1", fix=lambda head, at: F.regexp_replace(head, "niss$", "nis")), Rule("s", "r1", after="[bdfghklmnrt]"))
DE_2 = _rules(Rule("en er est", "r1"), Rule("st", "r1", after=".{3}[bdfghklmnt]"))
DE_3 = _rules(
    Rule("end ung", "r2", then=(Rule("ig", "r2", after="(^|[^e])"),)),
    Rule("ig ik isch", "r2", after="(^|[^e])"),
    Rule("lich heit", "r2", then=(Rule("er en", "r1"),)),
    Rule("keit", "r2", then=(Rule("lich ig", "r2"),)),
)


def german_stem(word: Column) -> Column:
    """The German stemmer: sharp s as ss, endings of inflection and derivation off, umlauts as plain vowels."""

    def stem(w: Column) -> Column:
        cut = f".*?{DE_VOWEL}{DE_OTHER}"
        at = let(_region(w, cut, F.lit(0)), lambda r1: F.struct(F.greatest(r1, F.lit(3)).alias("r1"), _region(w, cut, r1).alias("r2")))
        done = let(at, lambda a: _chain(w, a, [DE_1, DE_2, DE_3]))
        return F.translate(done, "UYäöü", "uyaou")

    marked = F.regexp_replace(word, "ß", "ss")
    for plain, mark in (("u", "U"), ("y", "Y")):
        marked = F.regexp_replace(marked, f"(?<={DE_VOWEL}){plain}(?={DE_VOWEL})", mark)
    return let(marked, stem)


# The tables of the Spanish stemmer.
ES_VOWEL, ES_OTHER = "[aeiouáéíóúü]", "[^aeiouáéíóúü]"
ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
ES_1 = (
    Rule("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos", "r2"),
    Rule("adora ador ación adoras adores aciones ante antes ancia ancias", "r2", then=(Rule("ic", "r2"),)),
    Rule("logía logías", "r2", "log"), Rule("ución uciones", "r2", "u"), Rule("encia encias", "r2", "ente"),
    Rule("amente", "r1", then=(Rule("iv", "r2", then=(Rule("at", "r2"),)), Rule("os ic ad", "r2"))),
    Rule("mente", "r2", then=(Rule("ante able ible", "r2"),)),
    Rule("idad idades", "r2", then=(Rule("abil ic iv", "r2"),)),
    Rule("iva ivo ivas ivos", "r2", then=(Rule("at", "r2"),)),
)
ES_2A = (Rule("ya ye yan yen yeron yendo yo yó yas yes yais yamos", after="u"),)
ES_2B = (
    Rule("en es éis emos", fix=lambda head, at: F.regexp_replace(head, "gu$", "g")),
    Rule(
        "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
        "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen "
        "aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados "
        "idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
    ),
)
ES_3 = (Rule("os a o á í ó"), Rule("e é", fix=lambda head, at: F.when((F.length(head) > at["rv"]) & head.rlike("gu$"), _head(head, F.lit("u"))).otherwise(head)))


def _pronoun(w: Column, at: Column) -> Column:
    def drop(head: Column) -> Column:
        tail = F.substring(head, at["rv"] + 1, F.length(head))
        after = tail.rlike("(i[eé]ndo|[aá]ndo|[aáeéií]r)$") | (tail.rlike("yendo$") & head.rlike("uyendo$"))
        plain = head
        for accented, bare in (("iéndo", "iendo"), ("ándo", "ando"), ("ár", "ar"), ("ér", "er"), ("ír", "ir")):
            plain = F.regexp_replace(plain, f"{accented}$", bare)
        return F.when(after & (F.length(head) < F.length(w)), plain).otherwise(w)

    return let(_head(w, _longest(w, ES_PRONOUNS)), drop)


def _verb(w: Column, at: Column) -> Column:
    """The first of the three that changes the word: standard endings, verb endings in y, other verb endings."""
    other = lambda v: step(v, at, ES_2B, "rv")
    return let(step(w, at, ES_1), lambda a: F.when(a != w, a).otherwise(let(step(w, at, ES_2A, "rv"), lambda b: F.when(b != w, b).otherwise(other(w)))))


def spanish_stem(word: Column) -> Column:
    """The Spanish stemmer: pronouns, endings of derivation, of verbs and of what is left go; then acute accents."""
    cut = f".*?{ES_VOWEL}{ES_OTHER}"
    by_start = F.when(word.rlike(f"^.{ES_OTHER}"), _region(word, f".{ES_OTHER}.*?{ES_VOWEL}", F.lit(0))).when(
        word.rlike(f"^{ES_VOWEL}{ES_VOWEL}"), _region(word, f"{ES_VOWEL}{ES_VOWEL}.*?{ES_OTHER}", F.lit(0))).otherwise(F.least(F.lit(3), F.length(word)))
    at = let(_region(word, cut, F.lit(0)), lambda r1: F.struct(r1.alias("r1"), _region(word, cut, r1).alias("r2"), by_start.alias("rv")))
    done = let(at, lambda a: _chain(word, a, [_pronoun, _verb, lambda v, s: step(v, s, ES_3, "rv")]))
    return F.translate(done, "áéíóú", "aeiou")


STEMMERS: dict[str, Callable[[Column], Column]] = {"english": english_stem, "german": german_stem, "spanish": spanish_stem}


def stemmer(language: str) -> Callable[[Column], Column]:
    """By the language's English name; a language without tables is stemmed as English."""
    return STEMMERS.get(language.lower(), english_stem)
