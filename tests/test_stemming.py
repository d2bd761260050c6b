"""Goldens: words and stems of the sample vocabularies published with the Snowball stemmers."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stemming as ST
from corpusloom.operators import retriever as R

GOLDEN = {
    "english": "consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist "
    "consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol "
    "consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson "
    "consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators "
    "conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant "
    "knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel "
    "kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit "
    "knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock "
    "skies sky dying die news news inning inning proceed proceed hoping hope hopping hop ties tie cries cri by by say say gas gas this this gaps gap kiwis kiwi "
    "generate generat general general agreed agre feed feed happy happi enjoy enjoy youth youth",
    "german": "aufeinander aufeinand aufeinanderfolge aufeinanderfolg aufeinanderfolgen aufeinanderfolg aufeinanderfolgend aufeinanderfolg aufeinanderfolgende "
    "aufeinanderfolg aufeinanderfolgenden aufeinanderfolg auferlegt auferlegt auferlegten auferlegt auferstanden auferstand auferstehen aufersteh auferstehung "
    "aufersteh aufgeben aufgeb aufgeblasen aufgeblas kategorie kategori kategorien kategori kategorisch kategor kategorische kategor kater kat katern kat katze katz "
    "kätzchen katzch kaufleute kaufleut kaum kaum käufer kauf käme kam",
    "spanish": "checa chec checo chec checoslovaquia checoslovaqui chefs chefs chelo chel chemise chemis cheque chequ chequeo cheque cheques chequ chetumaleños chetumaleñ "
    "chi chi chía chi chiapaneca chiapanec chiapas chiap chica chic chicago chicag chicana chican chicano chican chicas chic chicharrones chicharron chicles chicl "
    "tórax torax torcer torc toreado tor toreados tor toreándolo tor torear tor toreara tor torearlo tor toreó tore torero torer toreros torer torio tori tormenta "
    "torment tormentas torment tornado torn tornados torn tornar torn tornen torn torneo torne torneos torne tornillo tornill tornillos tornill torniquete torniquet "
    "torno torn toro tor toronto toront toros tor torpedearon torped torpeza torpez torrado torr torralba torralb torre torr torrencial torrencial torrenciales "
    "torrencial torrente torrent torreón torreon torres torr torrescano torrescan",
}


@pytest.mark.parametrize("language", GOLDEN)
def test_sample_vocabulary(spark, language):
    said = GOLDEN[language].split()
    df = spark.createDataFrame(list(zip(said[::2], said[1::2], strict=True)), "word string, want string")
    got = df.select("word", "want", ST.stemmer(language)(F.col("word")).alias("stem")).collect()
    assert {(r.word, r.stem) for r in got if r.stem != r.want} == set()


def test_hard_words_and_unknown_languages(spark):
    words = [(None,), ("",), ("a",), ("y",), ("'",), ("yyyy",), ("x" * 5000 + "ing",), ("данные",), ("123",), ("ing",)]
    df = spark.createDataFrame(words, "w string")
    for f in ST.STEMMERS.values():
        got = [r[0] for r in df.select(f(F.col("w"))).collect()]
        assert got[0] is None and all(x is not None for x in got[1:])
    assert ST.stemmer("Welsh") is ST.english_stem and ST.stemmer("German") is ST.german_stem


def test_bm25_over_stems_is_brute_force(spark):
    said = GOLDEN["english"].split()
    stem = dict(zip(said[::2], said[1::2], strict=True))
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice([*stem] + ["knocking", "the", "a"] * 20) for _ in range(n)).title() + "."
    pool = [(i, text(rng.randint(1, 40))) for i in range(60)] + [(100, None), (101, ""), (102, "the of"), (103, "knack " * 3000), (104, "knack"), (105, "knack")]
    asked = [(i, text(6)) for i in range(12)] + [(50, None), (51, "unseen"), (52, "knacks")]
    bag = lambda t: [stem.get(w, w) for w in re.findall(r"\w\w+", (t or "").lower()) if w not in R.STOP_WORDS]
    bags = {i: Counter(bag(t)) for i, t in pool}
    n, avgdl = len(pool), sum(sum(b.values()) for b in bags.values()) / len(pool)
    df = Counter(t for b in bags.values() for t in b)
    want = set()
    for q, t in asked:
        score = {}
        for i, b in bags.items():
            met = [(w, c) for w, c in Counter(bag(t)).items() if w in b]
            if met:
                score[i] = round(sum(c * math.log(max(1, (n - df[w] + 0.5) / (df[w] + 0.5))) * b[w] / (b[w] + 1.5 * (0.3 + 0.7 * sum(b.values()) / avgdl)) for w, c in met), 6)
        best = sorted(score, key=lambda i: (-score[i], i))[:4]
        want |= {(q, i, len(best) - r) for r, i in enumerate(best)}
    p, a = spark.createDataFrame(pool, "item_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    got = R.Retriever("bm25s", p, language="english").query(a, 4).collect()
    assert {(r.query_id, r.item_id, r.pos) for r in got} == want
    parts = a.select("query_id", F.lit(1).alias("part"), "text")
    whole = R.Retriever("structural_bm25s", p, language="english").query(parts, 4).collect()
    assert {(r.query_id, r.item_id, r.pos) for r in whole} == want
    assert R.Retriever("bm25s", p.where("false"), language="english").query(a, 4).count() == 0
