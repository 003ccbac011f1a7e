"""The stemmer against pairs of its published sample vocabulary and rules."""

import unicodedata

import pytest

from pyspark.sql import functions as F

from lexigrove.functions import text as T
from lexigrove.functions.porter2 import stem_word

# Words of the published sample and their stems.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl
constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee
knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker
knocking knock knocks knock knopp knopp knot knot knots knot""".split()


@pytest.mark.parametrize(("word", "stem"), list(zip(SAMPLE[::2], SAMPLE[1::2], strict=True)))
def test_sample(word, stem):
    assert stem_word(word) == stem


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("skies", "sky"), ("dying", "die"), ("news", "news"), ("inning", "inning"), ("innings", "inning"), ("proceed", "proceed"), ("generate", "generat"), ("generically", "generic"), ("general", "general"), ("communism", "communism"), ("arsenal", "arsenal"),
        ("hopping", "hop"), ("hoping", "hope"), ("luxuriated", "luxuri"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("gaps", "gap"), ("kiwis", "kiwi"), ("by", "by"), ("say", "say"), ("cry", "cri"), ("dog's", "dog"), ("dogs'", "dog"), ("'tis", "tis"),
        ("relational", "relat"), ("analogies", "analog"), ("theology", "theolog"), ("hopefully", "hope"), ("adoption", "adopt"), ("agreed", "agre"), ("feed", "feed"), ("running", "run"), ("runs", "run"), ("bed", "bed"), ("bing", "bing"), ("rolling", "roll"), ("controlled", "control"), ("a", "a"), ("", ""), ("youth", "youth"),
    ],
)
def test_rules(word, stem):
    assert stem_word(word) == stem


def test_stems_and_marks_of_columns(spark):
    rows = spark.createDataFrame([("generalizations",), (None,), ("",), ("Ünï",)], "w string").select(T.stem(F.col("w")).alias("new"), T.stem(F.col("w"), older=True).alias("old")).collect()
    assert [tuple(r) for r in rows] == [("general", "gener"), (None, None), ("", ""), ("Ünï", "Ünï")]
    odd = "Ŝčřų Ελλάδα Ёлка Việt Ǹǹ ßæœ e\u0301 ñ"
    got = spark.createDataFrame([(odd,)], "w string").select(T.without_marks(F.col("w")).alias("w")).first()["w"]
    want = "".join(c for c in unicodedata.normalize("NFD", odd) if not unicodedata.combining(c)).replace("ß", "ss").replace("æ", "ae").replace("œ", "oe")
    assert got == want
