"""Gender weights worked out by hand, mentions, and documents by form."""

import math

import pytest

from lexigrove.operators import nlp, subjects
from lexigrove.operators.tagger import roles


def told(text):
    out = []
    for line in text.split(" | "):
        words, tags = zip(*(t.rsplit("/", 1) for t in line.split()), strict=True)
        out.append(subjects.mentions(list(words), list(tags), roles(list(words), [subjects._class(t) for t in tags])))
    return out


def test_weights_by_hand():
    got = subjects.gender_weights(told("Anna/NNP left/VBD ./. | She/PRP smiled/VBD ./. | Bob/NNP saw/VBD her/PRP ./."))
    # She: all of 1.2 to Anna. her: 0.7 over Anna's two weights, divided by the root of three additions (Bob's is one)
    assert got == {"Anna": {"W": pytest.approx(1.2 + 0.7 / math.sqrt(3))}}
    got = subjects.gender_weights(told("Anna/NNP and/CC Bob/NNP ran/VBD ./. | He/PRP fell/VBD ./. | He/PRP rose/VBD ./."))
    # first He: 1.2 halved between two of weight 0.8, over the root of two; both become past with 0.6
    # second He: totals 2 * (0.64 + 0.48); each past weight gets its share of 1.2, over the root of four
    share = 0.6 / math.sqrt(2) + 1.2 * 0.5 / 2
    assert got == {n: {"M": pytest.approx(share)} for n in ("Anna", "Bob")}
    # a subject named again renews what is known: 0.3 of the faded weight and 0.2
    got = subjects.gender_weights(told("Anna/NNP left/VBD ./. | She/PRP smiled/VBD ./. | Anna/NNP ran/VBD ./."))
    assert got == {"Anna": {"W": pytest.approx(1.2 + (0.3 * 0.96 + 0.2) / math.sqrt(2))}}
    assert subjects.gender_weights([]) == {} == subjects.gender_weights(told("he/PRP ran/VBD ./."))


def test_weights_fade():
    text = "Anna/NNP left/VBD ./." + " | the/DT rain/NN fell/VBD ./." * 6 + " | She/PRP smiled/VBD ./."
    # 1 * 0.8 ** 6 is under 0.3 when the seventh sentence begins
    assert subjects.gender_weights(told(text)) == {}


def test_mentions():
    assert told("Mary/NNP Ann/NNP left/VBD with/IN his/PRP$ dog/NN") == [[("Mary Ann", "M", True)]]
    assert told("Mary/NNP left/VBD with/IN her/PRP$ dog/NN") == [[("Mary", "", True), (None, "W", False)]]
    assert told("we/PRP met/VBD Bob/NNP and/CC him/PRP") == [[(None, "M", False)]]
    assert told("it/PRP is/VBZ clear/JJ that/IN she/PRP left/VBD") == [[(None, "W", True)]]
    assert told("she/PRP has/VBZ her/PRP$ own/JJ dog/NN") == [[(None, "W", True)]]
    assert told("it/PRP fell/VBD") == [[(None, "N", True)]] and told("x/NN") == [[]]


def test_sure_genders():
    assert subjects.sure_gender("Anna", {"W": 5.0, "N": 2.0}) == "W" and subjects.sure_gender("Anna", {"W": 4.0, "N": 2.0}) is None
    assert subjects.sure_gender("Anna", {"W": 2.0}) is None and subjects.sure_gender("A, B", {"W": 9.0}) is None and subjects.sure_gender("A, B", {"P": 9.0}) == "P" and subjects.sure_gender("x", {}) is None


def test_documents(spark):
    docs = spark.createDataFrame([(1, "Anna walked. She jumped. She smiled. She waited. She stayed."), (2, None), (3, "")], "doc_id long, text string")
    rows = subjects.genders(subjects.tagged_by_form(nlp.sentence_arrays(docs))).collect()
    assert [(r["doc_id"], r["name"], r["gender"], r["sure"]) for r in rows] == [(1, "Anna", "W", "W")] and rows[0]["weight"] > 2
