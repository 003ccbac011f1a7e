"""The tagger against a plain decoder, against the rules by form, and subjects of sentences."""

import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lexigrove.operators import nlp, tagger
from lexigrove.plans import analysis


def grammar(rng, n):
    """Sentences of a small grammar whose words are ambiguous: their tags depend on their neighbours."""
    nouns, verbs, both = ["cat", "dog", "tree", "walker"], ["sees", "eats", "finds"], ["walks", "runs", "plants", "flies"]
    out = []
    for _ in range(n):
        noun = lambda: (rng.choice(nouns + both), "NN")
        s = [("the", "DT"), *([(rng.choice(["old", "big", "lovely"]), "JJ")] if rng.random() < 0.4 else []), noun(), (rng.choice(verbs + both), "VBZ"), ("the", "DT"), noun()]
        out.append(s + [(".", ".")])
    return out


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(6)
    sents = grammar(rng, 400)
    rows = [(k, i, w, t) for k, s in enumerate(sents) for i, (w, t) in enumerate(s)]
    return tagger.train(spark.createDataFrame(rows, "sent_id long, seq int, word string, tag string"))


def best(model, words):
    """All tag sequences, scored one by one."""
    score = lambda tags: model.start[tags[0]] + sum(model.step[a][b] for a, b in itertools.pairwise(tags)) + sum(tagger._scores(model, w)[t] for w, t in zip(words, tags, strict=True))
    return max(score(tags) for tags in itertools.product(range(len(model.tags)), repeat=len(words))), score


def test_decoding_is_exact(trained):
    rng = random.Random(7)
    vocabulary = [*trained.words, "unseen", "walkers", "", "x"]
    sentences = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 5))] for _ in range(60)]
    for words, tags in zip(sentences, tagger.decoded(trained, sentences), strict=True):
        assert len(tags) == len(words)
        if words:
            top, score = best(trained, words)
            assert math.isclose(score([trained.tags.index(t) for t in tags]), top, abs_tol=1e-9)


def test_learns_more_than_forms(spark, trained):
    held = grammar(random.Random(8), 200)
    frame = spark.createDataFrame([(k, [w for w, _ in s]) for k, s in enumerate(held)], "k long, words array<string>")
    got = {r["k"]: r["tags"] for r in tagger.tagged(frame, trained).collect()}
    ruled = {r["k"]: r["tags"] for r in frame.select("k", F.transform("words", nlp.rule_tags).alias("tags")).collect()}
    right = lambda found: sum(a == t for k, s in enumerate(held) for a, (_, t) in zip(found[k], s, strict=True)) / sum(map(len, held))
    assert right(got) > 0.98 > right(ruled)
    assert [r["tags"] for r in tagger.tagged(spark.createDataFrame([(1, None), (2, [])], "k long, words array<string>"), trained).collect()] == [[], []]


def test_unseen_words_go_by_their_endings(spark):
    rows = [(k, i, w, t) for k in range(30) for i, (w, t) in enumerate([(f"w{k}ly", "RB"), (f"q{k}ing", "VBG"), ("the", "DT"), (f"z{k}ness", "NN")])]
    model = tagger.train(spark.createDataFrame(rows, "sent_id long, seq int, word string, tag string"))
    assert tagger.decoded(model, [["boldly", "going", "the", "darkness"]]) == [["RB", "VBG", "DT", "NN"]]


@pytest.mark.parametrize(
    ("text", "subjects"),
    [
        ("Giuliani/E left/V Bloomberg/E to/ be/V mayor/N of/ a/ city/N ./T!", ["Giuliani"]),
        ("The/ ninth/A album/N of/ David/E Bowie/E is/V a/ masterpiece/N ./T!", ["album"]),
        ("Erni/E and/ Bernd/E go/V to/ town/N ./T!", ["Erni", "Bernd"]),
        ("In/ the/ park/N she/R quickly/A ran/V ./T!", ["she"]),
        ("Paris/E ,/P! the/ capital/N ,/P! grew/V ./T!", ["Paris"]),
        ("He/R saw/V the/ man/N and/ she/R laughed/V ./T!", ["He", "she"]),
        ("We/R may/M go/V ./T!", ["We"]),
        ("no/ verb/N here/A", []),
        ("", []),
    ],
)
def test_subjects(text, subjects):
    words, classes = zip(*(t.rsplit("/", 1) for t in text.split()), strict=True) if text else ((), ())
    found = [w for w, r in zip(words, tagger.roles(list(words), list(classes)), strict=True) if r]
    assert found == subjects


def test_classes_by_form_are_those_of_the_column(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(w,) for w in ("", "İx", "ǅ", "12th", "12TH", "The", "OF", "İNG", "a.", "!", ";", "x", "ß", "Running", "1st2")], "value string")
    words = nlp.tagged_documents(docs).select("value").distinct().unionByName(odd)
    known = nlp.FormClasses()
    rows = words.select("value", nlp.class_of(nlp.rule_tags(F.col("value"))).alias("cls")).collect()
    assert len(rows) > 1000 and [r["value"] for r in rows if known[r["value"]] != r["cls"]] == []


def test_discourse_over_documents(spark):
    docs = spark.createDataFrame([(1, "Anna is a doctor. She knows Bob. Then he saw the doctor."), (2, None), (3, "")], "doc_id long, text string")
    got = {(r["sent"], r["value"]): (r["ref"], r["gender"]) for r in nlp.discourse(nlp.sentence_arrays(docs)).collect()}
    assert got[0, "Anna"] == ("Anna", None) and got[1, "She"] == ("Anna", "W") and got[2, "doctor"] == ("Anna", None)
    given = spark.createDataFrame([(1, [["rose", "left"], ["she", "came"]], [["E", "V"], ["R", "V"]])], "doc_id long, words array<array<string>>, classes array<array<string>>")
    assert {(r["value"], r["role"], r["ref"]) for r in nlp.discourse(given).collect()} == {("rose", "subj", "rose"), ("she", "subj", "rose")}


def test_names_are_split_to_a_fix_point(spark):
    rows = [(1, "C A B", 1.0), (1, "C", 19.0), (1, "A B", 2.0), (1, "A", 90.0), (1, "B", 1.0), (2, "C A B", 1.0)]
    names = spark.createDataFrame(rows, "doc_id long, name string, usage double")
    got = {(r["doc_id"], r["name"], r["usage"]) for r in nlp.split_names(names, spark, factor=1.5).collect()}
    # C A B becomes C and A B, then A B becomes A and B
    assert got == {(1, "C", 20.0), (1, "A", 93.0), (1, "B", 4.0), (2, "C A B", 1.0)}


def test_turn_roles_query(spark, sf_dir):
    rows = duckdb.sql(f"select conv_id, turn, role, floor(log2(greatest(length(coalesce(text, '')), 1)))::int::varchar from '{sf_dir}/conversations.parquet' order by conv_id, turn").fetchall()
    learned = spark.createDataFrame([r for r in rows if r[0] % 5], "sent_id long, seq long, tag string, word string")
    model = tagger.train(learned)
    got = {r["conv_id"]: r["tags"] for r in analysis.turn_roles(spark, sf_dir).collect()}
    convs = {}
    for r in rows:
        if r[0] % 5 == 0:
            convs.setdefault(r[0], []).append(r[3])
    assert set(got) == set(convs)
    for k, words in convs.items():
        if len(words) <= 6:
            top, score = best(model, words)
            assert math.isclose(score([model.tags.index(t) for t in got[k]]), top, abs_tol=1e-9)
