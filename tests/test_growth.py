"""Steps whose cost must grow no faster than their input."""

import time

import duckdb

from lexigrove.operators import embeddings, markup, phrases, postings, vectors
from lexigrove.plans.index import Index
from lexigrove.plans.registry import rounded


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


PAGES = [(1, "a <ref>x</ref> b <ref>x</ref> {{cite web|url=u}}\n== h ==\n<ref>x</ref>"), (2, "plain"), (3, None)]


def test_linked_tables_broadcasts_nothing(spark):
    done = markup.linked_tables(markup.parsed(spark.createDataFrame(PAGES, "doc_id long, text string")))
    got = sorted((r["doc_id"], r["kind"], r["ident"], r["text"]) for r in done.collect())
    # three links to a reference that stands in two sections
    assert got == [(1, "citation", "cit1", "cite web")] + [(1, "ref", "ref1", "x")] * 6
    assert "Broadcast" not in plan_of(done)
    assert done._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_pages_of_one_file_are_parsed_by_many_tasks(spark, tmp_path):
    pages = spark.createDataFrame(PAGES * 20, "doc_id long, text string").coalesce(1)
    pages.write.parquet(str(tmp_path / "p"))
    read = spark.read.parquet(str(tmp_path / "p"))
    assert read.rdd.getNumPartitions() == 1
    assert markup.parsed(read).rdd.getNumPartitions() >= 16 and markup.lexemes(read).rdd.getNumPartitions() >= 16


def test_sections_of_one_long_document(spark):
    """Quadratic work over 40,000 headings takes minutes."""
    heads = spark.range(40_000).selectExpr("1L as doc_id", "id as pos", "cast(id % 4 + 1 as int) as level")
    began = time.perf_counter()
    got = {r["start"]: r["end"] for r in postings.fields_paired(heads).collect()}
    assert time.perf_counter() - began < 30
    # level 1 ends at the next level 1, all others at the first of their level or above
    assert len(got) == 40_000 and got[0] == 4 and got[1] == 4 and got[2] == 4 and got[3] == 4 and got[39_996] is None and got[39_999] is None


def test_rounded_zeros_keep_their_sign(spark):
    rows = spark.createDataFrame([(-3e-7, 1), (3e-7, 1), (-0.0, 1), (-1.5e-6, 1), (None, 1)], "x double, k int")
    got = [r["x"] for r in rounded(rows, "x").collect()]
    con = duckdb.connect()
    want = [con.execute("select round(?::double, 6)", [x]).fetchall()[0][0] for x in (-3e-7, 3e-7, -0.0, -1.5e-6, None)]
    assert list(map(repr, got)) == list(map(repr, want)) and dict(rounded(rows, "k").dtypes)["k"] == "int"


def test_word_vectors_are_learned_by_many_tasks(spark):
    rows = spark.createDataFrame([([f"w{(k * 7 + i) % 20}" for i in range(12)],) for k in range(200)], "tokens array<string>").coalesce(1)
    ran = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("w2v", "")
    model = vectors.word_vectors(rows, size=4, window=2, least=2)
    stages = [ran.getStageInfo(s) for j in ran.getJobIdsForGroup("w2v") for s in ran.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= spark.sparkContext.defaultParallelism and model.getVectors().count() == 20


def test_index_shuffles_lists_not_places(spark, tmp_path):
    """One row for each word of a document reaches the shuffle, however often the word stands there."""
    docs = spark.createDataFrame([(k, "one two. " * 500 + f"w{k}") for k in range(40)] + [(100, ""), (101, None), (102, "...")], "doc_id long, text string")
    began = shuffled_rows(spark)
    index = Index.write(docs, spark, str(tmp_path / "i"))
    # texts twice, lists once, and the partial counts of words
    assert shuffled_rows(spark) - began < 1000
    got = {(r["doc_id"], r["value"]): r for r in index.postings().collect()}
    assert len(got) == 120 and got[7, "w7"]["tf"] == 1 and got[7, "w7"]["hits"] == [(1000, 500)]
    assert got[7, "two"]["tf"] == 500 and got[7, "two"]["hits"] == [(2 * k + 1, k) for k in range(500)] and got[7, "two"]["doclen"] == 1001
    assert {r["value"]: (r["df"], r["tf"]) for r in index.dfs(["one", "w3"]).collect()} == {"one": (40, 20_000), "w3": (1, 1)}
    merged = Index.write(docs, spark, str(tmp_path / "m"), dictmap={"one": "two"})
    assert merged.postings(["two"]).filter("doc_id = 7").first()["hits"] == [(k, k // 2) for k in range(1000)]


def shuffled_rows(spark) -> int:
    """Rows that all stages of the session have shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_phrases_that_share_words_meet_no_other_places(spark):
    """4,000 phrases that share their words: joined by a word, each place would meet hundreds of them."""
    names = spark.range(4000).selectExpr("concat('a', id % 20, ' b', int(id / 20) % 20, ' c', int(id / 400)) as name")
    known = phrases.dictionary(names)
    docs = spark.range(400).selectExpr("id as doc_id", "split(concat('a', id % 20, ' b', int(id / 20), ' c3 x b1 c1'), ' ') as toks")
    began = time.perf_counter()
    got = [(r["doc_id"], r["pos"], r["n"], r["phrase"]) for r in phrases.matched(docs, known).collect()]
    assert sorted(got) == [(d, 0, 3, f"a{d % 20}_b{d // 20}_c3") for d in range(400)] and time.perf_counter() - began < 30
    # only what the filter lets pass reaches the join
    plan = phrases.matched(docs, known)
    plan.collect()
    tree = plan._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in tree and "around" not in tree


def test_skip_gram_keeps_every_word(spark):
    docs = spark.range(30_500).selectExpr("array(concat('w', id), concat('v', id), concat('w', id), concat('v', id)) as tokens")
    found = embeddings.skip_gram(docs, size=2, window=1, negative=1, sample=1.0, least=2, rounds=1)
    assert found.count() == 61_000 and len(embeddings.vocabulary(docs, "tokens", 2, most=10)) == 10


def test_chain_of_normalizers_shuffles_words_once(spark, tmp_path):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{i} W{k}X{i}" for i in range(100))) for k in range(20)], "doc_id long, text string")
    began = shuffled_rows(spark)
    Index.write(docs, spark, str(tmp_path / "i"))
    plain, began = shuffled_rows(spark) - began, shuffled_rows(spark)
    Index.write(docs, spark, str(tmp_path / "c"), dictmap={"w0x0": "w0x1"}, marks_go=True)
    assert shuffled_rows(spark) - began <= plain


def test_words_that_became_equal_meet_across_batches(spark):
    from lexigrove.plans import index as I

    rows = [(k // 3, 7, 10, 0, f"v{k % 2}", [k], [k]) for k in range(12)]
    cut = list(I._merged(iter(spark.createDataFrame(rows, I._WORDS).coalesce(1).toArrow().to_batches(max_chunksize=2))))
    got = {(r["nth"], r["value"]): r["at"] for b in cut for r in b.to_pylist()}
    assert got == {(n, f"v{p}"): [k for k in range(3 * n, 3 * n + 3) if k % 2 == p] for n in range(4) for p in range(2)} and sum(b.num_rows for b in cut) == 8


def test_odd_texts_are_cut_as_by_expressions(spark, tmp_path):
    from pyspark.sql import functions as F

    from lexigrove.functions import text as T
    from lexigrove.plans.index import SENTENCE_END

    texts = ["", None, "...", "a. .b", "A,.\tB!?C\n\nd", "İI ΑΣ ΑΣ'Α b.", "x y z\u0085w　v", "½ ① 一二 \U0001d7d8 \U00020000", "éte _under_score_", ".a", "a" * 5000 + ". b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = Index.write(docs, spark, str(tmp_path / "i"))
    sentences = F.split(F.lower(F.coalesce("text", F.lit(""))), SENTENCE_END)
    placed = F.flatten(F.transform(sentences, lambda s, i: F.transform(T.words(s), lambda w: F.struct(w.alias("value"), i.alias("sent")))))
    want, got = {}, {}
    for r in docs.select("doc_id", placed.alias("ws"), T.words(F.col("text")).alias("orig")).collect():
        for pos, w in enumerate(r["ws"]):
            want.setdefault((r["doc_id"], w["value"]), []).append((pos, w["sent"]))
        shown = r["orig"] if len(r["orig"]) == len(r["ws"]) else [w["value"] for w in r["ws"]]
        want[r["doc_id"]] = (shown, [w["sent"] for w in r["ws"]], len(r["ws"]))
    got = {(r["doc_id"], r["value"]): [tuple(h) for h in r["hits"]] for r in index.postings().collect()}
    got |= {r["doc_id"]: (r["words"], r["sents"], r["doclen"]) for r in index.texts().collect()}
    assert got == want


def test_words_are_not_handled_one_by_one_in_expressions(spark, tmp_path):
    """Functions over single words in array expressions are interpreted; the index and the matching of phrases have kernels instead."""
    known = phrases.dictionary(spark.createDataFrame([("b c",), ("c d e",)], "name string"))
    docs = spark.createDataFrame([(1, "a b c d e".split()), (2, "c d b c".split()), (3, [])], "doc_id long, toks array<string>").selectExpr("*", "array(0, 10, 20, 30, 40) as own")
    done = phrases.matched(docs, known, at=["own"])
    assert "lambdafunction" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in done.collect()) == [(1, 1, 2, "b_c", "b c", 10), (1, 2, 3, "c_d_e", "c d e", 20), (2, 2, 2, "b_c", "b c", 20)]
    index = Index.write(spark.createDataFrame([(k, f"n{k} m{k}. end") for k in range(50)], "doc_id long, text string"), spark, str(tmp_path / "i"))
    index.write_features(spark.createDataFrame([("n3 m3", "k", "v")], "name string, kind string, value string"))
    assert [(r["doc_id"], r["pos"], r["value"]) for r in index.features().collect()] == [(3, 0, "v")]
