"""The engine's queries against DuckDB, and its operators on small cases."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexigrove.functions import text as T
from lexigrove.functions.porter import stem_word
from lexigrove.operators import links, markup, nlp, phrases, postings, proximity, ranking, selection, vectors
from lexigrove.plans import catalog
from lexigrove.plans import search as plans
from lexigrove.plans.index import Index, bucket_number, bucket_of, index_of
from lexigrove.sources import dumps, sinks
from lexigrove.streaming import statistics

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_is_its_sql(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_gives_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() >= (name != "markup_strange")


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 6 and "<b>" in rows[0]["abstract"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: T.link_title(F.lit("  the lord  of the rings ")), "the Lord of the Rings"),
        (lambda: T.link_domain(F.lit("File:x.png")), "file"),
        (lambda: T.link_base(F.lit("A#b#c")), "A"),
        (lambda: T.link_anchor(F.lit("A#b")), "b"),
        (lambda: T.without_marks(F.lit("Éçàß")), "Ecass"),
        (lambda: T.entity_id(F.lit(" New York-City ")), "New_York_City"),
        (lambda: T.decode_xml(T.escape_xml(F.lit("<a & \"b\">"))), "<a & \"b\">"),
        (lambda: T.decode_url(F.lit("a%20b+c")), "a b+c"),
        (lambda: T.rule_name(F.lit("a.b__c'")), "ab_c"),
        (lambda: T.middle_cut(F.lit("x" * 100), 23), "x" * 10 + "..." + "x" * 10),
        (lambda: T.short_id(F.lit("a" * 109 + "%2f" + "b" * 20), F.lit(7)), "a" * 109 + "__7"),
        (lambda: T.class_changes(F.lit("ab12CD-x")), 4),
        (lambda: T.chain(T.lowered, T.mapped({"went": "go"}))(F.lit("WENT")), "go"),
        (lambda: T.chain(T.joined_words(), T.prefixed("E#"))(F.lit("a  b")), "E#a_b"),
        (lambda: T.clean_typography(F.lit("“a”–b c&amp;''")), '"a" b c "'),
        (lambda: T.clean_for_tagging(F.lit("a,(b) c.")), "a ,  b  c."),
        (lambda: T.token_shapes(F.array(*map(F.lit, ("12", "March", ",", "1999")))), "NM,N"),
        (lambda: T.is_date(F.array(*map(F.lit, ("March", "of", ",", "1999")))), False),
        (lambda: T.is_date(F.array(*map(F.lit, ("12", "March", "1999", ",")))), True),
        (lambda: ranking.mixed(F.lit(1.0), F.lit(3.0), 0.5), 2.0),
        (lambda: nlp.gender_of(F.lit("Her")), "W"),
        (lambda: nlp.names_within(F.array(*map(F.lit, ("Rudy", "Giuliani"))), F.array(*map(F.lit, ("Rudolph", "Giuliani")))), False),
        (lambda: nlp.names_within(F.array(F.lit("b")), F.array(*map(F.lit, ("a", "b")))), True),
        (lambda: nlp.boosted(F.lit(1.0), F.lit(9)), 3.0),
        (lambda: markup.citation_class(F.lit("Infobox city")), "infobox"),
        (lambda: markup.attribute_name(F.lit(" Birth  Date ")), "birth_date"),
        (lambda: vectors.hamming(F.array(F.lit(5).cast("long")), F.array(F.lit(6).cast("long"))), 2),
    ],
)
def test_functions(spark, column, want):
    got = one(spark, column())
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_titles_and_files(spark):
    rows = spark.createDataFrame([("A b/c é",), ("x_y ",), (None,)], "t string").select(T.file_id(F.col("t")).alias("f"), "t")
    got = rows.select("f", T.file_title(F.concat(F.lit("d/"), "f", F.lit(".xml"))).alias("back")).collect()
    assert [r["f"] for r in got] == ["A_b%2fc_é", "x_y", None] and got[0]["back"] == "A b/c é"


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("controll", "control"), ("generalizations", "gener"), ("sky", "sky")])
def test_stem(word, want):
    assert stem_word(word) == want


def test_schemes():
    assert ranking.scheme("BM25").k1 == 1.2 and len(ranking.SCHEMES) == 9
    with pytest.raises(ValueError, match="unknown scheme"):
        ranking.scheme("nope")


def test_query_analysis():
    got = phrases.analyzed("New York, the city", {"new_york": "F12"})
    assert [(t["type"], t["value"], t["length"]) for t in got if t["type"] != "stem"] == [("vecsfeat", "F12", 2), ("selstem", "the", 1), ("selstem", "city", 1)]
    assert phrases.vector_refs(got) == [12] and phrases.sentence_weight(["V", "N", "x"]) == pytest.approx(0.9)


def test_distinct_or_fail(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert postings.distinct_or_fail(df, "k", "v").count() == 2
    with pytest.raises(Exception, match="two values"):
        postings.distinct_or_fail(df.union(spark.createDataFrame([("b", 3)], "k string, v int")), "k", "v").collect()
    with pytest.raises(Exception, match="features not found"):
        selection.found_or_fail(spark.createDataFrame([("x", 0)], "value string, df long")).collect()


def test_succeeding(spark):
    items = spark.createDataFrame([(1, 0, "m"), (1, 1, "a"), (1, 2, "m"), (1, 3, "m"), (1, 4, "b")], "doc_id long, pos int, value string")
    got = {r["pos"]: r["at"] for r in postings.succeeding(items, F.col("value") == "m").collect()}
    assert got == {0: 1, 2: 4, 3: 4}


PAGE = """== Head ==
Text with [[computer interface]]s, [[File:x.png]], <nowiki>[[raw]]</nowiki> and ''quotes''.<ref>same</ref><ref>same</ref>
{| class="wikitable"
|+ Caption
! A !! B
|-
! r1
| 1 || 2
|-
| rowspan="2" | 3 || colspan="2" | 4
|-
| 5
|}
{{cite web|title=T|url=http://a.b/|class=x}} {{reflist}} tail [http://c.d label] &amp; end"""


def test_markup_items():
    b = markup.build(PAGE)
    kinds = {k: [x for x in b.items if x[0] == k] for k in {x[0] for x in b.items}}
    assert [x[2] for x in kinds["pagelink"]] == ["computer interfaces"] and [x[1] for x in kinds["filelink"]] == ["x.png"]
    assert [x[2] for x in kinds["nowiki"]] == ["[[raw]]"] and len(kinds["reflink"]) == 2 and len(kinds["ref"]) == 1
    assert [x[1] for x in kinds["attr"]] == ["cit1:title", "cit1:url", "cit1:class"] and {x[1] for x in kinds["weblink"]} == {"http://a.b/", "http://c.d"} and not b.errors
    assert {(c[1], c[2], c[3]): c[6] for c in b.cells if c[1] == "cell"} == {("cell", 1, 1): "1", ("cell", 1, 2): "2", ("cell", 2, 0): "3", ("cell", 2, 1): "4", ("cell", 3, 1): "5"}
    nested = markup.build("[[File:a.jpg|thumb|see [[Page]]s]]\n{{box|x=[[Inner]]}}").items
    assert [x[:2] for x in nested if x[0] in markup.LINKS] == [["filelink", "a.jpg"], ["pagelink", "Page"], ["pagelink", "Inner"]]
    rows = markup.build("{|\n|+ c\n|-\n| a\n|-\n! t\n|\n| b\n|}").cells
    assert [(c[1], c[2], c[3]) for c in rows] == [("title", -1, -1), ("cell", 1, 0), ("head", 2, 0), ("cell", 2, 1), ("cell", 2, 2)]
    assert markup.build("{| \n| open").errors == ["table not closed"] and markup.build(None).items == [] and markup.build("}}").errors


def test_markup_never_fails():
    import random

    rng = random.Random(5)
    parts = ["[[", "]]", "{{", "}}", "{|", "|}", "\n|-\n", "\n| ", "||", "!", "''", "<ref>", "</ref>", "text", "\n", "==", "&amp;", "|a=", "<!--", "http://x.y/z", "é"]
    for _ in range(300):
        markup.build("".join(rng.choice(parts) for _ in range(40)))


def test_discourse():
    words = [("Anna", "E", "subj", 0), ("is", "V", "", 0), ("a", "", "", 0), ("doctor", "N", "", 0), (".", "T!", "", 0), ("She", "R", "subj", 1), ("knows", "V", "", 1), ("the", "", "", 2), ("doctor", "N", "", 2)]
    got = nlp.fold_document([{"sent": s, "seq": k, "value": w, "cls": c, "role": r} for k, (w, c, r, s) in enumerate(words)])
    assert [t["ref"] for t in got] == ["Anna", None, None, None, None, "Anna", None, None, "Anna"] and got[5]["gender"] == "W"


def test_dump_sources(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<dump><page><title>A b</title><ns>0</ns><revision><text>x</text></revision></page><page><title>R</title><ns>0</ns><redirect title='A b'/><revision><text>#REDIRECT</text></revision></page><page><title>T</title><ns>1</ns><revision><text>y</text></revision></page></dump>")
    rows = dumps.classified(dumps.pages(spark, str(tmp_path / "d.xml"), [0])).collect()
    assert sorted((r["title"], r["kind"], r["redirect_title"]) for r in rows) == [("A b", "document", ""), ("R", "redirect", "A b")]
    assert dumps.pages(spark, str(tmp_path / "d.xml"), title_contains=["T"]).count() == 1
    (tmp_path / "s.txt").write_text("#FILE#one\n##New York##NY\n##Bob\nfirst line\nsecond\n#FILE#two\ntext\n")
    got = {r["file"]: r for r in dumps.text_stream(spark, str(tmp_path / "s.txt")).collect()}
    assert got["one"]["content"] == "first line\nsecond" and [tuple(e) for e in got["one"]["entities"]] == [("New York", "NY"), ("Bob", None)] and got["two"]["entities"] == []


def test_sinks(spark, tmp_path):
    red = spark.createDataFrame([("a", "b"), ("c", "d")], "key string, target string")
    sinks.write_redirects(red, str(tmp_path / "r"))
    assert sorted(map(tuple, dumps.redirects(spark, str(tmp_path / "r")).collect())) == [("a", "b"), ("c", "d")]
    (tmp_path / "bad").write_text("no tab here\n")
    with pytest.raises(Exception, match="no tab"):
        dumps.redirects(spark, str(tmp_path / "bad")).collect()
    docs = spark.createDataFrame([(1, "one two"), (2001, "three")], "doc_id long, text string")
    sinks.write_kinds(docs, str(tmp_path / "k"), {"txt": F.col("text")})
    assert {r["folder"] for r in spark.read.parquet(str(tmp_path / "k/txt")).collect()} == {0, 2}
    sinks.write_postings(postings.tokens(docs).withColumn("type", F.lit("word")), "postings_test", 2)
    assert spark.table("postings_test").filter("type = 'word' and value = 'two'").count() == 1
    spark.sql("drop table postings_test")
    sinks.write_tagged(nlp.tagged_documents(docs).withColumn("ref", F.lit(None).cast("string")), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 3


def test_streamed_statistics(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "b b")], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    statistics.merge_stream(stream, spark, str(tmp_path / "stats"), str(tmp_path / "ck")).awaitTermination()
    assert {r["value"]: r["df"] for r in statistics.totals(spark, str(tmp_path / "stats")).collect()} == {"a": 1, "b": 3, "c": 1}


def test_search(spark, sf_dir):
    docs = spark.createDataFrame([(1, "red fish swim"), (2, "red red fish and a fish"), (3, "blue bird"), *((k, f"filler{k} text") for k in range(4, 60))], "doc_id long, text string")
    index = Index.write(docs, spark)
    got = plans.search(index, "red fish").collect()
    assert [r["doc_id"] for r in got] == [2, 1] and got[1]["abstract"].startswith("<b>red</b> <b>fish</b>")
    assert [r["doc_id"] for r in plans.search(index, "red fish", d=docs.filter("doc_id = 1")).collect()] == [1]
    assert [r["doc_id"] for r in plans.search(index, "red fish", i=1, n=1).collect()] == [1]
    with pytest.raises(ValueError, match="features not found"):
        plans.search(index, "nothing-such")


def test_links_and_vectors(spark):
    red = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "key string, target string")
    pages = spark.createDataFrame([("c",)], "title string")
    closed = links.closure(red, pages)
    assert sorted(map(tuple, closed.collect())) == [("a", "c"), ("b", "c")] and [r["key"] for r in links.unresolved(red, closed).collect()] == ["x"]
    assert links.related_terms(spark.createDataFrame([("New_York",), ("a_b",)], "name string"), "new york").count() == 1
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in vectors.nearest(v, v.filter("vec_id = 4"), 2).collect()] == [4, 3]
    signed = vectors.signed(v, 2, words=2)
    assert vectors.nearest_signed(signed, signed.filter("vec_id = 4"), 1).first()["distance"] == 0


def test_near_pairs_counts_once(spark):
    hits = spark.createDataFrame([(1, p) for p in (0, 3, 10, 11, 40)], "doc_id long, pos int")
    got = proximity.near_pairs(hits, hits, 10)
    want = sum(abs(a - b) <= 10 for a in (0, 3, 10, 11, 40) for b in (0, 3, 10, 11, 40))
    assert got.count() == want


def test_best_title_match(spark):
    names = spark.createDataFrame([(1, "Giuliani", 9.0), (1, "Rudy Giuliani", 9.0), (1, "Rudy", 2.0), (1, "Other", 50.0)], "doc_id long, name string, usage double")
    assert nlp.best_title_match(F.lit("Rudy Giuliani"), names).first()["name"] == "Giuliani"
    assert nlp.best_title_match(F.lit("Rudy W. L. Giuliani"), names).first()["name"] == "Rudy Giuliani"


def test_word_vector_file(spark, tmp_path):
    import struct

    (tmp_path / "v.bin").write_bytes(b"2 3\n" + b"a " + struct.pack("<3f", 1, 2, 3) + b"\nE#b " + struct.pack("<3f", 4, 5, 6) + b"\n")
    assert sorted((r["name"], r["embedding"]) for r in dumps.word_vectors(spark, str(tmp_path / "v.bin")).collect()) == [("E#b", [4.0, 5.0, 6.0]), ("a", [1.0, 2.0, 3.0])]


def test_registry_of_functions(spark):
    from lexigrove.functions import registry

    registry.register("normalizer", "bang", lambda c: F.concat(c, F.lit("!")))
    assert one(spark, registry.normalizer(["lc", "convdia", "bang"])(F.lit("É"))) == "e!"
    with pytest.raises(KeyError):
        registry.get("tokenizer", "none")
    with pytest.raises(ValueError):
        registry.register("other", "x", len)


@pytest.mark.parametrize(
    ("text", "want"),
    [("id 12ab-34cd-56 end", "bibref"), ("on 2014-11-06 we", None), ("years 1914-1918", None), ("x deadbeef1234567 y", "code"), ("call aB3dE5fG7hI9jK now", "code"), ("-=-=-=-=-=-=-=-=-=-=", "nodata"), ("international relations", None)],
)
def test_odd_words(text, want):
    kinds = {x[0] for x in markup.lex(text)} - {"text"}
    assert kinds == ({want} if want else set()) and "".join(x[2] for x in markup.lex(text)) == text
    assert [x[3]["target"] for x in markup.lex("see /usr/lib/x.so there") if x[0] == "weblink"] == ["file:/usr/lib/x.so"]


def test_index_reads_only_its_buckets(spark):
    docs = spark.createDataFrame([(k, f"alpha w{k} running. second sentence {'beta' if k % 3 == 0 else ''}") for k in range(400)], "doc_id long, text string")
    index = Index.write(docs, spark)
    rows = index.postings(["alpha", "beta"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [bucket" in plan
    files = rows.select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 2 * 2 and len(rows.inputFiles()) > files
    assert rows.groupBy("value").count().collect() and {r["value"]: r["count"] for r in rows.groupBy("value").count().collect()} == {"alpha": 400, "beta": 134}
    assert index.terms(["beta", "none"]) == [{"value": "beta", "df": 134, "weight": 1.0, "term": 1}, {"value": "none", "df": 0, "weight": 1.0, "term": 2}]
    stems = Index.write(docs, spark, stems=True)
    assert plans.query_terms(stems, "Runs")[0]["df"] == 400
    with pytest.raises(ValueError, match="features not found"):
        plans.query_terms(index, "Runs")


def files_read(df):
    """Number of files that a plan without shuffles reads."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().get("numFiles").get().value() for k in range(leaves.size()))


def test_forward_index_reads_only_its_buckets(spark):
    docs = spark.createDataFrame([(k, f"Town{k % 5} hall{k % 5} stands. red{k % 3} fish by town{(k + 1) % 5} hall{(k + 1) % 5}") for k in range(600)], "doc_id long, text string")
    index = Index.write(docs, spark).write_features(spark.createDataFrame([(f"Town{k} Hall{k}", kind, f"{kind[0]}{k}") for k in range(5) for kind in ("linkid", "vecfname")], "name string, kind string, value string"))
    ids = [3, 77, 200]
    for read in (index.features, index.texts):
        every, some = read(), read(ids)
        assert files_read(some) <= len(ids) * 2 < files_read(every) and {r["doc_id"] for r in some.collect()} == set(ids)
    own = {(r["kind"], r["doc_id"], r["pos"], r["value"]) for r in index.features([3]).collect()}
    assert own == {("linkid", 3, 0, "l3"), ("linkid", 3, 6, "l4"), ("vecfname", 3, 0, "v3"), ("vecfname", 3, 6, "v4")}
    assert [w for w in index.texts([3]).first()["words"]][:3] == ["Town3", "hall3", "stands"]
    for b, v in ((index.buckets, "ünï word"), (7, 12), (7, -5)):
        assert bucket_number(v, b) == one(spark, bucket_of(F.lit(v).cast("string" if isinstance(v, str) else "long"), b))


def test_empty_index(spark):
    index = Index.write(spark.createDataFrame([], "doc_id int, text string"), spark)
    assert index.postings().count() == index.texts([1]).count() == 0 and index.terms(["a"])[0]["df"] == 0
    index.write_features(spark.createDataFrame([("a b", "linkid", "x")], "name string, kind string, value string"))
    assert index.features().count() == 0 and index.covered("a b") == [{"value": "a_b", "length": 2}, {"value": "b", "length": 1}]


def test_passages_by_sentences(spark):
    filler = " ".join(f"x{k}" for k in range(45))
    rows = [(1, f"start here. {filler}. A fine red fish swims in it, with {filler}"), (2, f"{filler} {filler} red {filler} fish"), (3, f"red. {filler}. {filler} fish")] + [(100 + k, f"common w{k}") for k in range(40)]
    index = Index.write(spark.createDataFrame(rows, "doc_id long, text string"), spark)
    told = {r["doc_id"]: (r["kind"], r["abstract"]) for r in plans.search(index, "red fish", n=9).collect()}
    # the phrase begins with its sentence; without a window that holds both there is the document's beginning
    assert told[1][0] == "phrase" and told[1][1].startswith("A fine <b>red</b> <b>fish</b> swims") and len(told[1][1].split()) == 42
    assert told[2] == ("docstart", " ".join(filler.split()[:40])) and told[3][0] == "docstart" and told[3][1].startswith("<b>red</b> x0")
    # a sentence that began too far before is cut at the window
    far = Index.write(spark.createDataFrame([(1, f"{filler} {filler} red fish {filler}")] + rows[3:], "doc_id long, text string"), spark)
    assert plans.search(far, "red fish").first()["abstract"].startswith("<b>red</b> <b>fish</b> x0")


def test_sequences_in_structured_queries(spark):
    rows = [(1, "new york is new"), (2, "york new new york"), (3, "york and new")] + [(100 + k, f"w{k}") for k in range(20)]
    index = Index.write(spark.createDataFrame(rows, "doc_id long, text string"), spark)
    assert sorted(map(tuple, plans.sequence_postings(index, ["new", "york"]).collect())) == [("new york", 1, 4, 1), ("new york", 2, 4, 1)]
    assert {r["doc_id"] for r in plans.structured(index, {"features": [{"type": "entity", "value": "New York"}]}).collect()} == {1, 2}
    assert {r["doc_id"] for r in plans.structured(index, {"features": [{"type": "word", "value": "New York"}]}).collect()} == {1, 2, 3}
    with pytest.raises(ValueError, match="features not found"):
        plans.structured(index, {"features": [{"type": "entity", "value": "york york"}]})


def test_vector_files_in_blocks(spark, tmp_path):
    rng = np.random.default_rng(3)
    # bytes that hold line feeds and spaces wherever they can
    raw = rng.choice(np.array([10, 32, 10, 65, 200, 61], np.uint8), size=(400, 24)).astype(np.uint8)
    some = rng.normal(size=(400, 6)).astype("<f4").tobytes()
    vectors_ = np.concatenate([np.frombuffer(raw.tobytes(), "<f4").reshape(-1, 6), np.frombuffer(some, "<f4").reshape(-1, 6), np.full((20, 6), np.frombuffer(b"\n\n\n\n", "<f4")[0])])
    names = [f"w{k}é" if k % 7 else "x" * (k % 90 + 1) + str(k) for k in range(len(vectors_))]
    content = f"{len(names)} 6\n".encode() + b"".join(n.encode() + b" " + v.astype("<f4").tobytes() + b"\n" for n, v in zip(names, vectors_, strict=True))
    (tmp_path / "a.bin").write_bytes(content)
    want = {n: v.tobytes() for n, v in zip(names, vectors_, strict=True)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("300", "4096", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = dumps.word_vectors(spark, str(tmp_path / "a.bin"))
            rows = got.collect()
            assert {r["name"]: np.array(r["embedding"], "<f4").tobytes() for r in rows} == want and len(rows) == len(want)
            assert size != "300" or spark.read.option("lineSep", "\n").text(str(tmp_path / "a.bin")).rdd.getNumPartitions() > 50
    finally:
        for key, v in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), before, strict=True):
            spark.conf.set(key, v)


def test_best_readings():
    import itertools
    import random

    known = {"new_york": "E", "york": "N", "new_york_times": "E", "times": "N", "runs": "VN", "wi-fi": "N", "the_city": "NE"}
    read = lambda q: [(r["terms"], round(r["weight"], 6)) for r in phrases.best_reading(q, known)]
    assert read("New York runs") == [([("new_york", "E"), ("runs", "V")], 0.5)]
    assert read("new york times; wi-fi here") == [([("new_york_times", "E")], 0.5), ([("wi-fi", "N"), ("here", "*")], round(0.5 * (0.9 * 2 + 0.8) / 3, 6))]
    assert read("new, york") == [([("new", "*"), ("york", "N")], round(0.5 * 1.7 / 2, 6))] and read(' ;"\n') == []
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice(["new", "york", "times", "runs", "the", "city", "x"]) for _ in range(rng.randint(1, 6))]
        scores = []
        for cuts in itertools.product((0, 1), repeat=len(words) - 1):
            terms, at = [], 0
            for k in [*(i + 1 for i, c in enumerate(cuts) if c), len(words)]:
                terms.append("_".join(words[at:k]))
                at = k
            if all(t in known or "_" not in t for t in terms):
                scores.append(sum(max(phrases.CLASS_WEIGHTS[c] for c in known.get(t, "") + ("*" if "_" not in t else "")) * (t.count("_") + 1) for t in terms))
        assert phrases.best_reading(" ".join(words), known)[0]["weight"] == pytest.approx(0.5 * max(scores) / len(words))
    vs = {"a": [1.0, 0.0], "b": [1.0, 1.0], "c": [0.0, 1.0], "d": [-1.0, 0.0]}
    assert phrases.grouped_terms(["a", "d", "c", "x", "b"], vs) == [["d"], ["x"], ["a", "c", "b"]]


def test_value_classes(spark):
    rows = spark.createDataFrame([("d", v) for v in ("12-MAR-99 10:30", "3-JAN-2001 1:2", "12 mar", "one two three four", "7", "", "a b")], "path string, value string")
    own = [dumps.Element("title", priority=1, most=2), dumps.Element("text"), dumps.Element("date", dumps.DATE_TIME, 2, 1, 1, T.content), dumps.Element("pair", priority=1, least=2, most=2)]
    assert {(r["class"], r["n"]) for r in dumps.path_classes(rows, own).collect()} == {("date", 2), ("title", 3), ("text", 1), ("other", 1)}


def test_search_by_phrases(spark):
    rows = [(1, "new york hotel prices"), (2, "a hotel in york is new"), (3, "new york city hotel"), (4, "new york has a new hotel"), (5, "york new hotel")] + [(100 + k, f"filler{k} words") for k in range(40)]
    names = spark.createDataFrame([(n, "vecfname", n) for n in ("New York", "New York City", "hotel", "city hotel")], "name string, kind string, value string")
    index = Index.write(spark.createDataFrame(rows, "doc_id long, text string"), spark)
    assert {r["doc_id"] for r in plans.search(index, "new york hotel").collect()} == {1, 2, 3, 4, 5}
    index.write_features(names)
    assert [t["value"] for t in index.covered("new york hotel")] == ["new_york", "york", "hotel"]
    assert [(t["value"], t["length"]) for t in index.covered("new york city, hotel")] == [("new_york_city", 3), ("york", 1), ("city", 1), ("hotel", 1)]
    assert [t["value"] for t in index.covered("new, york")] == ["new", "york"]
    found = plans.search(index, "new york hotel").collect()
    # the longer name covers the shorter one in document 3, and words out of order are no phrase
    assert {r["doc_id"] for r in found} == {1, 4} and found[0]["abstract"].startswith("<b>new</b> <b>york</b>")
    assert {r["doc_id"] for r in plans.search(index, "new york city").collect()} == {3}
    assert index.terms(["new_york", "york", "no_name"]) == [{"value": "new_york", "df": 2, "weight": 1.0, "term": 1}, {"value": "york", "df": 5, "weight": 1.0, "term": 2}, {"value": "no_name", "df": 0, "weight": 1.0, "term": 3}]


def test_phrase_keys_avoid_stop_words(spark):
    names = spark.createDataFrame([(f"the of w{k}",) for k in range(30)] + [("the of",), ("of the w3 x",), ("w3 x y z",)], "name string")
    known = phrases.dictionary(names)
    keys = {r["phrase"]: (r["key"], r["at"]) for r in phrases.keyed(known, 0.05).collect()}
    assert keys["the_of_w7"] == ("w7", 2) and keys["of_the_w3_x"] == ("x", 3) and keys["the_of"][0] in ("the", "of")
    docs = spark.createDataFrame([(1, "of the of w7 and the of w3 x y z the of".split()), (2, []), (3, None), (4, ["w7"])], "doc_id long, toks array<string>")
    want, toks = set(), "of the of w7 and the of w3 x y z the of".split()
    for r in known.collect():
        want |= {(i, r["phrase"]) for i in range(len(toks)) if toks[i : i + r["n"]] == r["words"]}
    for stop in (0.0, 0.05, 1.0):
        got = phrases.matched(docs, known, stop=stop).collect()
        assert {(r["pos"], r["phrase"]) for r in got} == want and len(got) == len(want) and {r["doc_id"] for r in got} == {1}
    assert phrases.matched(docs, known.limit(0)).count() == 0
    assert phrases.dictionary(spark.createDataFrame([("B  c", 2), ("b C", 1)], "name string, k int"), order="k").first()["id"] == "b C"


def test_index_follows_changed_documents(spark, tmp_path):
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    write([(1, "old words", "s")])
    assert index_of(spark, str(tmp_path)).n == 1
    write([(1, "old words", "s"), (2, "fresh words", "s")])
    assert index_of(spark, str(tmp_path)).n == 2


def test_result_page(spark):
    # "numberX fish" is a title that documents link to
    docs = spark.createDataFrame([(k, f"red fish number{k % 4} fish swims by") for k in range(12)] + [(100 + k, f"filler{k} words") for k in range(60)], "doc_id long, text string")
    names = spark.createDataFrame([(f"number{k} fish", kind, f"{'d' * (kind == 'linkid')}number{k}_fish") for k in range(4) for kind in ("linkid", "veclfeat", "vecfname")], "name string, kind string, value string")
    index = Index.write(docs, spark).write_features(names)
    page = plans.search_page(index, "red fish", n=5)
    assert set(page) == {"ranks", "has_more", "nblinks", "links", "features"}
    assert page["ranks"].count() == 5 and page["has_more"].first()["has_more"] and {r["name"] for r in page["nblinks"].collect()} == {f"dnumber{k}_fish" for k in range(4)}
    told = plans.structured(index, {"features": [{"type": "word", "value": "number1", "weight": 3.0}], "results": 2, "minweight": 0.1})
    assert [r["doc_id"] for r in told.collect()] == [1, 5]
    heavy = docs.select("doc_id", F.when(F.col("doc_id") == 7, 10.0).otherwise(0.0).alias("pageweight"), (F.col("doc_id") == 3).cast("int").alias("redirect"))
    assert plans.search(index, "red fish", s="NBLNK", m=heavy).first()["doc_id"] == 7
    assert 3 not in {r["doc_id"] for r in plans.search(index, "red fish", n=50, m=heavy).collect()}


def test_second_pass_damps_and_counts_titles_once(spark):
    rows = [(k, "red fish near big pond " + "and far big pond " * (k % 2)) for k in range(6)] + [(10 + k, "red fish alone") for k in range(2)] + [(100 + k, f"filler{k}") for k in range(60)]
    index = Index.write(spark.createDataFrame(rows, "doc_id long, text string"), spark).write_features(spark.createDataFrame([("big pond", "veclfeat", "big_pond")], "name string, kind string, value string"))
    terms = plans.query_terms(index, "red fish")
    weight = plans.link_pass(index, terms, ranking.SCHEMES["STDLNK"]).first()["weight"]
    told = {r["doc_id"]: r["links"] for r in plans.link_weights(index, terms).collect()}
    # a document with two places counts as one with a single place
    assert set(told) == set(range(6)) and all(abs(w - math.log(weight)) < 1e-9 for w in told.values())
    plain_, std = ({r["doc_id"]: r["score"] for r in plans.search(index, "red fish", n=20, s=s).collect()} for s in ("BM25pff", "STD"))
    assert all(abs(std[k] - (0.7 * told.get(k, 0.0) + 0.3 * plain_[k])) < 1e-5 for k in std)


def test_band_index(spark):
    rng = np.random.default_rng(2)
    hearts = rng.normal(size=(60, 32))
    x = np.concatenate([h + rng.normal(size=(30, 32)) * 0.2 for h in hearts])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000 + k, x[7].tolist()) for k in range(400)] + [(9000, None), (9001, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vectors.BandIndex.write(frame, spark, 32, bands=6, bits=12)
    probes = frame.filter("vec_id % 31 = 0 and vec_id < 1800")
    found = index.nearest(probes, 20, looks=12).collect()
    ids = sorted({r["probe"] for r in found})
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {p: set(np.argsort(-(unit @ unit[p]), kind="stable")[:20].tolist()) for p in ids}
    got = {p: {r["vec_id"] for r in found if r["probe"] == p} for p in ids}
    assert len(ids) == probes.count() and np.mean([len(got[p] & want[p]) / 20 for p in ids]) >= 0.9
    assert index.share_read(probes, 12).first()["share"] <= 0.1
    assert all(abs(r["score"] - unit[r["probe"]] @ unit[r["vec_id"]]) < 1e-9 for r in found)
    # 401 equal rows are one vector of the index
    assert {r["copies"] for r in index.nearest(frame.filter("vec_id = 7"), 1, 1).collect()} == {401}
    # a look at one key a band reads no other folders
    assert files_read(index.rows().filter("band = 0 and folder = 3")) <= 4 < files_read(index.rows())
    exact = vectors.nearest_of_probes(frame.filter("vec_id < 1800"), probes, 20).collect()
    assert {(r["probe"], r["vec_id"]) for r in exact} == {(p, v) for p in ids for v in want[p]}
    with pytest.raises(ValueError, match="more than 3 probes"):
        index.candidates(probes, 1, most=3)
    assert vectors.BandIndex.write(frame.limit(0), spark, 32).nearest(probes, 5).count() == 0


def test_decayed_sums_of_long_keys(spark):
    rows = spark.range(9_000).select(F.lit(1).alias("k"), F.col("id").alias("o"), F.lit(1.0).alias("v"))
    got = {r["o"]: r["decayed"] for r in nlp.decayed_sum(rows, "k", "o", "v", 0.8).collect()}
    assert all(abs(got[n] - (1 - 0.8 ** (n + 1)) / 0.2) < 1e-9 for n in (0, 1, 499, 500, 3_300, 8_999))
    slow = {r["o"]: r["decayed"] for r in nlp.decayed_sum(rows, "k", "o", "v", 0.999).collect()}
    assert all(abs(slow[n] - (1 - 0.999 ** (n + 1)) / 0.001) < 1e-6 for n in (0, 499, 500, 8_999))


def test_discourse_patterns():
    def told(text):
        tokens = [{"sent": s, "seq": k, "value": w, "cls": "E" if w[0].isupper() and w not in ("The", "He", "They") else "N" if w in ("mayor", "city", "capital") else "", "role": "subj" if k == 0 else ""} for s, line in enumerate(text.split(".")) for k, w in enumerate(line.split())]
        return {(t["sent"], t["value"]): t["ref"] for t in nlp.fold_document(tokens)}

    assert told("Anna is a mayor . later the mayor spoke")[1, "mayor"] == "Anna"
    assert told("we saw mayor Anna . then the mayor spoke")[1, "mayor"] == "Anna"
    assert told("the capital of the city , Paris , grew . and the capital shone")[1, "capital"] == "Paris"
    crowd = " . ".join(f"N{k} ran" for k in range(8))
    assert told(crowd + " . he sat")[8, "he"] == "N7"
