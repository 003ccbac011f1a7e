"""Ranked retrieval end to end over a stored index; a query reads the buckets of its words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import links, phrases, postings, proximity, ranking, selection
from .index import Index

#: Documents that the link pass looks at, and rows of each related list.
HORIZON, LINKS, TITLES, FEATURES = 120, 20, 20, 15
#: The link pass's features by the name of their list.
LISTS = {"linkid": ("nblinks", TITLES), "veclfeat": ("links", LINKS), "vecfname": ("features", FEATURES)}
#: The kind whose features weigh in the second pass.
LINKED = "veclfeat"


def terms_table(index: Index, terms: list[dict], s: ranking.Scheme) -> DataFrame:
    """(value, df, weight, near) of the query's terms that the collection holds."""
    rows = [(t["value"], t["df"], float(t["weight"]), t["df"] <= s.maxdf * index.n) for t in terms if t["df"] > 0]
    return index.spark.createDataFrame(rows, "value string, df long, weight double, near boolean")


def scored(index: Index, terms: list[dict], s: ranking.Scheme, metadata: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, n_terms) of all documents that hold a term; ``metadata`` has doc_id and pageweight."""
    words, told = [t["value"] for t in terms if t["df"] > 0], terms_table(index, terms, s)
    if s.window is None:
        ranks = ranking.bm25(index.postings(words), told, index.n, s)
    else:
        ff = proximity.proximity_tf(index.hits(words), told, s.window, s.cardinality, s.ffbase, s.title_bonus)
        ranks = ranking.bm25(ff, told, index.n, s, "ff")
    if s.pageweight is not None and metadata is not None:
        both = ranks.join(metadata.select("doc_id", "pageweight"), "doc_id", "left")
        ranks = both.select("doc_id", ranking.with_pageweight(F.col("score"), F.coalesce("pageweight", F.lit(0.0)), s.pageweight).alias("score"), "n_terms")
    return ranks


def needed(index: Index, terms: list[dict]) -> int:
    """How many of a query's terms a document must hold: all that the collection has, or a title's share where all are stop words."""
    live = [t for t in terms if t["df"] > 0]
    stop = all(t["df"] >= index.n / 12 for t in live)
    return selection.title_cardinality(len(live)) if stop else len(live)


def candidates(index: Index, terms: list[dict], s: ranking.Scheme, restrict: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """The scored documents that hold enough terms, restricted to some and to those that redirect nowhere."""
    ranks = scored(index, terms, s, metadata).filter(F.col("n_terms") >= needed(index, terms))
    if metadata is not None and "redirect" in metadata.columns:
        ranks = ranks.join(metadata.filter("redirect <> 0").select("doc_id"), "doc_id", "left_anti")
    return ranks if restrict is None else ranks.join(restrict.select("doc_id"), "doc_id", "left_semi")


def query_terms(index: Index, q: str) -> list[dict]:
    """A query's words and phrases with df, normalized as the index was; fails if the collection holds none."""
    terms = index.terms([t["value"] for t in index.covered(q)])
    if not any(t["df"] for t in terms):
        raise ValueError("features not found")
    return terms


def link_pass(index: Index, terms: list[dict], s: ranking.Scheme, horizon: int = HORIZON, metadata: DataFrame | None = None) -> DataFrame:
    """(type, link, weight, rank): each kind of forward features near the terms in the best documents.

    These (``horizon`` rows) go to the driver first, so that only their buckets are read."""
    words = [t["value"] for t in terms if t["df"] > 0]
    best = ranking.top(candidates(index, terms, s, None, metadata).select("doc_id", F.round("score", 6).alias("score")), horizon)
    best = index.spark.createDataFrame(best.collect(), best.schema)
    ids = [r["doc_id"] for r in best.select("doc_id").collect()]
    hits, features = index.hits(words, ids).select("doc_id", "pos", F.col("value").alias("term")), index.features(ids)
    out = None
    for kind, reach in s.near:
        near = proximity.accumulated_near(hits, features.filter(F.col("kind") == kind), len(words), reach, s.near_cardinality, s.cofactor, s.limit_per_doc)
        told = links.aggregated(near, best).select(F.lit(kind).alias("type"), "link", F.round("weight", 5).alias("weight"))
        out = told if out is None else out.unionByName(told)
    w = W.partitionBy("type").orderBy(F.desc("weight"), "link")
    sizes = F.coalesce(*(F.when(F.col("type") == k, n) for k, (_, n) in LISTS.items()), F.lit(LINKS))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= sizes)


def link_weights(index: Index, terms: list[dict], metadata: DataFrame | None = None) -> DataFrame:
    """(doc_id, links): the damped weights of the link pass's titles, each counted once in a document that holds it.

    The titles (LINKS rows) go to the driver, and their postings are read."""
    lifted = links.log_damped(link_pass(index, terms, ranking.SCHEMES["STDLNK"], metadata=metadata).filter(F.col("type") == LINKED))
    rows = lifted.select("link", "weight").collect()
    told = index.spark.createDataFrame([(r["link"], r["weight"]) for r in rows], "value string, weight double")
    return index.postings([r["link"] for r in rows]).select("doc_id", "value").join(F.broadcast(told), "value").groupBy("doc_id").agg(F.sum("weight").alias("links"))


def search(index: Index, q: str, i: int = 0, n: int = 6, s: str = "BM25", d: DataFrame | None = None, m: DataFrame | None = None, passage: int = 40) -> DataFrame:
    """Ranks i .. i + n of a query: (doc_id, score, title, kind, abstract).

    Phrases of the index's dictionary count as terms of their own. ``d`` restricts the documents,
    ``m`` is their metadata (pageweight, redirect). ``STD`` runs the link pass first, whose titles
    then weigh in; an index without features has none."""
    terms = query_terms(index, q)
    scheme = ranking.scheme("BM25std" if s == "STD" else s)
    ranks = candidates(index, terms, scheme, d, m)
    if s == "STD" and index.longest:
        ranks = ranks.join(link_weights(index, terms, m), "doc_id", "left").select("doc_id", ranking.mixed(F.col("score"), F.coalesce("links", F.lit(0.0)), scheme.links).alias("score"))
    best = ranking.top(ranks.select("doc_id", F.round("score", 6).alias("score")), n, i)
    return passages(index, best, [t for t in terms if t["df"] > 0], passage)


def search_page(index: Index, q: str, i: int = 0, n: int = 6, **more) -> dict[str, DataFrame]:
    """What a result page shows: ranks, whether there are more, and the related lists."""
    terms = query_terms(index, q)
    related = link_pass(index, terms, ranking.SCHEMES["STDLNK"])
    lists = {name: links.related_terms(related.filter(F.col("type") == kind).withColumnRenamed("link", "name"), q) for kind, (name, _) in LISTS.items()}
    return {"ranks": search(index, q, i, n, **more), "has_more": ranking.has_more(candidates(index, terms, ranking.SCHEMES["BM25"]), n, i), **lists}


#: Words of a window, most words of a passage, share of the terms that a window must hold, and the greatest share of documents of a term that windows count.
WINDOW, SENTENCE, CARDINALITY, MAXDF = 40, 100, 0.6, 0.2


def passages(index: Index, ranks: DataFrame, terms: list[dict], size: int = WINDOW, sentence: int = SENTENCE, cardinality: float = CARDINALITY, maxdf: float = MAXDF) -> DataFrame:
    """Ranks with ``title``, ``kind`` and ``abstract``, the places of all terms marked.

    The ``phrase`` is the window of ``size`` words with most places of the terms rare enough (of all,
    if none is), if it holds ``cardinality`` of these; it begins with its sentence, if the whole is at most
    ``sentence`` words. A document without one shows its beginning (``docstart``). A page of ranks
    goes to the driver, so that only its documents are read."""
    page = index.spark.createDataFrame(ranks.collect(), ranks.schema)
    ids = [r["doc_id"] for r in page.select("doc_id").collect()]
    words = [t["value"] for t in terms]
    near = [t["value"] for t in terms if t["df"] <= maxdf * index.n] or words
    hits = index.postings(words).filter(F.col("doc_id").isin(ids)).select("doc_id", "length", F.col("value").alias("term"), F.explode("hits.pos").alias("pos"))
    counted = proximity.window_hits(hits.filter(F.col("term").isin(near)), size).filter(F.col("n_terms") >= math.ceil(len(near) * cardinality))
    counted = counted.groupBy("doc_id").agg(F.max(F.struct("n_hits", (-F.col("pos")).alias("at"))).alias("b"))
    shown = index.texts(ids).select("doc_id", "title", F.col("words").alias("orig"), "sents")
    # the words as the text has them stand at the places that the index knows; all words of a phrase are marked
    marked = hits.select("doc_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("length") - 1)).alias("pos")).groupBy("doc_id").agg(F.collect_set("pos").alias("marked"))
    told = page.join(shown, "doc_id").join(counted, "doc_id", "left").join(marked, "doc_id", "left").withColumn("at", -F.col("b.at"))
    begins = (F.array_position("sents", F.get("sents", F.col("at"))) - 1).cast("int")
    told = told.withColumn("start", F.when(F.col("at") - begins <= sentence - size, begins).otherwise(F.coalesce("at", F.lit(0))))
    length = F.coalesce(F.col("at") - F.col("start"), F.lit(0)) + size
    piece = F.transform(F.slice("orig", F.col("start") + 1, length), lambda t, k: F.when(F.array_contains("marked", (k + F.col("start")).cast("int")), F.concat(F.lit("<b>"), t, F.lit("</b>"))).otherwise(t))
    kind = F.when(F.col("at").isNull(), "docstart").otherwise("phrase")
    return told.select("doc_id", "score", "title", kind.alias("kind"), F.array_join(piece, " ").alias("abstract")).orderBy(F.desc("score"), "doc_id")


def explained(index: Index, q: str, s: str = "BM25", n: int = 6) -> DataFrame:
    """(doc_id, value, tf, doclen, df, idf, part): what each term adds to the best documents' scores."""
    terms, scheme = query_terms(index, q), ranking.scheme(s)
    best = ranking.top(candidates(index, terms, scheme), n)
    told = index.postings([t["value"] for t in terms]).join(F.broadcast(best.select("doc_id")), "doc_id", "left_semi").join(F.broadcast(terms_table(index, terms, scheme)), "value")
    idf = ranking.idf(F.lit(float(index.n)), F.col("df"))
    return told.select("doc_id", "value", "tf", "doclen", "df", F.round(idf, 6).alias("idf"), F.round(idf * ranking.tf_weight(F.col("tf"), F.col("doclen"), scheme), 6).alias("part"))


def sequence_postings(index: Index, words: list[str]) -> DataFrame:
    """(value, doc_id, doclen, tf): documents that hold the words one after another, the sequence (joined by spaces) as their value, by the places of its words."""
    places = None
    for k, w in enumerate(words):
        own = index.hits([w]).select("doc_id", "doclen", (F.col("pos") - k).alias("start"), F.lit(k).alias("k"))
        places = own if places is None else places.unionByName(own)
    whole = places.groupBy("doc_id", "doclen", "start").agg(F.count_distinct("k").alias("n")).filter(F.col("n") == len(words))
    return whole.groupBy("doc_id", "doclen").agg(F.count("*").alias("tf")).select(F.lit(" ".join(words)).alias("value"), "doc_id", "doclen", "tf")


def structured(index: Index, query: dict, n: int = 6) -> DataFrame:
    """Ranks of a structured query: {"features": [{"value", "weight", "type"}], "results", "minweight"}.

    Features of type ``word`` are words, those of ``entity`` all their words in this order, one after another; both are normalized as the documents are."""
    weights: dict[str, float] = {}
    for f in query.get("features", []):
        words = index.analyzed(phrases.words_of(f["value"]))
        for value in [" ".join(words)] if f.get("type") == "entity" else words:
            weights[value] = weights.get(value, 0.0) + float(f.get("weight", 1.0))
    terms = index.terms([w for w in weights if " " not in w])
    rows = index.postings([t["value"] for t in terms if t["df"] > 0]).select("value", "doc_id", "doclen", "tf")
    for value in (w for w in weights if " " in w):
        found = sequence_postings(index, value.split())
        terms.append({"value": value, "df": found.count()})
        rows = rows.unionByName(found)
    terms = [t | {"weight": weights[t["value"]]} for t in terms]
    if not any(t["df"] for t in terms):
        raise ValueError("features not found")
    s = ranking.SCHEMES["BM25"]
    ranks = ranking.bm25(rows, terms_table(index, terms, s), index.n, s).filter(F.col("score") >= float(query.get("minweight", 0.0)))
    return ranking.top(ranks.select("doc_id", F.round("score", 6).alias("score")), int(query.get("results", n)))


def browsed(docs: DataFrame, metadata: DataFrame, least: float, start: int = 0, k: int = 20) -> DataFrame:
    """The next ``k`` documents from a number on whose page weight is at least ``least``."""
    return docs.select("doc_id").join(metadata.select("doc_id", "pageweight"), "doc_id").filter((F.col("doc_id") >= start) & (F.col("pageweight") >= least)).select("doc_id").orderBy("doc_id").limit(k)


def throughput(times: DataFrame, n_queries: int) -> DataFrame:
    """(longest, per_second): queries a second of clients that ran side by side, by the slowest one's time."""
    return times.agg(F.max("seconds").alias("longest")).select("longest", (F.lit(float(n_queries)) / F.col("longest")).alias("per_second"))


def top_words(docs: DataFrame, low: float = 0.05, high: float = 0.3, k: int = 2) -> DataFrame:
    """(value, df, idx): the most frequent words with df within a band of shares, as a query for any corpus."""
    n = docs.agg(F.count("*").alias("n"))
    dfs = postings.document_frequencies(docs).crossJoin(F.broadcast(n))  # one row
    band = dfs.filter((F.col("df") >= low * F.col("n")) & (F.col("df") <= high * F.col("n")))
    best = band.orderBy(F.desc("df"), "value").limit(k)
    return best.select("value", "df", "n", F.row_number().over(W.orderBy(F.desc("df"), "value")).alias("idx"))


def search_many(index: Index, queries: DataFrame, k: int = 6, s: ranking.Scheme = ranking.SCHEMES["BM25"]) -> DataFrame:
    """(qid, doc_id, score, rank): the best ``k`` documents of many queries (qid, bucket, value, df) in one pass over the postings of their words.

    Where the queries are few enough, Spark broadcasts them and prunes the buckets; else both meet by bucket and word."""
    hit = index.postings().select("bucket", "value", "doc_id", "doclen", "tf").join(queries, ["bucket", "value"])
    score = F.sum(ranking.idf(F.lit(float(index.n)), F.col("df")) * ranking.tf_weight(F.col("tf"), F.col("doclen"), s))
    told = hit.groupBy("qid", "doc_id").agg(F.round(score, 6).alias("score"))
    return ranking.top_in_groups(told, "qid", k, "score", "doc_id")


def sampled_queries(index: Index, single: int = 800, double: int = 800) -> DataFrame:
    """(qid, bucket, value, df): a load of one- and two-word queries, drawn from the vocabulary by hash."""
    draw = F.md5(F.col("value").cast("binary"))
    drawn = index.dfs().filter("df >= 2").orderBy(draw, "value").limit(single + 2 * double)
    ranked = drawn.withColumn("r", F.row_number().over(W.orderBy(draw, "value")))  # a bounded number of rows
    qid = F.when(F.col("r") <= single, F.col("r")).otherwise(single + F.ceil((F.col("r") - single) / 2)).cast("long")
    return ranked.select(qid.alias("qid"), "bucket", "value", "df")
