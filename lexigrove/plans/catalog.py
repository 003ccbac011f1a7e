"""Registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import links, markup, nlp, phrases, postings, proximity, ranking, selection, vectors
from ..sources import dumps, sinks
from ..streaming import statistics
from . import search as plans
from .index import index_of
from .registry import QUERIES, SQL, query, table
from .registry import rounded as _rounded

def queries():
    return QUERIES


def oracle_sql():
    return SQL


#: The band of document frequencies that registered queries take their words from.
LOW, HIGH = 0.05, 0.3


def band_query(index, k: int = 2) -> str:
    """The most frequent words of the middle band as a query; commas keep them apart, for two words that begin a text together are a phrase of the dictionary."""
    return ", ".join(index.frequent(LOW, HIGH, k))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best six documents for the two most frequent words of the middle band, with passages."""
    index = index_of(spark, sf_dir)
    return plans.search(index, band_query(index))


# Shared parts of the SQL: words by document, postings, statistics, and a query of the two
# most frequent words of the middle band.
TOKS = r"toks AS (SELECT doc_id, source, lang, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS l FROM documents)"
TOK = TOKS + ", tok AS (SELECT doc_id, source, lang, unnest(l) AS value, generate_subscripts(l, 1) - 1 AS pos FROM toks)"
STATS = TOK + ", dfs AS (SELECT value, count(DISTINCT doc_id) AS df FROM tok GROUP BY value), num AS (SELECT count(*) AS n FROM documents), dl AS (SELECT doc_id, len(l) AS doclen FROM toks)"
QRY = STATS + ", q AS (SELECT value, df, n, row_number() OVER (ORDER BY df DESC, value) AS idx FROM dfs, num WHERE df >= 0.05 * n AND df <= 0.3 * n ORDER BY df DESC, value LIMIT 2)"
TF = QRY + ", tf AS (SELECT doc_id, value, count(*) AS tf FROM tok GROUP BY doc_id, value)"
BM25 = TF + ", bm AS (SELECT tf.doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * tf * {k} / (tf + {k1} * (1 - {b} + {b} * doclen / {avg}))) AS score FROM tf JOIN q USING (value) JOIN dl USING (doc_id) GROUP BY tf.doc_id)"


def _bm_sql(tail: str, k1: float = 1.2, b: float = 0.75, avg: float = 1000.0) -> str:
    sql = BM25
    for name, value in (("{k1}", k1), ("{k}", k1 + 1), ("{b}", b), ("{avg}", avg)):
        sql = sql.replace(name, str(value))
    return f"WITH {sql} {tail}"


def _terms(spark, sf_dir, k: int = 2):
    index = index_of(spark, sf_dir)
    return index, index.terms(index.frequent(LOW, HIGH, k))


def _ranks(spark, sf_dir, s=ranking.SCHEMES["BM25"], *keep):
    """(doc_id, kept, score) of the band query, from the postings of its words."""
    ranks = plans.scored(*_terms(spark, sf_dir), s).select("doc_id", "score")
    return ranks.join(table(spark, sf_dir, "documents").select("doc_id", *keep), "doc_id") if keep else ranks


# --- statistics ---------------------------------------------------------------------------


@query("WITH " + TOKS + " SELECT source, sum(len(l))::BIGINT AS n_tokens, count(*) AS n_docs FROM toks GROUP BY source")
def tokens_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.sum(F.size(T.lower_words(F.col("text")))).alias("n_tokens"), F.count("*").alias("n_docs"))


@query("WITH " + TOKS + " SELECT doc_id, len(l)::BIGINT AS doclen FROM toks")
def doc_length(spark, sf_dir):
    return postings.doc_lengths(table(spark, sf_dir, "documents"))


@query("WITH " + STATS + " SELECT value, df FROM dfs")
def term_df(spark, sf_dir):
    return postings.document_frequencies(table(spark, sf_dir, "documents"))


@query("SELECT count(*) AS n FROM documents")
def collection_size(spark, sf_dir):
    return postings.collection_size(table(spark, sf_dir, "documents"))


@query("WITH " + TOK + " SELECT doc_id, min(pos)::INT AS min_pos, (max(pos) + 1)::INT AS next_pos FROM tok WHERE value = 'the' GROUP BY doc_id")
def min_next_pos(spark, sf_dir):
    return postings.positions(postings.tokens(table(spark, sf_dir, "documents")), F.col("value") == "the")


@query("WITH " + STATS + " SELECT value, df FROM dfs WHERE df >= 20")
def vocab_threshold(spark, sf_dir):
    return postings.vocabulary(postings.document_frequencies(table(spark, sf_dir, "documents")), 20)


@query("WITH " + STATS + ", m AS (SELECT max(df) AS high FROM dfs) SELECT least(floor((df - 1) / ((high - 1) / 30.0)), 29)::BIGINT AS bin, count(*) AS n_terms FROM dfs, m GROUP BY 1")
def df_histogram(spark, sf_dir):
    dfs = postings.document_frequencies(table(spark, sf_dir, "documents"))
    most = dfs.agg(F.max("df").alias("high"))
    return postings.histogram(dfs.crossJoin(F.broadcast(most)), 30, F.lit(1), F.col("high"))  # one row


@query("WITH " + STATS + ", w AS (SELECT unnest(['the', 'of', 'no_such_word']) AS value) SELECT value, coalesce(df, 0)::BIGINT AS df FROM w LEFT JOIN dfs USING (value)")
def df_lookup_default(spark, sf_dir):
    terms = spark.createDataFrame([("the",), ("of",), ("no_such_word",)], "value string")
    return postings.with_df(terms, postings.document_frequencies(table(spark, sf_dir, "documents")))


@query("WITH " + TOK + ", p AS (SELECT source, value, count(DISTINCT doc_id) AS df FROM tok GROUP BY source, value) SELECT value, sum(df)::BIGINT AS df FROM p GROUP BY value")
def df_merge_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    parts = docs.select("source", F.explode(F.array_distinct(T.lower_words(F.col("text")))).alias("value")).groupBy("source", "value").agg(F.count("*").alias("df"))
    return postings.merge_df(parts)


@query("WITH " + TOK + ", a AS (SELECT value, count(DISTINCT doc_id) AS df FROM tok WHERE doc_id % 2 = 0 GROUP BY value), b AS (SELECT value, count(DISTINCT doc_id) AS df FROM tok GROUP BY value) SELECT value, (b.df - coalesce(a.df, 0))::BIGINT AS df FROM b LEFT JOIN a USING (value) WHERE b.df <> coalesce(a.df, 0)")
def df_delta(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return postings.df_delta(postings.document_frequencies(docs.filter("doc_id % 2 = 0")), postings.document_frequencies(docs))


@query("WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS value FROM documents) SELECT value, count(*) AS tf FROM w GROUP BY value")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(T.fields(F.col("text"))).alias("value")).groupBy("value").agg(F.count("*").alias("tf"))


@query("WITH " + TOK + ", c AS (SELECT value, count(*) AS tf FROM tok GROUP BY value), t AS (SELECT sum(tf)::DOUBLE AS n, max(tf) AS most FROM c), r AS (SELECT value, tf, 1 / (ln((n - 0.5) / (tf + 0.5)) + 1) AS w, 1 / (ln((n - 0.5) / 0.5) + 1) AS lo, 1 / (ln((n - 0.5) / (most + 0.5)) + 1) AS hi FROM c, t) SELECT value, tf, round((w - lo) / (hi - lo), 6) AS weight FROM r")
def rarity_weight(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").select(F.explode(T.lower_words(F.col("text"))).alias("value")).groupBy("value").agg(F.count("*").alias("tf"))
    return _rounded(postings.rarity(counts), "weight")


@query("WITH " + TOK + ", u AS (SELECT source, value, count(*) AS usage FROM tok GROUP BY source, value HAVING count(*) >= 3), c AS (SELECT *, sum(usage) OVER (PARTITION BY source) AS total, coalesce(sum(usage) OVER (PARTITION BY source ORDER BY usage DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - usage * count(*) OVER (PARTITION BY source, usage) AS before FROM u) SELECT source, value, usage FROM c WHERE before < 0.6 * total")
def usage_cumulative_cut(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    usage = docs.select("source", F.explode(T.lower_words(F.col("text"))).alias("value")).groupBy("source", "value").agg(F.count("*").alias("usage"))
    return postings.cumulative_cut(usage, "source")


@query("WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE AS w FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type) AS k, lead(w) OVER (PARTITION BY user_id ORDER BY w DESC, event_type) AS nxt FROM c) SELECT user_id, CASE WHEN w > 1.2 * coalesce(nxt, 0) AND w > 2 THEN event_type END AS event_type FROM r WHERE k = 1")
def dominant_class(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("w"))
    return postings.dominant(w, "user_id", "event_type", "w", factor=1.2)


@query("SELECT p_name, count(DISTINCT p_brand) AS n_values, min(p_brand) AS first_value FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def dict_conflict(spark, sf_dir):
    return postings.conflicts(table(spark, sf_dir, "part"), "p_name", "p_brand")


@query("WITH a AS (SELECT p_name AS value, count(*) AS df FROM part GROUP BY 1 UNION ALL SELECT p_type, count(*) FROM part GROUP BY 1) SELECT value, sum(df)::BIGINT AS df FROM a GROUP BY value")
def dict_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    count = lambda c: part.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("df"))
    return postings.merge_df(count("p_name").unionByName(count("p_type")))


# --- selection and ranking ----------------------------------------------------------------


@query("WITH " + QRY + " SELECT doc_id FROM tok JOIN q USING (value) GROUP BY doc_id HAVING count(DISTINCT value) = 2")
def select_all_terms(spark, sf_dir):
    index, terms = _terms(spark, sf_dir)
    words = [t["value"] for t in terms]
    return selection.holding(index.postings(words).select("doc_id", "value"), index.dfs(words).select("value", "df"))


@query("WITH " + STATS + ", q AS (SELECT value FROM dfs, num WHERE df >= 0.05 * n AND df <= 0.3 * n ORDER BY df DESC, value LIMIT 4) SELECT doc_id FROM tok JOIN q USING (value) GROUP BY doc_id HAVING count(DISTINCT value) >= 3")
def select_k_of_n(spark, sf_dir):
    index, terms = _terms(spark, sf_dir, 4)
    words = [t["value"] for t in terms]
    return selection.holding(index.postings(words).select("doc_id", "value"), index.dfs(words).select("value", "df"), selection.title_cardinality(4))


@query("WITH " + QRY + " SELECT bool_and(df = 0 OR df >= n / 12.0) AS only_stopwords FROM q")
def stopword_only_query(spark, sf_dir):
    index, terms = _terms(spark, sf_dir)
    return selection.only_stopwords(index.dfs([t["value"] for t in terms]), index.n)


@query(_bm_sql("SELECT doc_id, round(score, 6) AS score FROM bm WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY score DESC, doc_id LIMIT 20"))
def restrict_docs(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return _rounded(ranking.top(_rounded(selection.restricted(_ranks(spark, sf_dir), good), "score"), 20), "score")


@query(_bm_sql("SELECT bm.doc_id, round(score, 6) AS score FROM bm JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY 2 DESC, 1 LIMIT 20"))
def metadata_filter(spark, sf_dir):
    return ranking.top(_rounded(_ranks(spark, sf_dir, ranking.SCHEMES["BM25"], "lang").filter("lang = 'en'").select("doc_id", "score"), "score"), 20)


@query("SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def select_either(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return selection.either(labels.filter("quality = 1").select("doc_id"), labels.filter("toxic = 1").select("doc_id"))


@query(_bm_sql("SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY 2 DESC, 1 LIMIT 20"))
def bm25_topk(spark, sf_dir):
    return ranking.top(_rounded(_ranks(spark, sf_dir), "score"), 20)


@query(_bm_sql("SELECT bm.doc_id, round(0.2 * score * (tanh(len(text) / 5000.0) * 10 / 10) + 0.8 * score, 6) AS score FROM bm JOIN documents USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 20"))
def bm25_pageweight(spark, sf_dir):
    ranks = _ranks(spark, sf_dir, ranking.SCHEMES["BM25"], "n_chars")
    weight = F.tanh(F.col("n_chars") / 5000.0) * 10
    return ranking.top(_rounded(ranks.select("doc_id", ranking.with_pageweight(F.col("score"), weight).alias("score")), "score"), 20)


@query(_bm_sql("SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY 2 DESC, 1 LIMIT 20", 0.75, 2.1))
def bm25_old_params(spark, sf_dir):
    return ranking.top(_rounded(_ranks(spark, sf_dir, ranking.SCHEMES["BM25old"]), "score"), 20)


@query("SELECT l_suppkey, round(tanh(count(*) / 50.0), 6) AS pageweight FROM lineitem GROUP BY l_suppkey")
def tanh_pageweight(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(ranking.pageweight_of(F.count("*")), 6).alias("pageweight"))


@query(_bm_sql("SELECT count(*) > 26 AS has_more, least(greatest(count(*) - 20, 0), 6)::BIGINT AS n_shown FROM bm"))
def paging_hasmore(spark, sf_dir):
    return ranking.has_more(_ranks(spark, sf_dir), 6, 20)


@query(_bm_sql("SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY 2 DESC, 1 LIMIT 6 OFFSET 6"))
def paging_slice(spark, sf_dir):
    return ranking.top(_rounded(_ranks(spark, sf_dir), "score"), 6, 6)


@query(_bm_sql(", s AS (SELECT source, bm.doc_id, round(score, 6) AS score FROM bm JOIN documents USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM s) SELECT source, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 20 ORDER BY score DESC, source, doc_id LIMIT 20"))
def shard_topk_merge(spark, sf_dir):
    ranks = _rounded(_ranks(spark, sf_dir, ranking.SCHEMES["BM25"], "source"), "score")
    return ranking.merged(ranks, "source", 20)


LINK_CTE = ", l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link FROM pages)"


@query(_bm_sql(LINK_CTE + ", top AS (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 120) SELECT link, round(sum(score), 5) AS weight, count(*) AS n_refs FROM l JOIN top ON page_id = doc_id GROUP BY link"))
def link_aggregate(spark, sf_dir):
    found = markup.html_links(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), F.col("target").alias("link"), F.lit(1.0).alias("weight"))
    return _rounded(links.aggregated(found, ranking.top(_ranks(spark, sf_dir), plans.HORIZON)), "weight", digits=5)


@query("WITH " + TOK + ", c AS (SELECT doc_id, value, count(*) AS weight FROM tok GROUP BY doc_id, value), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, value) AS rank FROM c) SELECT doc_id, value, weight, rank::INT AS rank FROM r WHERE rank <= 20")
def top_features_per_doc(spark, sf_dir):
    counts = postings.tokens(table(spark, sf_dir, "documents")).groupBy("doc_id", "value").agg(F.count("*").alias("weight"))
    return ranking.top_in_groups(counts, "doc_id", 20, "weight", "value")


@query("WITH c AS (SELECT l_suppkey AS link, sum(l_discount) AS weight FROM lineitem GROUP BY 1) SELECT link, round(ln(weight), 6) AS weight FROM c WHERE weight > 0")
def log_damped_links(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("link")).agg(F.sum("l_discount").alias("weight"))
    return _rounded(links.log_damped(sums), "weight")


@query("SELECT DISTINCT p_name FROM part WHERE lower(p_name) <> 'red widget' ORDER BY 1")
def sorted_distinct(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("lower(p_name) <> 'red widget'").select("p_name").distinct().orderBy("p_name")


@query("SELECT doc_id % 4 AS shard, count(*) AS n FROM documents GROUP BY 1")
def shard_modulo(spark, sf_dir):
    return selection.sharded(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 4).groupBy("shard").agg(F.count("*").alias("n"))



# --- proximity and phrases ----------------------------------------------------------------

HITS = ", h AS (SELECT doc_id, pos, idx AS term FROM tok JOIN q USING (value))"


def _hits(spark, sf_dir, k: int = 2):
    """(doc_id, pos, sent, term) of the band query's words, numbered from 1."""
    index, terms = _terms(spark, sf_dir, k)
    number = F.coalesce(*(F.when(F.col("value") == t["value"], t["term"]) for t in terms))
    return index.hits([t["value"] for t in terms]).select("doc_id", "pos", "sent", number.alias("term"))


@query("WITH " + QRY + HITS + " SELECT a.doc_id, a.pos::INT AS pos, b.pos::INT AS other_pos FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.term = 1 AND b.term = 2 AND abs(a.pos - b.pos) <= 30")
def proximity_pairs(spark, sf_dir):
    h = _hits(spark, sf_dir)
    return proximity.near_pairs(h.filter("term = 1").drop("term"), h.filter("term = 2").drop("term"), 30).select("doc_id", "pos", "other_pos")


@query("WITH " + QRY + HITS + " SELECT a.doc_id, a.pos::INT AS pos, b.pos::INT AS other_pos FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.term = 1 AND b.term = 2 AND b.pos - a.pos BETWEEN 1 AND 100")
def ordered_pair(spark, sf_dir):
    h = _hits(spark, sf_dir)
    return proximity.near_pairs(h.filter("term = 1").drop("term"), h.filter("term = 2").drop("term"), 100, ordered=True).select("doc_id", "pos", "other_pos")


SENT = r"s AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[.!?]')) AS value, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[.!?]'), 1) - 1 AS pos FROM documents), st AS (SELECT *, coalesce(sum((value IN ('.', '!', '?'))::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sent FROM s)"


@query("WITH " + QRY + ", " + SENT + ", h AS (SELECT doc_id, pos, sent, idx FROM st JOIN q USING (value)) SELECT a.doc_id, a.pos::INT AS pos, b.pos::INT AS other_pos FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.sent = b.sent AND a.idx = 1 AND b.idx = 2 AND abs(a.pos - b.pos) <= 100")
def same_sentence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    toks = postings.tokens(docs, T.lowered, T.matches(r"[\p{L}\p{N}]+|[.!?]"))
    told = proximity.with_struct(toks, F.col("value").isin(".", "!", "?"))
    hit = told.join(F.broadcast(plans.top_words(docs).select("value", "idx")), "value").select("doc_id", "pos", "sent", "idx")  # two rows
    return proximity.within_struct(hit.filter("idx = 1").drop("idx"), hit.filter("idx = 2").drop("idx"), 100).select("doc_id", "pos", "other_pos")


@query("WITH " + TOKS + " SELECT doc_id, (i - 1)::INT AS pos FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 1)) AS i FROM toks WHERE len(l) > 1) WHERE l[i] = 'of' AND l[i + 1] = 'the'")
def phrase_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.lower_words(F.col("text")).alias("toks"))
    return proximity.phrase(docs, ["of", "the"])


PHRASES = ", d AS (SELECT DISTINCT phrase FROM (SELECT l[1] || '_' || l[2] AS phrase FROM toks WHERE len(l) >= 2 UNION ALL SELECT l[1] || '_' || l[2] || '_' || l[3] FROM toks WHERE len(l) >= 3)), g AS (SELECT doc_id, (i - 1)::INT AS pos, n, array_to_string(l[i:i + n - 1], '_') AS phrase FROM (SELECT doc_id, l, n, unnest(generate_series(1, len(l) - n + 1)) AS i FROM toks, (SELECT unnest([1, 2, 3]) AS n) WHERE len(l) >= n)), m AS (SELECT g.* FROM g JOIN d USING (phrase))"


def _phrases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.lower_words(F.col("text")).alias("toks"))
    names = docs.filter(F.size("toks") >= 2).select(F.explode(F.array(F.array_join(F.slice("toks", 1, 2), " "), F.array_join(F.slice("toks", 1, 3), " "))).alias("name"))
    known = phrases.dictionary(names).filter("n >= 2")
    return phrases.matched(docs, known)


@query("WITH " + TOKS + PHRASES + " SELECT phrase, count(*) AS n_matches, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY phrase")
def phrase_dictionary(spark, sf_dir):
    return _phrases(spark, sf_dir).groupBy("phrase").agg(F.count("*").alias("n_matches"), F.count_distinct("doc_id").alias("n_docs"))


@query("WITH " + TOKS + PHRASES + ", e AS (SELECT *, max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m) SELECT doc_id, pos, n::INT AS n, phrase FROM e WHERE before IS NULL OR before < pos + n")
def phrase_longest(spark, sf_dir):
    return phrases.exclusive(_phrases(spark, sf_dir)).select("doc_id", "pos", "n", "phrase")


@query("WITH " + QRY + HITS + ", w AS (SELECT a.doc_id, a.pos, count(*) AS n_hits, count(DISTINCT b.term)::INT AS n_terms FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 39 GROUP BY a.doc_id, a.pos, a.term), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_terms DESC, n_hits DESC, pos) AS k FROM w) SELECT doc_id, pos::INT AS start, n_terms, n_hits FROM r WHERE k = 1")
def passage_best(spark, sf_dir):
    return proximity.best_passages(_hits(spark, sf_dir))


@query("WITH " + TOKS + r", o AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents) SELECT doc_id, array_to_string(list_transform(t[1:40], lambda x: CASE WHEN lower(x) IN ('the', 'of') THEN '<b>' || x || '</b>' ELSE x END), ' ') AS abstract FROM o")
def highlight(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", proximity.highlighted(T.words(F.col("text")), F.lit(0), 40, ["the", "of"]).alias("abstract"))



@query("WITH " + STATS + ", d AS (SELECT value, df, row_number() OVER (ORDER BY md5(value), value) AS r FROM dfs WHERE df >= 2 ORDER BY r LIMIT 2400), q AS (SELECT CASE WHEN r <= 800 THEN r ELSE 800 + ceil((r - 800) / 2.0) END::BIGINT AS qid, value, df, n FROM d, num), tf AS (SELECT doc_id, value, count(*) AS tf FROM tok GROUP BY doc_id, value), s AS (SELECT qid, tf.doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doclen / 1000.0))), 6) AS score FROM tf JOIN q USING (value) JOIN dl USING (doc_id) GROUP BY qid, tf.doc_id), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) SELECT qid, doc_id, score, rank::INT AS rank FROM k WHERE rank <= 6")
def search_load_1600(spark, sf_dir):
    """A load of 1,600 queries in one pass; its time over 1,600 is the time of one."""
    index = index_of(spark, sf_dir)
    return plans.search_many(index, plans.sampled_queries(index))



# --- links and graphs -----------------------------------------------------------------------

REDIRECTS = ", red AS (SELECT 'n' || n_nationkey AS key, CASE WHEN n_nationkey % 5 = 4 THEN 'r' || (n_nationkey % 4) ELSE 'n' || (n_nationkey + 1) END AS target FROM nation), page AS (SELECT 'r' || r_regionkey AS title FROM region WHERE r_regionkey > 0)"


def _redirects(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    target = F.when(F.col("n_nationkey") % 5 == 4, F.concat(F.lit("r"), (F.col("n_nationkey") % 4).cast("string"))).otherwise(F.concat(F.lit("n"), (F.col("n_nationkey") + 1).cast("string")))
    return nation.select(key.alias("key"), target.alias("target")), region.filter("r_regionkey > 0").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("title"))


@query("WITH RECURSIVE x AS (SELECT 1)" + REDIRECTS + ", walk AS (SELECT key, target AS stop, 1 AS d FROM red UNION ALL SELECT w.key, r.target, d + 1 FROM walk w JOIN red r ON w.stop = r.key WHERE d < 6 AND w.stop NOT IN (SELECT title FROM page)) SELECT key, stop AS target FROM walk WHERE stop IN (SELECT title FROM page)")
def redirect_closure(spark, sf_dir):
    return links.closure(*_redirects(spark, sf_dir))


@query("WITH RECURSIVE x AS (SELECT 1)" + REDIRECTS + ", walk AS (SELECT key, target AS stop, 1 AS d FROM red UNION ALL SELECT w.key, r.target, d + 1 FROM walk w JOIN red r ON w.stop = r.key WHERE d < 6 AND w.stop NOT IN (SELECT title FROM page)) SELECT key, target FROM red WHERE key NOT IN (SELECT key FROM walk WHERE stop IN (SELECT title FROM page))")
def redirect_unresolved(spark, sf_dir):
    red, pages = _redirects(spark, sf_dir)
    return links.unresolved(red, links.closure(red, pages))


@query("SELECT c_custkey, c_mktsegment AS link, 'segment ' || lower(c_mktsegment) AS target FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT c_custkey, c_mktsegment, NULL FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def redirect_lookup(spark, sf_dir):
    known = spark.createDataFrame([("BUILDING", "segment building"), ("MACHINERY", "segment machinery")], "key string, target string")
    return links.resolved(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("link")), known)


@query("WITH x AS (SELECT 1)" + REDIRECTS + " SELECT title, count(key) AS n_names FROM page LEFT JOIN red ON title = target GROUP BY title")
def redirect_fan_out(spark, sf_dir):
    red, pages = _redirects(spark, sf_dir)
    return links.fan_out(pages, red).select("title", F.size("names").cast("long").alias("n_names"))


@query("SELECT DISTINCT p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part")
def title_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name", T.link_title(F.col("p_name")).alias("title")).distinct()


def _rank_sql(steps: int) -> str:
    sql = "WITH l AS (SELECT 's' || CASE WHEN l_suppkey % 10 = 5 THEN l_suppkey - 1 ELSE l_suppkey END AS s, 'p' || l_partkey AS p FROM lineitem), e AS (SELECT DISTINCT s AS src, p AS dst FROM l UNION SELECT DISTINCT p, s FROM l WHERE p LIKE '%1'), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), sz AS (SELECT count(*)::DOUBLE AS n FROM nodes), deg AS (SELECT src, count(*) AS degree FROM e GROUP BY src), r0 AS (SELECT node, 1 / n AS rank FROM nodes, sz)"
    for k in range(steps):
        sql += f", g{k} AS (SELECT dst, sum(rank / degree) AS got FROM e JOIN deg USING (src) JOIN r{k} ON node = src GROUP BY dst), d{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE node NOT IN (SELECT src FROM deg)), r{k + 1} AS (SELECT node, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n) AS rank FROM nodes LEFT JOIN g{k} ON node = dst, sz, d{k})"
    return sql + f" SELECT node, round(rank, 9) AS rank FROM r{steps}"


@query(_rank_sql(10))
def pagerank_steps(spark, sf_dir):
    """Ten steps over suppliers and parts, those suppliers that redirect to another resolved first."""
    li = table(spark, sf_dir, "lineitem")
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    keys = li.select("l_suppkey").distinct()
    redirects = keys.filter("l_suppkey % 10 = 5").select(name("s", F.col("l_suppkey")).alias("key"), name("s", F.col("l_suppkey") - 1).alias("target"))
    pairs = li.select(name("s", F.col("l_suppkey")).alias("s"), name("p", F.col("l_partkey")).alias("p")).distinct()
    own = links.folded(pairs, "s", links.closure(redirects, redirects.select(F.col("target").alias("title"))))
    back = own.filter(F.col("p").endswith("1"))
    edges = own.select(F.col("s").alias("src"), F.col("p").alias("dst")).unionByName(back.select(F.col("p").alias("src"), F.col("s").alias("dst")))
    return _rounded(links.page_rank(edges, 10, spark=spark, cut=5), "rank", digits=9)


# --- vectors --------------------------------------------------------------------------------

VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


@query("WITH " + VEC + ", q AS (SELECT e AS qe FROM v WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(e, qe), 4) AS score FROM v, q ORDER BY list_dot_product(e, qe) DESC, vec_id LIMIT 20")
def vec_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return _rounded(vectors.nearest(v, v.filter("vec_id = 0"), 20), "score", digits=4)


VSUM = ", i AS (SELECT generate_subscripts(e, 1) AS k, unnest(e) AS x FROM v WHERE vec_id < 3), q AS (SELECT list(x ORDER BY k) AS qe FROM (SELECT k, sum(x) AS x FROM i GROUP BY k))"


@query("WITH " + VEC + VSUM + " SELECT vec_id, round(list_dot_product(e, qe), 4) AS score FROM v, q ORDER BY list_dot_product(e, qe) DESC, vec_id LIMIT 20")
def vec_sum_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return _rounded(vectors.nearest(v, vectors.summed(v.filter("vec_id < 3")), 20), "score", digits=4)


@query("WITH " + VEC + ", q AS (SELECT e AS qe FROM v WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(e, qe), 4) AS score FROM v, q WHERE label IN (SELECT label FROM v WHERE vec_id = 0) ORDER BY list_dot_product(e, qe) DESC, vec_id LIMIT 20")
def vec_from_concept(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    near = vectors.sharing_concept(v.select("vec_id", F.col("label").alias("concept")), v.filter("vec_id = 0"))
    return _rounded(vectors.nearest(v.join(near, "vec_id", "left_semi"), v.filter("vec_id = 0"), 20), "score", digits=4)


@query("SELECT vec_id, label, round(sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))), 4) AS norm FROM embeddings")
def vec_norm(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", "label", F.round(vectors.norm(vectors.as_doubles(F.col("embedding"))), 4).alias("norm"))


@query()
def lsh_hamming_topk(spark, sf_dir):
    """The 20 signatures nearest to each of ten probes; no vector given has one within the usual 480 of 2048 bits."""
    v = vectors.signed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 64)
    probes = selection.seeded_sample(v, "vec_id", 10)  # the feature: so many probes
    p = probes.select(F.col("vec_id").alias("probe"), F.col("signature").alias("_s"))
    told = v.crossJoin(F.broadcast(p)).select("probe", "vec_id", (-vectors.hamming(F.col("signature"), F.col("_s"))).alias("score"))  # ten rows
    return vectors.best_of_probes(told, 20).select("probe", "vec_id", (-F.col("score")).alias("distance"))


@query()
def lsh_recall(spark, sf_dir):
    """Recall of the best 20 of 100 probes by the band index, against all vectors by cosine, and the share of the vectors looked at."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = vectors.BandIndex.write(v, spark, 64)
    probes = selection.seeded_sample(v, "vec_id", 100)  # the feature: so many probes
    told = vectors.recall(index.nearest(probes, 20, looks=36), vectors.nearest_of_probes(v, probes, 20), ["probe", "vec_id"])
    return told.crossJoin(F.broadcast(index.share_read(probes, looks=36)))  # one row each


@query()
def word2vec_vocabulary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(T.lower_words(F.col("text")).alias("tokens"))
    return vectors.word_vectors(docs, size=16, window=4, least=50).getVectors().select("word", F.length("word").alias("n_chars"))


@query()
def vec_concepts(spark, sf_dir):
    return vectors.concepts(table(spark, sf_dir, "embeddings"), 10)


# --- markup -----------------------------------------------------------------------------------


@query("SELECT page_id, (i - 1)::INT AS pos, l[i] AS target FROM (SELECT page_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages))")
def html_links(spark, sf_dir):
    return markup.html_links(table(spark, sf_dir, "pages"))


@query("WITH h AS (SELECT page_id, regexp_extract_all(html, '<h([1-6])[^>]*>([^<]*)</h[1-6]>') AS l FROM pages), r AS (SELECT page_id, l, unnest(generate_series(1, len(l))) AS i FROM h) SELECT page_id, (i - 1)::INT AS pos, regexp_extract(l[i], '<h([1-6])', 1)::INT AS level, replace(replace(replace(replace(replace(regexp_extract(l[i], '>([^<]*)<', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') AS title FROM r")
def html_outline(spark, sf_dir):
    return markup.html_outline(table(spark, sf_dir, "pages"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host FROM pages")
def url_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))


@query("WITH m AS (SELECT page_id, regexp_extract_all(html, '</?(?:ul|li|nav|article|footer)\\b') AS l FROM pages), s AS (SELECT page_id, i, CASE WHEN l[i] LIKE '</%' THEN -1 ELSE 1 END AS step FROM (SELECT page_id, l, unnest(generate_series(1, len(l))) AS i FROM m)), d AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM s) SELECT page_id AS doc_id, min(depth) >= 0 AND sum(step) = 0 AS balanced, max(depth)::BIGINT AS max_depth FROM d GROUP BY page_id")
def tag_balance(spark, sf_dir):
    tags = F.regexp_extract_all("html", F.lit(r"</?(?:ul|li|nav|article|footer)\b"), F.lit(0))
    marks = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(tags).alias("seq", "t"))
    return markup.balance(marks.select("doc_id", "seq", F.when(F.col("t").startswith("</"), -1).otherwise(1).alias("step")))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedup_by_content_key(spark, sf_dir):
    return markup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "doc_id").select("doc_id", "copies")


#: A page of markup for each part: heading, link, table with spans, citation, reference.
WIKI = "concat('== ', p_name, ' ==\\nSee [[', p_brand, '|', p_type, ']]s.<ref>', p_brand, '</ref>\\n{| class=\"x\"\\n|+ ', p_type, '\\n! Name !! Size\\n|-\\n! scope=\"row\" | ', p_name, '\\n| ', p_size, '\\n|-\\n| colspan=\"2\" | ', p_brand, '\\n|}\\n{{Infobox part|name=', p_name, '|size=', p_size, '|brand=', p_brand, '|class=box}} {{cite web|url=u', p_size, '|date=2001}}\\n')"


def _wiki(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(WIKI).alias("text"))


@query("SELECT p_partkey AS doc_id, p_type || 's' AS text, split_part(p_brand, '#', 1) AS id FROM part")
def markup_links(spark, sf_dir):
    return markup.items(markup.parsed(_wiki(spark, sf_dir))).filter("type = 'pagelink'").select("doc_id", "text", "id")


@query("WITH p AS (SELECT p_partkey AS doc_id, p_name, p_brand, p_type, p_size::VARCHAR AS p_size FROM part) SELECT doc_id, 'title' AS kind, -1 AS \"row\", p_type AS text, '' AS address FROM p UNION ALL SELECT doc_id, 'head', 0, 'Name', 'C0' FROM p UNION ALL SELECT doc_id, 'head', 0, 'Size', 'C1' FROM p UNION ALL SELECT doc_id, 'head', 1, p_name, 'R1' FROM p UNION ALL SELECT doc_id, 'cell', 1, p_size, 'C1,R1' FROM p UNION ALL SELECT doc_id, 'cell', 2, p_brand, 'C0,C1,R2' FROM p")
def table_addressing(spark, sf_dir):
    grid = markup.addressed(markup.cells(markup.parsed(_wiki(spark, sf_dir))))
    return grid.select("doc_id", "kind", "row", "text", F.array_join("address", ",").alias("address"))


@query("WITH p AS (SELECT p_partkey AS doc_id, p_name, p_brand, p_size::VARCHAR AS p_size FROM part) SELECT doc_id, 'Size' AS head, p_size AS cell FROM p UNION ALL SELECT doc_id, p_name, p_size FROM p UNION ALL SELECT doc_id, 'Name', p_brand FROM p UNION ALL SELECT doc_id, 'Size', p_brand FROM p")
def table_head_pairs(spark, sf_dir):
    return markup.head_pairs(markup.cells(markup.parsed(_wiki(spark, sf_dir)))).select("doc_id", "head", "cell")


@query("WITH p AS (SELECT p_partkey AS doc_id, p_name, p_brand FROM part) SELECT doc_id, 'C0' AS at, 'name' AS head, p_name AS cell FROM p UNION ALL SELECT doc_id, 'C1', 'brand', p_brand FROM p UNION ALL SELECT doc_id, 'C2', 'class', 'box' FROM p")
def infobox_pivot(spark, sf_dir):
    attrs = markup.items(markup.parsed(_wiki(spark, sf_dir))).filter("type = 'attr'")
    told = attrs.select("doc_id", F.substring_index("id", ":", 1).alias("cit"), markup.attribute_name(F.substring_index("id", ":", -1)).alias("key"), F.col("text").alias("value"), "seq")
    return markup.pivoted(told).select("doc_id", "at", "head", "cell")


@query("WITH p AS (SELECT p_partkey AS doc_id, p_brand FROM part) SELECT doc_id, 'table' AS kind, 'table1' AS ident FROM p UNION ALL SELECT doc_id, 'citation', 'cit1' FROM p UNION ALL SELECT doc_id, 'citation', 'cit2' FROM p UNION ALL SELECT doc_id, 'ref', 'ref1' FROM p")
def linked_items(spark, sf_dir):
    return markup.linked_tables(markup.parsed(_wiki(spark, sf_dir))).select("doc_id", "kind", "ident")


@query("SELECT DISTINCT p_type AS name, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'x' ELSE 'text' END AS kind FROM part WHERE p_type NOT LIKE 'ECONOMY%'")
def citation_classes(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_type not like 'ECONOMY%'").select(F.col("p_type").alias("name"), markup.citation_class(F.col("p_type")).alias("kind")).distinct()



@query("WITH p AS (SELECT p_partkey, p_name, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos, p_brand, p_size % 4 + 1 AS level FROM part) SELECT a.p_brand AS doc_id, a.pos AS start, a.level, min(b.pos) AS \"end\" FROM p a LEFT JOIN p b ON a.p_brand = b.p_brand AND b.pos > a.pos AND b.level <= a.level GROUP BY ALL")
def section_intervals(spark, sf_dir):
    pos = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")).cast("long")
    heads = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), pos.alias("pos"), (F.col("p_size") % 4 + 1).alias("level"))
    return postings.fields_paired(heads)


# --- passes over tagged text --------------------------------------------------------------------



@query("WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e) SELECT user_id AS doc_id, min(event_id) AS first, min(event_type) AS cls, count(*) AS n FROM r GROUP BY user_id, run")
def runs_islands(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit(0).alias("sent"), F.col("event_id").alias("seq"), F.col("event_type").alias("cls"), F.col("event_type").alias("value"))
    return nlp.merged_runs(e, None).select("doc_id", "first", "cls", "n")


@query("WITH c AS (SELECT conv_id, turn, role, text FROM conversations) SELECT conv_id AS doc_id, turn AS seq, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM c")
def heading_carry(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("text").alias("value"), "role")
    return nlp.heading_carried(c, F.col("role") == "user").select("doc_id", "seq", "heading")


@query("WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT a.user_id, a.event_id, round(sum(b.value * pow(0.8, a.k - b.k)), 4) AS decayed FROM e a JOIN e b ON a.user_id = b.user_id AND b.k <= a.k GROUP BY a.user_id, a.event_id")
def decay_fold(spark, sf_dir):
    return _rounded(nlp.decayed_sum(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 0.8), "decayed", digits=4).select("user_id", "event_id", "decayed")


@query()
def sentence_classes(spark, sf_dir):
    toks = nlp.tagged_documents(table(spark, sf_dir, "documents")).withColumn("tag", nlp.rule_tags(F.col("value")))
    sents = toks.groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("seq", "value", "tag"))).alias("t"))
    told = sents.select(nlp.sentence_class(F.transform("t", lambda x: x["value"]), F.transform("t", lambda x: x["tag"])).alias("class"))
    return told.groupBy("class").agg(F.count("*").alias("n"))



@query()
def coreference(spark, sf_dir):
    done = nlp.discourse(nlp.sentence_arrays(table(spark, sf_dir, "documents")))
    return done.filter("ref is not null").groupBy("doc_id").agg(F.count("*").alias("n_refs"), F.count("gender").alias("n_pronouns"))



@query("SELECT doc_id, translate(lower(text), '''\"()?!/;:\\’', '') AS plain FROM documents")
def plain_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.plain_token(F.col("text")).alias("plain"))


@query("SELECT p_partkey, replace(replace(replace(replace(p_name || ' & <' || p_brand || '>', '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM part")
def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.escape_xml(F.concat("p_name", F.lit(" & <"), "p_brand", F.lit(">"))).alias("escaped"))


@query("WITH g AS (SELECT DISTINCT p_name, unnest(list_transform(generate_series(1, len(p_name)), lambda i: ('__' || p_name)[i:i + 2])) AS gram FROM part) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def char_ngrams(spark, sf_dir):
    grams = table(spark, sf_dir, "part").select("p_name", F.explode(T.ngrams(3)(F.col("p_name"))).alias("gram")).distinct()
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query()
def stemmed_vocabulary(spark, sf_dir):
    words = postings.document_frequencies(table(spark, sf_dir, "documents"))
    return words.groupBy(T.stem(F.col("value")).alias("stem")).agg(F.sum("df").alias("df"))


# --- sources, sinks, streams -----------------------------------------------------------------


@query("WITH p AS (SELECT page_id, url AS title, CASE WHEN page_id % 7 = 0 THEN 'x' ELSE '' END AS redirect_title, CASE WHEN page_id % 11 = 0 THEN '' ELSE html END AS text FROM pages) SELECT page_id, CASE WHEN redirect_title <> '' AND octet_length(encode(text)) < 1000 THEN 'redirect' WHEN title <> '' AND text <> '' THEN 'document' WHEN title <> '' THEN 'empty' ELSE 'invalid' END AS kind FROM p")
def page_classes(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    df = p.select("page_id", F.col("url").alias("title"), F.when(F.col("page_id") % 7 == 0, "x").otherwise("").alias("redirect_title"), F.when(F.col("page_id") % 11 == 0, "").otherwise(F.col("html")).alias("text"))
    return dumps.classified(df).select("page_id", "kind")


@query("WITH r AS (SELECT source || '/' || lang AS path, CASE WHEN regexp_matches(text, '[0-9]{4,}') THEN 'number' WHEN regexp_matches(text, '@') THEN 'mail' ELSE 'other' END AS class, text FROM documents) SELECT path, class, count(*) AS n, count(DISTINCT text) AS n_distinct FROM r GROUP BY path, class")
def content_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("path"), F.col("text").alias("value"))
    return dumps.path_statistics(docs, [("number", "[0-9]{4,}"), ("mail", "@")])


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_update(spark, sf_dir):
    return dumps.metadata_joined(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "quality", 0)


@query("WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages) SELECT url AS title, '*' || url || ' = ' || array_to_string(l, ';') || ';' AS line FROM l JOIN pages USING (page_id) WHERE len(l) > 0 AND url IN (SELECT url FROM pages GROUP BY url HAVING count(*) = 1)")
def link_dump(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    once = pages.groupBy("url").agg(F.count("*").alias("n"), F.min("page_id").alias("page_id")).filter("n = 1")
    found = markup.html_links(pages).join(once.select("page_id", F.col("url").alias("title")), "page_id")
    return sinks.link_dump(found.select("title", "pos", F.col("target").alias("link")))



@query("WITH " + TOK + ", r AS (SELECT doc_id, pos, value FROM tok WHERE pos % 3 = 0), l AS (SELECT doc_id, pos, value AS link FROM tok WHERE pos % 2 = 0) SELECT doc_id, count(*) AS n FROM r JOIN l USING (doc_id, pos) GROUP BY doc_id")
def align_positions(spark, sf_dir):
    toks = postings.tokens(table(spark, sf_dir, "documents"))
    return selection.aligned(toks.filter("pos % 3 = 0"), toks.filter("pos % 2 = 0")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("WITH " + TOK + ", e AS (SELECT value, count(DISTINCT doc_id) AS df FROM tok GROUP BY value) SELECT value, df::BIGINT AS df FROM e")
def df_increments(spark, sf_dir):
    """The batch form of the streaming merge: signed increments summed."""
    docs = table(spark, sf_dir, "documents")
    plus = statistics.increments(docs.select("text"))
    twice = statistics.increments(docs.filter("doc_id % 3 = 0").select("text", F.lit(1).alias("sign"))).unionByName(statistics.increments(docs.filter("doc_id % 3 = 0").select("text", F.lit(-1).alias("sign"))))
    return postings.merge_df(plus.unionByName(twice)).filter("df <> 0")


@query("WITH u AS (SELECT user_id AS doc_id, event_type AS name, count(*)::DOUBLE AS usage FROM events GROUP BY ALL HAVING count(*) >= 3), s AS (SELECT *, sum(usage) OVER (PARTITION BY doc_id ORDER BY usage DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(usage) OVER (PARTITION BY doc_id) AS total FROM u), c AS (SELECT *, coalesce(max(CASE WHEN run > 0.6 * total THEN usage END) OVER (PARTITION BY doc_id), 3) AS cut FROM s) SELECT doc_id, name, usage FROM c WHERE usage >= cut")
def names_most_used(spark, sf_dir):
    used = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("name")).agg(F.count("*").cast("double").alias("usage"))
    return nlp.most_used(used)


@query("WITH " + TOK + ", c AS (SELECT lang AS path, value, count(*) AS tf FROM tok GROUP BY ALL) SELECT path, max_by(value, (tf, value)) AS value, max(tf) AS tf FROM c GROUP BY path")
def top_word_by_language(spark, sf_dir):
    toks = table(spark, sf_dir, "documents").select(F.col("lang").alias("path"), F.explode(T.lower_words(F.col("text"))).alias("value")).groupBy("path", "value").agg(F.count("*").alias("tf"))
    return toks.groupBy("path").agg(F.max_by("value", F.struct("tf", "value")).alias("value"), F.max("tf").alias("tf"))


@query("WITH " + TOK + ", a AS (SELECT value, count(DISTINCT doc_id) AS df FROM tok WHERE lang = 'en' GROUP BY value), b AS (SELECT value, count(DISTINCT doc_id) AS df FROM tok GROUP BY value) SELECT value, (b.df - coalesce(a.df, 0))::BIGINT AS change FROM b LEFT JOIN a USING (value) WHERE b.df <> coalesce(a.df, 0)")
def statistics_changes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return dumps.statistics_changes(postings.document_frequencies(docs.filter("lang = 'en'")), postings.document_frequencies(docs))


from . import analysis, retrieval  # noqa: E402, F401  (more queries, which share the SQL above)
