"""Registered queries over the stored index: schemes, link passes, summaries, result pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links, phrases, postings, proximity, ranking, selection
from . import search as plans
from .catalog import HIGH, HITS, LOW, PHRASES, QRY, STATS, TOK, TOKS, _bm_sql, _hits, _ranks, _terms, band_query
from .index import Index, index_of
from .registry import query, rounded, table

# Words with the number of their sentence, places as in TOK; the title is the first sentence.
PLACED = r"""sn AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[.!?\n]+') AS ss FROM documents),
sx AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS sent FROM sn),
sw AS (SELECT doc_id, sent, list_filter(regexp_split_to_array(s, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS l FROM sx),
st AS (SELECT doc_id, sent, unnest(l) AS value, generate_subscripts(l, 1) AS k FROM sw),
pl AS (SELECT doc_id, sent, value, row_number() OVER (PARTITION BY doc_id ORDER BY sent, k) - 1 AS pos, sent = min(sent) OVER (PARTITION BY doc_id) AS in_title FROM st)"""
QRY3 = STATS + ", q AS (SELECT value, df, n, row_number() OVER (ORDER BY df DESC, value) AS idx FROM dfs, num WHERE df >= 0.05 * n AND df <= 0.3 * n ORDER BY df DESC, value LIMIT 3)"
#: Proximity weighted counts of three words, of which those in over a fifth of the documents make no windows.
FF = (
    ", " + PLACED + ", nq AS (SELECT sum((df <= 0.2 * n)::INT) AS n_near FROM q), hp AS (SELECT pl.doc_id, pl.sent, pl.pos, pl.in_title, q.value, q.df <= 0.2 * q.n AS near FROM pl JOIN q USING (value)), "
    "fu AS (SELECT a.doc_id, a.value, a.pos, a.in_title, a.near, count(DISTINCT CASE WHEN b.near THEN b.value END) AS k FROM hp a JOIN hp b ON a.doc_id = b.doc_id AND a.sent = b.sent AND abs(a.pos - b.pos) <= 30 GROUP BY ALL), "
    "ff AS (SELECT doc_id, value, 0.4 * count(*) + 0.6 * sum(CASE WHEN near AND k >= ceil(n_near * 0.6) THEN k / n_near::DOUBLE ELSE 0 END) + 4.0 * sum(in_title::INT) AS ff FROM fu, nq GROUP BY ALL), "
    "bp AS (SELECT doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * ff * 2.2 / (ff + 1.2 * (1 - 0.75 + 0.75 * doclen / 1000.0))) AS score, count(*) AS n_terms FROM ff JOIN q USING (value) JOIN dl USING (doc_id) GROUP BY doc_id)"
)


@query("WITH " + QRY3 + FF + " SELECT doc_id, round(score, 6) AS score FROM bp ORDER BY 2 DESC, 1 LIMIT 20")
def bm25pff(spark, sf_dir):
    """Proximity weighting by windows in a sentence, with a bonus for the title, words of over a fifth of the documents left out of windows."""
    ranks = plans.scored(*_terms(spark, sf_dir, 3), ranking.scheme("BM25pff"))
    return ranking.top(rounded(ranks.select("doc_id", "score"), "score"), 20)


@query("WITH " + QRY3 + FF.rsplit(", bp AS", 1)[0] + " SELECT doc_id, value, round(ff, 6) AS ff FROM ff")
def proximity_counts(spark, sf_dir):
    index, terms = _terms(spark, sf_dir, 3)
    s = ranking.scheme("BM25pff")
    ff = proximity.proximity_tf(index.hits([t["value"] for t in terms]), plans.terms_table(index, terms, s), s.window, s.cardinality, s.ffbase, s.title_bonus)
    return rounded(ff.select("doc_id", "value", "ff"), "ff")


#: Forward features: the longest matches of titles; two words name a feature, three are a title, which links to the least document that begins with it.
FW = (
    PHRASES + ", xe AS (SELECT *, max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m), x AS MATERIALIZED (SELECT doc_id, pos, n, phrase FROM xe WHERE before IS NULL OR before < pos + n)"
    ", tg AS (SELECT l[1] || '_' || l[2] || '_' || l[3] AS phrase, 'd' || min(doc_id) AS target FROM toks WHERE len(l) >= 3 GROUP BY 1)"
    ", fw AS MATERIALIZED (SELECT doc_id, pos, 'vecfname' AS kind, phrase AS value FROM x WHERE n = 2 UNION ALL SELECT doc_id, pos, 'veclfeat', phrase FROM x WHERE n = 3 UNION ALL SELECT doc_id, pos, 'linkid', target FROM x JOIN tg USING (phrase))"
)


def _near_sql(kind: str, reach: int, tail: str = "") -> str:
    return (
        f", p{tail} AS (SELECT f.doc_id, f.value, f.pos, count(DISTINCT h.term) AS k FROM fw f JOIN h ON f.doc_id = h.doc_id AND abs(f.pos - h.pos) <= {reach} WHERE f.kind = '{kind}' GROUP BY ALL), "
        f"a{tail} AS (SELECT doc_id, value AS link, sum(pow(k / 2.0, 2.5)) AS weight FROM p{tail} WHERE k >= 1.5 GROUP BY ALL), w{tail} AS (SELECT doc_id, link, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, link) AS r FROM a{tail}) WHERE r <= 20)"
    )


def _link_sql(*near: tuple[str, int]) -> str:
    tail, each = ", best AS (SELECT doc_id, round(score, 6) AS score FROM bm JOIN (SELECT doc_id, count(DISTINCT value) AS held FROM tok JOIN q USING (value) GROUP BY doc_id) USING (doc_id) WHERE held >= 2 ORDER BY 2 DESC, 1 LIMIT 120)", []
    for kind, reach in near:
        tail += _near_sql(kind, reach, f"_{kind}")
        size = dict(plans.LISTS.values())[plans.LISTS[kind][0]]
        each.append(f"SELECT '{kind}' AS type, link, weight, rank::INT AS rank FROM (SELECT link, weight, row_number() OVER (ORDER BY weight DESC, link) AS rank FROM (SELECT link, round(sum(weight * score), 5) AS weight FROM w_{kind} JOIN best USING (doc_id) GROUP BY link)) WHERE rank <= {size}")
    return _bm_sql(HITS + FW + tail + " " + " UNION ALL ".join(each), avg=500.0)


@query("WITH " + STATS + FW + " SELECT kind, doc_id, pos, value FROM fw")
def forward_features(spark, sf_dir):
    """Every forward feature of the index: longest dictionary matches by kind."""
    return index_of(spark, sf_dir, features=True).features().select("kind", "doc_id", "pos", "value")


@query("WITH " + STATS + FW + " SELECT phrase AS value, n::INT AS length, doc_id, count(*) AS tf, list_sort(list(pos))[1]::INT AS first FROM x GROUP BY ALL")
def phrase_postings(spark, sf_dir):
    """Postings of the phrases, several words long."""
    return index_of(spark, sf_dir, features=True).phrase_postings().select("value", "length", "doc_id", "tf", F.get("hits.pos", F.lit(0)).alias("first"))


@query("WITH " + QRY + HITS + FW + _near_sql("veclfeat", 30) + " SELECT doc_id, link, round(weight, 6) AS weight FROM w")
def near_links(spark, sf_dir):
    titles = index_of(spark, sf_dir, features=True).features().filter("kind = 'veclfeat'")
    return rounded(proximity.accumulated_near(_hits(spark, sf_dir), titles, 2), "weight")


def _linked(spark, sf_dir, name):
    index = index_of(spark, sf_dir, features=True)
    return plans.link_pass(index, index.terms(index.frequent(LOW, HIGH, 2)), ranking.scheme(name))


@query(_link_sql(("linkid", 30)))
def scheme_nblnk(spark, sf_dir):
    return _linked(spark, sf_dir, "NBLNK")


@query(_link_sql(("veclfeat", 30)))
def scheme_tilnk(spark, sf_dir):
    return _linked(spark, sf_dir, "TILNK")


@query(_link_sql(("vecfname", 30)))
def scheme_vclnk(spark, sf_dir):
    return _linked(spark, sf_dir, "VCLNK")


@query(_link_sql(("linkid", 30), ("veclfeat", 30), ("vecfname", 20)))
def scheme_stdlnk(spark, sf_dir):
    """Three kinds of features at once, vectors' names within 20 words."""
    return _linked(spark, sf_dir, "STDLNK")


@query(_bm_sql(", m AS (SELECT doc_id, tanh(len(text) / 5000.0) * 10 AS pageweight FROM documents) SELECT doc_id, round(0.2 * (score * (coalesce(pageweight, 0) / 10)) + 0.8 * score, 6) AS score FROM bm JOIN m USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 20", avg=500.0))
def scheme_pageweight(spark, sf_dir):
    """The link schemes' base: average length 500 and a fifth by page weight."""
    index, terms = _terms(spark, sf_dir)
    weights = index.source.select("doc_id", (F.tanh(F.length("text") / 5000.0) * 10).alias("pageweight"))
    return ranking.top(rounded(plans.scored(index, terms, ranking.scheme("NBLNK"), weights).select("doc_id", "score"), "score"), 20)


def _passage_sql(ranks: str) -> str:
    """Passages for a table ``best`` of ranks, over the sentences of ``pl``."""
    return (
        ranks + ", us AS (SELECT idx FROM q WHERE df <= 0.2 * n OR (SELECT min(df) FROM q) > 0.2 * n), ht AS (SELECT h.doc_id, h.pos, h.term FROM h JOIN best USING (doc_id) WHERE term IN (SELECT idx FROM us)), "
        "wn AS (SELECT a.doc_id, a.pos, count(*) AS n, count(DISTINCT b.term) AS k FROM ht a JOIN ht b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 39 GROUP BY ALL), "
        "pw AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS r FROM wn WHERE k >= ceil(0.6 * (SELECT count(*) FROM us))) WHERE r = 1), "
        "ps AS (SELECT pw.doc_id, pw.pos AS place, min(c.pos) AS begins FROM pw JOIN pl b ON b.doc_id = pw.doc_id AND b.pos = pw.pos JOIN pl c ON c.doc_id = b.doc_id AND c.sent = b.sent GROUP BY ALL), ws AS (SELECT list(value) AS ws FROM q), "
        r"o AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents), "
        "pp AS (SELECT doc_id, CASE WHEN place - begins <= 60 THEN begins ELSE place END AS start, place FROM ps) "
        "SELECT best.doc_id, best.score, o.source || '/' || best.doc_id AS title, CASE WHEN place IS NULL THEN 'docstart' ELSE 'phrase' END AS kind, array_to_string(list_transform(t[coalesce(start, 0) + 1:coalesce(place, 0) + 40], lambda x: CASE WHEN list_contains(ws, lower(x)) THEN '<b>' || x || '</b>' ELSE x END), ' ') AS abstract "
        "FROM best JOIN o USING (doc_id) CROSS JOIN ws LEFT JOIN pp USING (doc_id)"
    )


HELD = ", held AS (SELECT doc_id, count(DISTINCT value) AS held FROM tok JOIN q USING (value) GROUP BY doc_id)"


@query(_bm_sql(HITS + ", " + PLACED + HELD + _passage_sql(", best AS (SELECT doc_id, round(score, 6) AS score FROM bm JOIN held USING (doc_id) WHERE held >= 2 ORDER BY 2 DESC, 1 LIMIT 6)")))
def search_flagship(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return plans.search(index, band_query(index))


#: The link pass's titles, their weights damped, and the sum of these in each document that holds them.
LINKED = (
    ", bl AS (SELECT tf.doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doclen / 500.0))) AS score FROM tf JOIN q USING (value) JOIN dl USING (doc_id) GROUP BY tf.doc_id)"
    ", lb AS (SELECT doc_id, round(score, 6) AS score FROM bl JOIN held USING (doc_id) WHERE held >= 2 ORDER BY 2 DESC, 1 LIMIT 120)" + FW + _near_sql("veclfeat", 30) + ", lk AS (SELECT link, ln(weight) AS weight FROM (SELECT link, weight, row_number() OVER (ORDER BY weight DESC, link) AS rank "
    "FROM (SELECT link, round(sum(weight * score), 5) AS weight FROM w JOIN lb USING (doc_id) GROUP BY link)) WHERE rank <= 20 AND weight > 0), s1 AS (SELECT doc_id, sum(weight) AS s1 FROM (SELECT DISTINCT doc_id, phrase FROM x) JOIN lk ON phrase = link GROUP BY doc_id)"
)


@query(_bm_sql(FF + HITS + HELD + LINKED + _passage_sql(", best AS (SELECT doc_id, round(0.7 * coalesce(s1, 0) + (1 - 0.7) * score, 6) AS score FROM bp JOIN held USING (doc_id) LEFT JOIN s1 USING (doc_id) WHERE held >= 2 ORDER BY 2 DESC, 1 LIMIT 6)")))
def search_std(spark, sf_dir):
    """Link pass, then proximity weighting mixed with the logarithms of the weights of the titles that a document holds."""
    index = index_of(spark, sf_dir, features=True)
    return plans.search(index, band_query(index), s="STD")


#: A query of the most frequent phrase and word of the middle band; its terms are the phrase, its words but the first, and the word.
QP = (
    STATS + FW + ", pd AS (SELECT phrase AS value, count(DISTINCT doc_id) AS df FROM x GROUP BY phrase), bp AS (SELECT value FROM pd, num WHERE df >= 0.05 * n AND df <= 0.3 * n ORDER BY df DESC, value LIMIT 1), bw AS (SELECT value FROM dfs, num WHERE df >= 0.05 * n AND df <= 0.3 * n ORDER BY df DESC, value LIMIT 1)"
    ", q AS (SELECT value, df FROM pd JOIN bp USING (value) UNION SELECT value, df FROM dfs WHERE value IN (SELECT unnest(string_split(value, '_')[2:]) FROM bp) OR value IN (SELECT value FROM bw))"
    ", ctf AS (SELECT doc_id, value, count(*) AS tf FROM tok WHERE value IN (SELECT value FROM q) GROUP BY ALL UNION ALL SELECT doc_id, phrase, count(*) FROM x WHERE phrase IN (SELECT value FROM q) GROUP BY ALL)"
)


@query("WITH " + QP + " SELECT doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doclen / 1000.0))), 6) AS score FROM ctf JOIN q USING (value) JOIN dl USING (doc_id), num GROUP BY doc_id HAVING count(*) = (SELECT count(*) FROM q) ORDER BY 2 DESC, 1 LIMIT 20")
def phrase_search(spark, sf_dir):
    """A query with a phrase of the dictionary: documents that hold it and the other words, the phrase a term with its own frequencies."""
    index = index_of(spark, sf_dir, features=True)
    q = index.frequent_phrases(LOW, HIGH, 1)[0].replace("_", " ") + ", " + index.frequent(LOW, HIGH, 1)[0]
    terms = plans.query_terms(index, q)
    return ranking.top(rounded(plans.candidates(index, terms, ranking.scheme("BM25")).select("doc_id", "score"), "score"), 20)


@query(_bm_sql(", best AS (SELECT doc_id FROM bm JOIN (SELECT doc_id, count(DISTINCT value) AS held FROM tok JOIN q USING (value) GROUP BY doc_id) USING (doc_id) WHERE held >= 2 ORDER BY score DESC, doc_id LIMIT 6) SELECT doc_id, value, tf, doclen::BIGINT AS doclen, df, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 0), 6) AS idf, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doclen / 1000.0)), 6) AS part FROM tf JOIN q USING (value) JOIN dl USING (doc_id) JOIN best USING (doc_id)"))
def debug_parts(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return plans.explained(index, band_query(index))


@query("SELECT doc_id, source || '/' || doc_id AS title FROM documents")
def document_attributes(spark, sf_dir):
    return index_of(spark, sf_dir).docs().select("doc_id", "title")


@query("WITH " + QRY + HITS + " SELECT doc_id, array_to_string(list_sort(list(DISTINCT pos))[1:10], ',') AS positions FROM h GROUP BY doc_id")
def match_positions(spark, sf_dir):
    return proximity.first_positions(_hits(spark, sf_dir)).select("doc_id", F.array_join("positions", ",").alias("positions"))


@query("WITH " + QRY + HITS + FW + ", b AS (SELECT h.doc_id, f.value, count(*) AS n FROM h JOIN fw f ON h.doc_id = f.doc_id AND abs(f.pos - h.pos) <= 10 WHERE f.kind = 'linkid' GROUP BY ALL) SELECT doc_id, value, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, value) AS r FROM b) WHERE r <= 5")
def match_variables(spark, sf_dir):
    """The links that stand within ten words of a match, the five most bound of each document."""
    return proximity.bound_variables(_hits(spark, sf_dir), index_of(spark, sf_dir, features=True).features().filter("kind = 'linkid'"), 10, 5)


@query("WITH " + STATS + ", " + PLACED + ", t AS (SELECT value, count(DISTINCT doc_id) AS n_titles FROM pl WHERE in_title GROUP BY value) SELECT value, df, n_titles FROM t JOIN dfs USING (value)")
def title_field(spark, sf_dir):
    """How many titles hold each word, and how many documents do."""
    rows = index_of(spark, sf_dir).postings()
    inside = F.exists("hits", lambda h: h["sent"] == F.col("title_sent"))
    return rows.groupBy("value").agg(F.count("*").alias("df"), F.sum(inside.cast("long")).alias("n_titles")).filter("n_titles > 0")


@query("WITH " + QRY + ", " + PLACED + ", ph AS MATERIALIZED (SELECT pl.doc_id, pl.sent, pl.pos, q.idx FROM pl JOIN q USING (value)) SELECT a.doc_id, a.pos::INT AS pos, b.pos::INT AS other_pos FROM ph a JOIN ph b ON a.doc_id = b.doc_id AND a.sent = b.sent WHERE a.idx = 1 AND b.idx = 2 AND b.pos - a.pos BETWEEN 1 AND 100")
def ordered_in_sentence(spark, sf_dir):
    """The first word and then the second within 100 words of one sentence."""
    h = _hits(spark, sf_dir)
    return proximity.within_struct(h.filter("term = 1").drop("term"), h.filter("term = 2").drop("term"), 100, ordered=True).select("doc_id", "pos", "other_pos")


@query("WITH " + QRY + HITS + ", " + PLACED + ", c AS (SELECT DISTINCT h.doc_id, pl.sent FROM h JOIN pl ON h.doc_id = pl.doc_id AND h.pos = pl.pos), s AS (SELECT doc_id, sent, array_to_string(list(value ORDER BY pos), ' ') AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY sent) AS r FROM pl JOIN c USING (doc_id, sent) GROUP BY doc_id, sent) SELECT doc_id, array_to_string(list(piece ORDER BY sent), ' --- ') AS abstract FROM s WHERE r <= 3 GROUP BY doc_id")
def abstract_pieces(spark, sf_dir):
    """The first three sentences that hold a word of the query, joined."""
    from pyspark.sql import Window as W

    hit = _hits(spark, sf_dir).select("doc_id", "sent").distinct()
    first = hit.withColumn("_r", F.row_number().over(W.partitionBy("doc_id").orderBy("sent"))).filter("_r <= 3")
    texts = index_of(spark, sf_dir).texts().select("doc_id", F.arrays_zip("words", "sents").alias("ws"))
    pieces = texts.join(first, "doc_id").select("doc_id", F.col("sent").alias("pos"), F.lower(F.array_join(F.transform(F.filter("ws", lambda w: w["sents"] == F.col("sent")), lambda w: w["words"]), " ")).alias("piece"))
    return proximity.pieces_joined(pieces)


@query("WITH " + QRY + HITS + ", hd AS (SELECT doc_id, pos, value FROM tok WHERE pos % 50 = 0), w AS (SELECT a.doc_id, a.pos, count(*) AS n_hits, count(DISTINCT b.term) AS n_terms FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 39 GROUP BY a.doc_id, a.pos), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_terms DESC, n_hits DESC, pos) AS k FROM w) SELECT r.doc_id, r.pos::INT AS start, max_by(hd.value, hd.pos) AS paratitle FROM r JOIN hd ON r.doc_id = hd.doc_id AND hd.pos <= r.pos WHERE k = 1 GROUP BY r.doc_id, r.pos")
def passage_titles(spark, sf_dir):
    """The last heading before each best passage; every fiftieth word stands for one."""
    heads = postings.tokens(table(spark, sf_dir, "documents")).filter("pos % 50 = 0").select("doc_id", "pos", "value")
    best = proximity.best_passages(_hits(spark, sf_dir)).select("doc_id", "start")
    return proximity.titles_at(best, heads)


@query("WITH q AS (SELECT doc_id, tanh(len(text) / 5000.0) * 10 AS pageweight FROM documents) SELECT doc_id FROM q WHERE doc_id >= 10 AND pageweight >= 2 ORDER BY doc_id LIMIT 20")
def document_browser(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return plans.browsed(docs, docs.select("doc_id", (F.tanh(F.length("text") / 5000.0) * 10).alias("pageweight")), 2.0, 10)


@query("WITH e AS (SELECT user_id % 8 AS client, sum(value) AS seconds FROM events GROUP BY 1) SELECT round(max(seconds), 6) AS longest, round(1600 / max(seconds), 6) AS per_second FROM e")
def load_throughput(spark, sf_dir):
    times = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("client")).agg(F.sum("value").alias("seconds"))
    return rounded(plans.throughput(times, 1600), "longest", "per_second")


@query("WITH " + STATS + ", bw AS (SELECT value FROM dfs, num WHERE df >= 0.05 * n AND df <= 0.3 * n ORDER BY df DESC, value LIMIT 3), sq AS (SELECT doc_id, count(*) AS tf FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 1)) AS i FROM toks WHERE len(l) > 1) WHERE l[i] = 'of' AND l[i + 1] = 'the' GROUP BY doc_id), wt AS (SELECT value, df, 2.0 AS weight FROM dfs WHERE value IN (SELECT value FROM bw) UNION ALL SELECT 'of the', count(*), 1.0 FROM sq), tf AS (SELECT doc_id, value, count(*) AS tf FROM tok WHERE value IN (SELECT value FROM bw) GROUP BY ALL UNION ALL SELECT doc_id, 'of the', tf FROM sq), b AS (SELECT tf.doc_id, sum(weight * greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doclen / 1000.0))) AS score FROM tf JOIN wt USING (value) JOIN dl USING (doc_id), num GROUP BY tf.doc_id) SELECT doc_id, round(score, 6) AS score FROM b WHERE score >= 1.5 ORDER BY 2 DESC, 1 LIMIT 20")
def structured_query(spark, sf_dir):
    """Three words of weight 2 and an entity, two words in order, of weight 1; at least 1.5 in all."""
    index = index_of(spark, sf_dir)
    words = [{"type": "word", "value": w, "weight": 2.0} for w in index.frequent(LOW, HIGH, 3)]
    return plans.structured(index, {"features": [*words, {"type": "entity", "value": "of the", "weight": 1.0}], "results": 20, "minweight": 1.5})


@query("SELECT md5(doc_id || ':7') AS h, doc_id FROM documents ORDER BY 1, 2 LIMIT 200")
def random_sample(spark, sf_dir):
    rows = selection.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 200, 7)
    return rows.select(selection.seeded(F.col("doc_id"), 7).alias("h"), "doc_id")


@query(_bm_sql(", lk AS (SELECT page_id AS doc_id, count(*) / 10.0 AS s1 FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) FROM pages) GROUP BY 1) SELECT bm.doc_id, round(0.7 * coalesce(s1, 0) + (1 - 0.7) * score, 6) AS score FROM bm LEFT JOIN lk USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 20"))
def two_pass_std(spark, sf_dir):
    """Ranks mixed with the summed weights of matched links, each of weight a tenth here."""
    from ..operators import markup

    weights = markup.html_links(table(spark, sf_dir, "pages")).groupBy(F.col("page_id").alias("doc_id")).agg((F.count("*") / 10.0).alias("s1"))
    both = _ranks(spark, sf_dir).join(weights, "doc_id", "left")
    return ranking.top(rounded(both.select("doc_id", ranking.mixed(F.col("score"), F.coalesce("s1", F.lit(0.0)), 0.7).alias("score")), "score"), 20)


#: Forms that stand for one word in both the index and queries.
IRREGULAR = {"was": "be", "is": "be", "are": "be", "were": "be", "les": "le", "la": "le", "die": "der", "das": "der"}
NTOK = TOKS + ", tok AS (SELECT doc_id, source, lang, strip_accents(CASE " + " ".join(f"WHEN value = '{a}' THEN '{b}'" for a, b in IRREGULAR.items()) + " ELSE value END) AS value, pos FROM (SELECT doc_id, source, lang, unnest(l) AS value, generate_subscripts(l, 1) - 1 AS pos FROM toks))"


@query(_bm_sql(" SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY 2 DESC, 1 LIMIT 20").replace(TOK, NTOK).replace("q AS (SELECT value, df, n, row_number() OVER (ORDER BY df DESC, value) AS idx FROM dfs, num WHERE df >= 0.05 * n AND df <= 0.3 * n ORDER BY df DESC, value LIMIT 2)", "q AS (SELECT value, df, n, 1 AS idx FROM dfs, num WHERE value IN ('be', 'le', 'der'))"))
def chain_search(spark, sf_dir):
    """Any of three words, asked for by other forms of them, over an index whose words went through the whole chain but for stems."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = Index.write(docs, spark, dictmap=IRREGULAR, marks_go=True)
    terms = index.terms(index.analyzed(["WERE", "La", "Die"]))
    return ranking.top(rounded(plans.scored(index, terms, ranking.scheme("BM25")).select("doc_id", "score"), "score"), 20)


#: BM25 by the older constants, page weights and a constant score, as parts of formulas.
PARTS = ", m AS (SELECT doc_id, tanh(len(text) / 5000.0) * 10 AS pageweight FROM documents), p AS (SELECT doc_id, score AS _0, coalesce(pageweight, 0) AS _1, 0.1 AS _2 FROM bm JOIN m USING (doc_id))"


def _parts(spark, sf_dir, scheme):
    index, terms = _terms(spark, sf_dir)
    weights = table(spark, sf_dir, "documents").select("doc_id", (F.tanh(F.length("text") / 5000.0) * 10).alias("_1"))
    ranks = plans.scored(index, terms, ranking.scheme(scheme)).select("doc_id", F.col("score").alias("_0"))
    return ranks.join(weights, "doc_id").select("doc_id", "_0", "_1", F.lit(0.1).alias("_2"))


@query(_bm_sql(PARTS + " SELECT doc_id, round(0.2 * _0 * (_1 / 10) + (1 - 0.2) * _0, 6) AS score FROM p ORDER BY 2 DESC, 1 LIMIT 20"))
def formula_pageweight(spark, sf_dir):
    """A scheme's formula with a named weight, evaluated over its parts."""
    told = ranking.by_formula(_parts(spark, sf_dir, "BM25"), "d * _0 * (_1 / 10) + (1 - d) * _0", d=0.2)
    return ranking.top(rounded(told.select("doc_id", "score"), "score"), 20)


@query(_bm_sql(PARTS + " SELECT doc_id, round(_0 + 2 * _1 + 0.1, 6) AS score FROM p ORDER BY 2 DESC, 1 LIMIT 20", k1=0.75, b=2.1))
def formula_older(spark, sf_dir):
    """The older weighted sum: BM25 by its constants, twice the page weight, and a constant score."""
    told = ranking.weighted_sum(_parts(spark, sf_dir, "BM25old"), _0=1.0, _1=2.0, _2=1.0)
    return ranking.top(rounded(told.select("doc_id", "score"), "score"), 20)


@query("WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link FROM pages), w AS (SELECT link, count(*) AS weight FROM l GROUP BY link) SELECT link, weight FROM w ORDER BY weight DESC, link LIMIT 20 OFFSET 5")
def links_paged(spark, sf_dir):
    from ..operators import markup

    counts = markup.html_links(table(spark, sf_dir, "pages")).groupBy(F.col("target").alias("link")).agg(F.count("*").alias("weight"))
    return ranking.top(counts, 20, 5, "weight", "link")


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT name, replace(name, '_', ' ') AS shown, replace(replace(name, ' ', '+'), '#', '%23') AS encoded FROM n WHERE lower(replace(name, '_', ' ')) <> 'red widget'")
def related_terms(spark, sf_dir):
    return links.related_terms(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct(), "red widget").select("name", "shown", "encoded")


@query("WITH " + STATS + ", w AS (SELECT unnest(['the', 'of', 'no_such_word']) AS value), t AS (SELECT value, coalesce(df, 0) AS df FROM w LEFT JOIN dfs USING (value)) SELECT value, df::BIGINT AS df FROM t")
def features_found(spark, sf_dir):
    """The terms of a query with df; it fails if the collection holds none."""
    index = index_of(spark, sf_dir)
    words = ["the", "of", "no_such_word"]
    terms = spark.createDataFrame([(w,) for w in words], "value string")
    return selection.found_or_fail(postings.with_df(terms, index.dfs(words).select("value", "df")))

