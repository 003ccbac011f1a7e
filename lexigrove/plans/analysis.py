"""Registered queries of text functions, sources, sinks, phrases and tagged passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry as functions
from ..functions import text as T
from ..operators import elements, embeddings, markup, nlp, phrases, postings, subjects, tagger
from ..sources import dumps, sinks
from ..sources.shared import new_folder, stored
from .catalog import STATS, TOK, TOKS
from .registry import query, rounded, rounded_double, table


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part")


# --- text functions -----------------------------------------------------------------------------


@query("SELECT p_partkey, lower(p_name) AS lowered, '' AS emptied, 'x' AS fixed, 'E#' || regexp_replace(p_name, '\\s+', '_', 'g') AS tagged, regexp_replace(trim(p_brand), '[^\\p{L}\\p{N}]+', '_', 'g') AS ident FROM part")
def normalizers(spark, sf_dir):
    name = F.col("p_name")
    tagged = T.chain(T.joined_words(), T.prefixed("E#"))(name)
    return _part(spark, sf_dir).select("p_partkey", T.chain(T.same, T.lowered)(name).alias("lowered"), T.emptied(name).alias("emptied"), T.constant("x")(name).alias("fixed"), tagged.alias("tagged"), T.entity_id(F.col("p_brand")).alias("ident"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(strip_accents(coalesce(text, '')), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'Æ', 'AE'), 'Œ', 'OE') AS plain FROM documents")
def without_diacritics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.without_marks(F.coalesce("text", F.lit(""))).alias("plain"))


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[.!?]'))::INT AS n_ends, len(regexp_extract_all(coalesce(text, ''), '[.!?;]'))::INT AS n_more FROM documents")
def end_marks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.size(T.end_marks()(F.col("text"))).alias("n_ends"), F.size(T.end_marks(";")(F.col("text"))).alias("n_more"))


@query("SELECT p_partkey, replace(replace(p_brand, ' ', '_'), '#', '%23') AS file, p_brand AS title FROM part")
def file_names(spark, sf_dir):
    made = _part(spark, sf_dir).select("p_partkey", T.file_id(F.col("p_brand")).alias("file"))
    return made.select("p_partkey", "file", T.file_title(F.concat(F.lit("out/0001/"), F.col("file"), F.lit(".xml"))).alias("title"))


@query("SELECT p_partkey, CASE WHEN len(p_name || p_type) >= 20 THEN left(p_name || p_type, 15) || '__' || p_partkey ELSE p_name || p_type END AS id FROM part")
def short_ids(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", T.short_id(F.concat("p_name", "p_type"), F.col("p_partkey"), 20, 15).alias("id"))


@query("SELECT page_id, split_part(url, '#', 1) AS base, regexp_extract(url, '#(.*)$', 1) AS anchor, lower(regexp_extract(url, '^([A-Za-z]{1,12}):', 1)) AS domain FROM pages")
def link_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.link_base(url).alias("base"), T.link_anchor(url).alias("anchor"), T.link_domain(url).alias("domain"))


@query("SELECT page_id, CASE WHEN len(url) <= 30 THEN url ELSE left(url, 13) || '...' || right(url, 13) END AS shown FROM pages")
def middle_cuts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.middle_cut(F.col("url"), 30).alias("shown"))


@query("SELECT p_partkey, greatest(len(regexp_extract_all(p_brand || p_size, '[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+')) - 1, 0)::INT AS changes, len(p_brand || p_size) > 12 AND len(regexp_extract_all(p_brand || p_size, '[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+')) - 1 >= 4 AS code FROM part")
def code_likeness(spark, sf_dir):
    c = F.concat("p_brand", F.col("p_size").cast("string"))
    return _part(spark, sf_dir).select("p_partkey", T.class_changes(c).alias("changes"), T.is_code(c).alias("code"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%-d %B %Y') AS written, true AS is_date, false AS not_date FROM orders")
def date_shapes(spark, sf_dir):
    written = F.date_format("o_orderdate", "d MMMM yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"), T.is_date(F.split(written, " ")).alias("is_date"), T.is_date(F.split(F.concat(written, F.lit(" or so")), " ")).alias("not_date"))


@query("SELECT p_partkey, replace(replace(replace(p_name, '.', ''), '''', ''), '__', '_') AS rule, CASE p_size % 3 WHEN 0 THEN 'go' ELSE p_name END AS lemma FROM part")
def rule_and_lemma(spark, sf_dir):
    word = F.when(F.col("p_size") % 3 == 0, "went").otherwise(F.col("p_name"))
    return _part(spark, sf_dir).select("p_partkey", T.rule_name(F.col("p_name")).alias("rule"), T.mapped({"went": "go", "gone": "go"})(word).alias("lemma"))


@query("SELECT p_partkey, p_name AS name, p_name || ' & ' || p_brand AS decoded FROM part")
def url_and_entities(spark, sf_dir):
    both = F.concat("p_name", F.lit(" &amp; "), "p_brand")
    return _part(spark, sf_dir).select("p_partkey", T.decode_url(F.replace(F.col("p_name"), F.lit(" "), F.lit("%20"))).alias("name"), T.decode_entities(both).alias("decoded"))


@query("SELECT p_partkey, '{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || ',\"tags\":[\"' || p_type || '\"]}' AS dump FROM part")
def row_dumps(spark, sf_dir):
    return _part(spark, sf_dir).withColumn("tags", F.array("p_type")).select("p_partkey", T.dumped("p_brand", "p_size", "tags").alias("dump"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?s)<p\\b[^<>]*>.*?</p>'))::INT AS n_paragraphs, len(regexp_extract_all(html, '(?s)<div\\b[^<>]*\\bclass=\"ad\"[^<>]*>.*?</div>'))::INT AS n_ads, len(regexp_extract_all(html, '<a\\b[^<>]*?\\bhref=\"[^\"]*\"'))::INT AS n_links FROM pages")
def selectors(spark, sf_dir):
    """Elements by name, by an attribute's value, and attributes of elements."""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.size(T.element(html, "p")).alias("n_paragraphs"), F.size(T.element(html, "div", "class", "ad")).alias("n_ads"), F.size(T.element_attribute(html, "a", "href")).alias("n_links"))


#: Interval labels of the elements of pages, as ``elements`` builds them.
LABELS = (
    r"ev AS MATERIALIZED (SELECT page_id, seq, raw, name, CASE WHEN name IS NULL THEN NULL WHEN starts_with(raw, '</') THEN -1 WHEN ends_with(raw, '/>') OR name IN (" + ", ".join(f"'{v}'" for v in elements.VOID) + ") THEN 0 ELSE 1 END AS kind FROM "
    "(SELECT *, CASE WHEN starts_with(raw, '<') THEN lower(regexp_extract(raw, '^<[/]?([A-Za-z][\\w:.-]*)', 1)) END AS name FROM (SELECT page_id, unnest(rs) AS raw, generate_subscripts(rs, 1) - 1 AS seq FROM "
    "(SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '" + elements.SILENT + "', '', 'g'), '" + elements.EVENT + "') AS rs FROM pages)))), "
    "lv AS (SELECT *, sum(kind) OVER (PARTITION BY page_id, name ORDER BY seq) + (kind = -1)::INT AS level FROM ev WHERE kind IS NOT NULL), "
    "el AS (SELECT page_id, seq AS start, CASE WHEN kind = 1 AND nk = -1 THEN ns ELSE seq END AS fin, name, raw FROM (SELECT *, lead(kind) OVER w AS nk, lead(seq) OVER w AS ns FROM lv WINDOW w AS (PARTITION BY page_id, name, level, kind = 0 ORDER BY seq)) WHERE kind >= 0), "
    "dp AS MATERIALIZED (SELECT a.page_id, a.start, a.fin, a.name, a.raw, count(b.start) + 1 AS depth, max(b.start) AS parent FROM el a LEFT JOIN el b ON a.page_id = b.page_id AND b.start < a.start AND b.fin > a.start GROUP BY ALL)"
)


def _labels(spark, sf_dir):
    """Events and elements of pages, elements written once for the steps that read them."""
    told = elements.events(table(spark, sf_dir, "pages"), "html", "page_id")
    return told, stored(elements.elements(told, "page_id"), spark, "elements")


@query("WITH " + LABELS + ' SELECT page_id, start, fin AS "end", depth::INT AS depth, parent, name FROM dp')
def element_labels(spark, sf_dir):
    """Start, end, depth and parent of every element."""
    return _labels(spark, sf_dir)[1].select("page_id", "start", "end", "depth", "parent", "name")


#: Selectors, and what each means in terms of the labels.
PATHS = {
    "//nav//a": "a.name = 'a' AND EXISTS (SELECT 1 FROM dp b WHERE b.page_id = a.page_id AND b.name = 'nav' AND b.start < a.start AND b.fin > a.start)",
    "/html/body/article/{h1,p}": "a.name IN ('h1', 'p') AND EXISTS (SELECT 1 FROM dp b JOIN dp c ON c.page_id = b.page_id AND c.start = b.parent AND c.name = 'body' JOIN dp d ON d.page_id = c.page_id AND d.start = c.parent AND d.name = 'html' AND d.depth = 1 WHERE b.page_id = a.page_id AND b.start = a.parent AND b.name = 'article')",
    "//div[@class='ad']": r"a.name = 'div' AND regexp_extract(a.raw, '\bclass\s*=\s*\"([^\"]*)\"', 1) = 'ad'",
    "//ul/li": "a.name = 'li' AND EXISTS (SELECT 1 FROM dp b WHERE b.page_id = a.page_id AND b.start = a.parent AND b.name = 'ul')",
}


@query("WITH " + LABELS + ", hit AS (" + " UNION ALL ".join(f"SELECT '{p.replace(chr(39), chr(39) * 2)}' AS path, a.page_id, a.start, a.fin FROM dp a WHERE {w}" for p, w in PATHS.items()) + r"), tx AS (SELECT h.path, h.page_id, h.start, string_agg(raw, '' ORDER BY seq) AS t FROM hit h JOIN ev USING (page_id) WHERE ev.name IS NULL AND seq > start AND seq < fin GROUP BY ALL) SELECT path, page_id, start, trim(regexp_replace(coalesce(t, ''), '[ \t\r\n\f]+', ' ', 'g')) AS text FROM hit LEFT JOIN tx USING (path, page_id, start)")
def selector_paths(spark, sf_dir):
    """Contents of what several paths select: descendants, children from the root on, one of two names, an attribute's value."""
    told, every = _labels(spark, sf_dir)
    out = None
    for path in PATHS:
        found = elements.contents(elements.selected(every, path, "page_id"), told, "page_id").select(F.lit(path).alias("path"), "page_id", "start", "text")
        out = found if out is None else out.unionByName(found)
    return out


@query("WITH " + LABELS + r", it AS (SELECT a.page_id, a.start AS seq, string_agg(ev.raw, '' ORDER BY ev.seq) AS t FROM dp a JOIN ev ON ev.page_id = a.page_id AND ev.seq > a.start AND ev.seq < a.fin WHERE a.name = 'li' AND ev.name IS NULL GROUP BY ALL) SELECT page_id AS doc_id, seq, 'li' AS type, array_to_string(list_transform(list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}]+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '^\p{Lu}') THEN 'E#' ELSE 'N#' END || w), ' ') AS tokens FROM it")
def markup_merged(spark, sf_dir):
    """Words of list items, tagged apart from them and put back at their items."""
    told, every = _labels(spark, sf_dir)
    items = elements.contents(elements.selected(every, "//li", "page_id"), told, "page_id").filter("end > start").select(F.col("page_id").alias("doc_id"), F.col("start").alias("seq"), F.lit("li").alias("type"), "text")
    tagged = items.select("doc_id", "seq", F.posexplode(T.words(F.col("text"))).alias("pos", "value")).withColumn("cls", F.when(F.col("value").rlike(r"^\p{Lu}"), "E").otherwise("N"))
    put = nlp.merged_markup(items, tagged)
    return put.select("doc_id", "seq", "type", F.array_join(F.transform("tokens", lambda t: F.concat(t["cls"], F.lit("#"), t["value"])), " ").alias("tokens"))


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_SIGNS = T.cleaned_signs()


@query(
    "SELECT doc_id, translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(replace(replace(coalesce(text, ''), '''''', '\"'), 'nbsp;', ' '), '&[a-z]*;', ' ', 'g'), "
    f"'{_quoted(_SIGNS[0])}', '{_quoted(_SIGNS[1])}'), '[~_=/#$%&''()*+-]', ' ', 'g'), '[<>()|\\[\\]{{}}]', ' ,', 'g'), ',+\\.', '.', 'g'), '([;,!?:])', ' \\1 ', 'g'), '\\', ' ') AS cleaned FROM documents"
)
def cleanup_chain(spark, sf_dir):
    """The whole clean-up for taggers, over whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_for_tagging(F.coalesce("text", F.lit(""))).alias("cleaned"))


@query("SELECT 'lower' AS name, lower(p_name) AS value, count(*) AS n FROM part GROUP BY lower(p_name)")
def function_registry(spark, sf_dir):
    """A normalizer of one's own, registered and called by name."""
    functions.register("normalizer", "lower", T.lowered)
    run = functions.get("normalizer", "lower")
    return _part(spark, sf_dir).groupBy(run(F.col("p_name")).alias("value")).agg(F.count("*").alias("n")).withColumn("name", F.lit("lower"))


# --- sources and sinks -------------------------------------------------------------------------


def _xml_dump(spark, sf_dir):
    """A page dump of parts, written to the shared folder."""
    path = new_folder(spark, "dump")
    redirect = F.when(F.col("p_partkey") % 7 == 0, F.struct(F.col("p_type").alias("_title")))
    text = F.struct(F.concat("p_brand", F.lit(" & more")).alias("text"))
    pages = _part(spark, sf_dir).select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"), (F.col("p_partkey") % 3).cast("int").alias("ns"), redirect.alias("redirect"), text.alias("revision"))
    pages.write.format("xml").option("rootTag", "dump").option("rowTag", "page").save(path)
    return path


@query("SELECT (p_partkey % 3)::INT AS ns, p_name || ' ' || p_partkey AS title, CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE '' END AS redirect_title, p_brand || ' & more' AS text FROM part WHERE p_partkey % 3 IN (0, 1) AND (contains(p_name, 'red') OR contains(p_name, 'blue'))")
def dump_pages(spark, sf_dir):
    """A dump in XML, read by namespace and title."""
    return dumps.pages(spark, _xml_dump(spark, sf_dir), [0, 1], ["red", "blue"])


@query("SELECT CASE WHEN p_partkey % 7 = 0 THEN 'redirect' ELSE 'document' END AS kind, count(*) AS n FROM part GROUP BY 1")
def dump_kinds(spark, sf_dir):
    return dumps.classified(dumps.pages(spark, _xml_dump(spark, sf_dir))).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'n' || n_nationkey AS key, 'r' || n_regionkey AS target FROM nation")
def redirect_file(spark, sf_dir):
    """Redirects written to a file and read again."""
    path = new_folder(spark, "redirects")
    sinks.write_redirects(table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("target")), path)
    return dumps.redirects(spark, path)


@query("SELECT p_name || p_partkey AS file, p_type AS content FROM part")
def text_streams(spark, sf_dir):
    """Texts written as a stream with headers and read again."""
    path = new_folder(spark, "stream")
    sinks.write_stream(_part(spark, sf_dir).select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("file"), F.col("p_type").alias("content")), path)
    return dumps.text_stream(spark, path).select("file", "content")


@query("SELECT lpad((floor(p_partkey / 1000))::BIGINT::VARCHAR, 4, '0') AS folder, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS n_large FROM part GROUP BY 1")
def kinds_sink(spark, sf_dir):
    """A dataset for each kind of file, in folders of a thousand."""
    path = new_folder(spark, "kinds")
    rows = _part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), "p_name", F.when(F.col("p_size") > 25, F.col("p_type")).alias("err"))
    sinks.write_kinds(rows, path, {"xml": F.col("p_name"), "err": F.col("err")})
    read = lambda kind: spark.read.schema("doc_id long, content string, folder string").parquet(f"{path}/{kind}")
    large = read("err").groupBy("folder").agg(F.count("content").alias("n_large"))
    return read("xml").groupBy("folder").agg(F.count("*").alias("n")).join(large, "folder")


@query("WITH " + TOK + " SELECT value, count(DISTINCT doc_id) AS df, count(*) AS tf FROM tok WHERE value IN ('the', 'of', 'de') GROUP BY value")
def postings_table(spark, sf_dir):
    """Postings written as a bucketed table, looked up by value."""
    name = "postings_" + new_folder(spark, "x").rsplit("-", 1)[1]
    sinks.write_postings(postings.tokens(table(spark, sf_dir, "documents")).withColumn("type", F.lit("stem")), name, 8)
    rows = spark.table(name).filter(F.col("value").isin("the", "of", "de") & (F.col("type") == "stem"))
    return rows.groupBy("value").agg(F.count_distinct("doc_id").alias("df"), F.count("*").alias("tf"))


@query("SELECT doc_id, lang, 0::INT AS pageweight, 0.0::DOUBLE AS rank FROM documents")
def metadata_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return dumps.metadata_added(dumps.metadata_added(docs, "pageweight", "int"), "rank", "double")


EVENT_CLASSES = "CASE event_type WHEN 'click' THEN 'E' WHEN 'view' THEN 'N' WHEN 'purchase' THEN 'P!' ELSE 'T!' END"


def _tagged_events(spark, sf_dir):
    """Events as tagged tokens: a user is a document, the kind of event its class."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("doc_id"), F.lit(0).alias("sent"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"), F.expr(EVENT_CLASSES).alias("cls"), F.lit("").alias("role"), F.lit(None).cast("string").alias("ref"))


@query(f"WITH t AS (SELECT user_id AS doc_id, event_id, CASE {EVENT_CLASSES} WHEN 'P!' THEN ',' WHEN 'T!' THEN ' .' ELSE {EVENT_CLASSES} || '#' || event_type END AS t FROM events) SELECT doc_id, array_to_string(list(t ORDER BY event_id), ' ') || ' ........' AS line FROM t GROUP BY doc_id")
def training_text(spark, sf_dir):
    return sinks.training_lines(_tagged_events(spark, sf_dir))


@query(f"SELECT {EVENT_CLASSES} AS cls, event_type AS value, count(*) AS n FROM events GROUP BY ALL")
def tagged_sink(spark, sf_dir):
    """Tagged tokens written as tab-separated rows and read again."""
    path = new_folder(spark, "tagged")
    sinks.write_tagged(_tagged_events(spark, sf_dir), path)
    read = spark.read.schema("doc_id long, sent int, seq long, cls string, value string, ref string").csv(path, sep="\t")
    return read.groupBy("cls", "value").agg(F.count("*").alias("n"))


@query(f"SELECT user_id::VARCHAR AS file, {EVENT_CLASSES} AS cls, event_type AS value, count(*) AS n FROM events GROUP BY ALL")
def tagged_stream_sink(spark, sf_dir):
    """Tagged tokens as one stream with a header for each document, written and read again."""
    path, tagged = new_folder(spark, "tagged_stream"), _tagged_events(spark, sf_dir)
    sinks.write_tagged_stream(tagged, tagged.select("doc_id", F.col("doc_id").cast("string").alias("file")).distinct(), path)
    return dumps.tagged_stream(spark, path).groupBy("file", "cls", "value").agg(F.count("*").alias("n"))


#: Classes of values with priorities: dates with a time, short titles, words, anything.
ELEMENTS = [dumps.Element("title", priority=1, most=3), dumps.Element("text"), dumps.Element("date", dumps.DATE_TIME, 2, 1, 1, T.content), dumps.Element("number", "[0-9]+", 1)]


@query(r"WITH r AS (SELECT 'order/date' AS path, upper(strftime(o_orderdate::TIMESTAMP, '%d-%b-%y %H:%M')) AS value FROM orders UNION ALL SELECT 'part/name', p_name FROM part UNION ALL SELECT 'part/key', p_partkey::VARCHAR FROM part UNION ALL SELECT 'document/text', coalesce(text, '') FROM documents), k AS (SELECT *, len(list_filter(regexp_split_to_array(value, '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS n FROM r) SELECT path, CASE WHEN regexp_full_match(value, '[0-9]{1,2}[\-][A-Z]+[\-][0-9]{2,4}\s{0,2}[0-9\.\:]+') THEN 'date' WHEN n BETWEEN 1 AND 3 THEN 'title' WHEN n >= 1 THEN 'text' ELSE 'other' END AS class, count(*) AS n, count(DISTINCT value) AS n_distinct FROM k GROUP BY ALL")
def content_classes(spark, sf_dir):
    """Values of four paths by class: a pattern, a length in tokens, a priority."""
    at = lambda df, path, value: df.select(F.lit(path).alias("path"), value.alias("value"))
    orders, part = table(spark, sf_dir, "orders"), _part(spark, sf_dir)
    rows = at(orders, "order/date", F.upper(F.date_format(F.col("o_orderdate").cast("timestamp"), "dd-MMM-yy HH:mm"))).unionByName(at(part, "part/name", F.col("p_name")))
    rows = rows.unionByName(at(part, "part/key", F.col("p_partkey").cast("string"))).unionByName(at(table(spark, sf_dir, "documents"), "document/text", F.coalesce("text", F.lit(""))))
    return dumps.path_classes(rows, ELEMENTS)


@query("SELECT 'v' || vec_id AS name, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS embedding FROM embeddings")
def vector_files(spark, sf_dir):
    """All vectors written in the binary form and read again, in blocks of the reader."""
    path = new_folder(spark, "vectors")
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("name"), "embedding")
    dumps.write_word_vectors(rows, path, 64)
    return dumps.word_vectors(spark, path).select("name", F.transform("embedding", lambda x: rounded_double(x.cast("double"), 6)).alias("embedding"))


# --- phrases and queries -----------------------------------------------------------------------


@query("WITH " + TOKS + " SELECT DISTINCT value, CASE WHEN regexp_matches(value, '^[0-9]+$') THEN 'number' ELSE 'word' END AS type FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS value FROM part)")
def feeder_lexems(spark, sf_dir):
    return phrases.feeder_lexems(_part(spark, sf_dir).select(F.concat_ws(" ", "p_name", "p_brand").alias("name")))


@query("SELECT DISTINCT replace(lower(p_name), ' ', '_') AS phrase, replace(lower(p_name), ' ', '_') AS rule, len(string_split(p_name, ' '))::INT AS n FROM part")
def phrase_rules(spark, sf_dir):
    """A dictionary of names with the names of their rules."""
    return phrases.rule_names(phrases.dictionary(_part(spark, sf_dir).select(F.col("p_name").alias("name")))).select("phrase", "rule", "n")


@query("WITH p AS (SELECT DISTINCT p_name FROM part) SELECT p_name, 'vecsfeat' AS type, replace(lower(p_name), ' ', '_') AS value, 2 AS length FROM p UNION ALL SELECT p_name, 'selstem', 'zebra', 1 FROM p UNION ALL SELECT p_name, 'stem', unnest(list_concat(string_split(lower(p_name), ' '), ['zebra'])), 1 FROM p")
def query_analysis(spark, sf_dir):
    """Each part's name, a comma and a word as a query: phrases cover their words, which stay for ranking."""
    names = _part(spark, sf_dir).select("p_name").distinct()
    queries = names.select(F.col("p_name").alias("qid"), F.concat("p_name", F.lit(", zebra")).alias("query"))
    known = phrases.dictionary(names.select(F.col("p_name").alias("name")))
    told = phrases.analyzed_queries(queries, known.withColumn("id", F.col("phrase")))
    return told.select(F.col("qid").alias("p_name"), "type", "value", "length")


@query("SELECT DISTINCT p_name, 'stem' AS type, unnest(string_split(lower(p_name), ' ')) AS value FROM part")
def query_fallback(spark, sf_dir):
    """Queries without an analyzer: their words alone."""
    names = _part(spark, sf_dir).select(F.col("p_name").alias("qid"), F.col("p_name").alias("query")).distinct()
    return phrases.analyzed_queries(names).select(F.col("qid").alias("p_name"), "type", "value").distinct()


@query("WITH " + TOKS + ", n AS (SELECT doc_id, l, unnest([2, 3]) AS n FROM toks), g AS (SELECT doc_id, n, unnest(list_filter(range(len(l) - n + 1), lambda i: l[i + 1:i + n] = l[1:n])) AS pos, l FROM n WHERE len(l) >= n), e AS (SELECT *, max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g) SELECT doc_id, pos::INT AS pos, n::INT AS n, array_to_string(l[1:n], ' ') AS name FROM e WHERE before IS NULL OR before < pos + n")
def own_title_spans(spark, sf_dir):
    """Where a document's own title stands in it: its first two and three words, the longer covering the shorter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.lower_words(F.col("text")).alias("toks"))
    cut = F.explode(F.array(*(F.array_join(F.slice("toks", 1, n), " ") for n in (2, 3))))
    names = docs.select("doc_id", "toks", cut.alias("name")).filter(F.size(F.split("name", " ")) <= F.size("toks"))
    return nlp.own_spans(docs, names.filter(F.size(F.split("name", " ")) >= 2).select("doc_id", "name"))


#: Names of three, two and one words by brand, with their uses.
_NAMES = "n0 AS (SELECT p_brand AS doc_id, name, sum(u) AS usage FROM (SELECT p_brand, unnest([p_name || ' ' || lower(p_type), p_name, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type)]) AS name, unnest([1.0, 2.0, CASE WHEN p_partkey % 7 = 0 THEN 40.0 ELSE 1.0 END, 1.0, 1.0])::DOUBLE AS u FROM part) GROUP BY ALL)"


def _split_sql(rounds: int, factor: float) -> str:
    """So many rounds of cuts, one after another."""
    sql = "WITH " + _NAMES
    for k in range(rounds):
        sql += f""", u{k} AS (SELECT doc_id, part, sum(usage) AS usage FROM (SELECT DISTINCT doc_id, name, usage, unnest(list_concat([name], list_concat(list_transform(range(1, len(w)), lambda i: array_to_string(w[:i], ' ')), list_transform(range(1, len(w)), lambda i: array_to_string(w[i + 1:], ' '))))) AS part FROM (SELECT *, string_split(name, ' ') AS w FROM n{k})) GROUP BY ALL),
c{k} AS (SELECT doc_id, name, usage AS uses, array_to_string(w[:i], ' ') AS head, array_to_string(w[i + 1:], ' ') AS tail FROM (SELECT *, string_split(name, ' ') AS w, unnest(range(1, len(string_split(name, ' ')))) AS i FROM n{k})),
t{k} AS (SELECT c.*, h.usage AS head_usage, m.usage AS name_usage FROM c{k} c JOIN u{k} h ON h.doc_id = c.doc_id AND h.part = c.head JOIN u{k} m ON m.doc_id = c.doc_id AND m.part = c.name WHERE EXISTS (SELECT 1 FROM n{k} x WHERE x.doc_id = c.doc_id AND x.name = c.head) AND EXISTS (SELECT 1 FROM n{k} x WHERE x.doc_id = c.doc_id AND x.name = c.tail)),
b{k} AS (SELECT * FROM (SELECT *, row_number() OVER w AS r, lead(head_usage) OVER w AS follows FROM t{k} WINDOW w AS (PARTITION BY doc_id, name ORDER BY head_usage DESC, head)) WHERE r = 1 AND head_usage > {factor} * greatest(coalesce(follows, 0), name_usage)),
n{k + 1} AS MATERIALIZED (SELECT doc_id, name, sum(usage) AS usage FROM (SELECT * FROM n{k} WHERE (doc_id, name) NOT IN (SELECT doc_id, name FROM b{k}) UNION ALL SELECT doc_id, unnest([head, tail]), uses FROM b{k}) GROUP BY ALL)"""
    return sql + f" SELECT doc_id, name, usage FROM n{rounds}"


@query(_split_sql(3, 1.2))
def names_split(spark, sf_dir):
    """Names of parts by brand, cut until none is cut any more; names of three words take two rounds at most."""
    name = F.array(F.concat_ws(" ", "p_name", F.lower("p_type")), F.col("p_name"), F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.lower("p_type"))
    uses = F.array(F.lit(1.0), F.lit(2.0), F.when(F.col("p_partkey") % 7 == 0, 40.0).otherwise(1.0), F.lit(1.0), F.lit(1.0))
    names = _part(spark, sf_dir).select(F.col("p_brand").alias("doc_id"), F.explode(F.arrays_zip(name.alias("name"), uses.alias("usage"))).alias("n")).select("doc_id", "n.*")
    return nlp.split_names(names.groupBy("doc_id", "name").agg(F.sum("usage").alias("usage")), spark, factor=1.2)


@query()
def name_genders(spark, sf_dir):
    """Weights of genders of the names of every document, by the pronouns that follow them, and the sure ones."""
    arrays = nlp.sentence_arrays(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return subjects.genders(subjects.tagged_by_form(arrays)).select("doc_id", "name", "gender", F.round("weight", 9).alias("weight"), "sure")


@query("WITH c AS (SELECT value, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS value FROM conversations) GROUP BY value) SELECT value AS word, 16 AS size FROM c WHERE n >= CASE WHEN starts_with(value, 'e') THEN 30 ELSE 20 END")
def skip_gram_words(spark, sf_dir):
    """The words that skip-gram vectors of conversations are learned for, with their vectors' sizes; words in e need more occurrences."""
    docs = table(spark, sf_dir, "conversations").select(T.lower_words(F.col("text")).alias("tokens"))
    found = embeddings.skip_gram(docs, size=16, window=3, negative=5, sample=1e-3, least=20, least_of={"e": 30}, rounds=2)
    return found.select("word", F.size("vector").alias("size"))


# --- a trained tagger ----------------------------------------------------------------------------

#: Turns as a sequence of words: the powers of two of their lengths.
TURNS = "t AS (SELECT conv_id, turn, role AS tag, floor(log2(greatest(length(coalesce(text, '')), 1)))::INT::VARCHAR AS word FROM conversations)"


def _turns(spark, sf_dir):
    size = F.floor(F.log2(F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)))).cast("int").cast("string")
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), F.col("role").alias("tag"), size.alias("word"))


@query("WITH " + TURNS + ", s AS (SELECT lag(tag) OVER (PARTITION BY conv_id ORDER BY turn) AS before, tag FROM t) SELECT 'step' AS kind, before AS given, tag, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'word', word, tag, count(*) FROM t GROUP BY ALL")
def tag_counts(spark, sf_dir):
    """What the tagger learns from: roles after roles, and lengths of turns by role."""
    steps, words = tagger.counts(_turns(spark, sf_dir), "conv_id")
    return steps.select(F.lit("step").alias("kind"), F.col("before").alias("given"), "tag", "n").unionByName(words.select(F.lit("word").alias("kind"), F.col("word").alias("given"), "tag", "n"))


@query()
def turn_roles(spark, sf_dir):
    """Roles of the turns of every fifth conversation by a tagger learned from the others, and those given."""
    turns = _turns(spark, sf_dir)
    model = tagger.train(turns.filter("conv_id % 5 <> 0"), "conv_id")
    rows = turns.filter("conv_id % 5 = 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "word", "tag"))).alias("t"))  # the feature: a held-out part
    return tagger.tagged(rows.select("conv_id", F.col("t.word").alias("words"), F.col("t.tag").alias("given")), model).select("conv_id", "tags", "given")


# --- tagged passes -----------------------------------------------------------------------------

TAGS = [t for tags in nlp.TAG_CLASSES.values() for t in tags.split()]
_TAG_SQL = "CASE " + " ".join("WHEN tag IN (" + ", ".join("'" + t.replace("'", "''") + "'" for t in tags.split()) + f") THEN '{c}'" for c, tags in nlp.TAG_CLASSES.items()) + " ELSE '?' END"
_TAG_LIST = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in [*TAGS, "QQ"]) + "]"


@query(f"WITH t AS (SELECT p_partkey, {_TAG_LIST}[p_partkey % {len(TAGS) + 1} + 1] AS tag FROM part) SELECT tag, {_TAG_SQL} AS cls, count(*) AS n FROM t GROUP BY ALL")
def pos_class_map(spark, sf_dir):
    """All tags of the class table, and one beyond it."""
    tag = F.element_at(F.array(*map(F.lit, [*TAGS, "QQ"])), (F.col("p_partkey") % (len(TAGS) + 1) + 1).cast("int"))
    return _part(spark, sf_dir).select(tag.alias("tag")).groupBy("tag", nlp.class_of(F.col("tag")).alias("cls")).agg(F.count("*").alias("n"))


@query("WITH " + TOK + ", p AS (SELECT value, CASE value WHEN 'he' THEN 'M' WHEN 'his' THEN 'M' WHEN 'him' THEN 'M' WHEN 'she' THEN 'W' WHEN 'her' THEN 'W' WHEN 'it' THEN 'N' WHEN 'its' THEN 'N' WHEN 'they' THEN 'P' WHEN 'their' THEN 'P' END AS gender FROM tok) SELECT gender, count(*) AS n FROM p WHERE gender IS NOT NULL GROUP BY gender")
def pronoun_genders(spark, sf_dir):
    toks = postings.tokens(table(spark, sf_dir, "documents")).withColumn("gender", nlp.gender_of(F.col("value")))
    return toks.filter("gender is not null").groupBy("gender").agg(F.count("*").alias("n"))


@query("SELECT a.p_partkey, list_sort(string_split(a.p_name, ' ')) = list_sort(list_intersect(string_split(a.p_name, ' '), string_split(a.p_name || ' ' || a.p_type, ' '))) OR len(list_distinct(string_split(a.p_name, ' '))) < len(string_split(a.p_name, ' ')) AS within, false AS beyond FROM part a")
def name_subsets(spark, sf_dir):
    name = F.split("p_name", " ")
    return _part(spark, sf_dir).select("p_partkey", nlp.names_within(name, F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("within"), nlp.names_within(F.concat(name, F.array(F.lit("zebra"))), name).alias("beyond"))


@query("WITH u AS (SELECT user_id, count(*) AS uses, sum(value) AS w FROM events GROUP BY user_id) SELECT user_id, round(w + w / 3 + CASE WHEN uses >= 3 THEN w / 3 ELSE 0 END + CASE WHEN uses >= 6 THEN w / 3 ELSE 0 END + CASE WHEN uses >= 9 THEN sqrt(w) ELSE 0 END, 4) AS weight FROM u")
def match_boost(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("uses"), F.sum("value").alias("w"))
    return u.select("user_id", F.round(nlp.boosted(F.col("w"), F.col("uses")), 4).alias("weight"))


@query("WITH e AS (SELECT p_brand AS doc_id, p_name AS name, CASE WHEN p_size % 5 = 0 THEN 1.5 ELSE 1.0 END AS u FROM part) SELECT doc_id, name, sum(u)::DOUBLE AS usage FROM e GROUP BY doc_id, name")
def name_usage(spark, sf_dir):
    return nlp.usage(_part(spark, sf_dir).select(F.col("p_brand").alias("doc_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 5 == 0, "title").otherwise("text").alias("kind")))


@query("WITH u AS (SELECT p_brand AS doc_id, p_name AS name, count(*) AS usage FROM part GROUP BY ALL), f AS (SELECT * FROM u WHERE contains(' blue red green widget anvil big ', ' ' || split_part(name, ' ', 1) || ' ') AND contains(' blue red green widget anvil big ', ' ' || split_part(name, ' ', 2) || ' ')) SELECT doc_id, max_by(name, (usage, -len(string_split(name, ' ')), name)) AS name FROM f GROUP BY doc_id")
def title_names(spark, sf_dir):
    """The most used name of each document whose words stand in a title."""
    used = _part(spark, sf_dir).groupBy(F.col("p_brand").alias("doc_id"), F.col("p_name").alias("name")).agg(F.count("*").alias("usage"))
    return nlp.best_title_match(F.lit("blue red green widget anvil big"), used)


@query("WITH e AS (SELECT p_size % 3 AS doc_id, p_type || ', ' || p_brand AS name FROM part) SELECT doc_id, split_part(name, ', ', 2) AS location, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= 3")
def location_names(spark, sf_dir):
    names = _part(spark, sf_dir).select((F.col("p_size") % 3).alias("doc_id"), F.concat_ws(", ", "p_type", "p_brand").alias("name"))
    return nlp.location_candidates(names)


@query(f"WITH t AS (SELECT user_id AS doc_id, event_id AS seq, event_type AS value, CASE event_type WHEN 'click' THEN 'NNP' WHEN 'view' THEN 'NN' ELSE 'JJ' END AS tag FROM events), l AS (SELECT *, lag(tag) OVER w AS a, lead(tag) OVER w AS b FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) SELECT tag, CASE WHEN a = b AND a IN ('NNP', 'NN') THEN a ELSE tag END AS voted, count(*) AS n FROM l GROUP BY ALL")
def tag_votes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tag = F.when(F.col("event_type") == "click", "NNP").when(F.col("event_type") == "view", "NN").otherwise("JJ")
    rows = e.select(F.col("user_id").alias("doc_id"), F.lit(0).alias("sent"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"), tag.alias("nlptag"), tag.alias("tag"))
    return nlp.voted_tags(rows).groupBy("tag", F.col("nlptag").alias("voted")).agg(F.count("*").alias("n"))


@query(f"WITH t AS (SELECT user_id AS doc_id, list(CASE {EVENT_CLASSES} WHEN 'P!' THEN '' WHEN 'T!' THEN 'V' ELSE {EVENT_CLASSES} END ORDER BY event_id) AS c FROM events GROUP BY user_id), f AS (SELECT *, len(c) AS n, len(list_filter(c, lambda x: x = '')) AS bare, regexp_extract_all(array_to_string(list_transform(c, lambda x: CASE WHEN x = '' THEN 'u' ELSE ' ' END), ''), 'u{{6,}}') AS long FROM t) SELECT doc_id FROM f WHERE list_contains(c, 'V') AND NOT (n > 10 AND n <= 20 AND bare > 2 * n / 3.0) AND NOT (n > 20 AND bare > n / 2.0) AND len(long) = 0")
def sentence_filter(spark, sf_dir):
    cls = F.when(F.col("cls") == "P!", "").when(F.col("cls") == "T!", "V").otherwise(F.col("cls"))
    rows = _tagged_events(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", cls.alias("c")))), lambda x: x["c"]).alias("classes"))
    return nlp.sentence_filter(rows).select("doc_id")


@query("SELECT p_partkey, p_type AS text, CASE WHEN p_size % 2 = 0 THEN p_name END AS ref FROM part")
def entity_references(spark, sf_dir):
    """Names of the entities whose link texts stand in a document."""
    part = _part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("text"), "p_name", "p_size")
    known = part.filter("p_size % 2 = 0").select("doc_id", F.col("p_name").alias("name"), F.col("text").alias("alias"))
    return nlp.inverse_references(part.select("doc_id", "text"), known).select(F.col("doc_id").alias("p_partkey"), "text", "ref")


@query("SELECT p_partkey, array_to_string(['J.', 'R.', p_name], '|') AS parts, p_name AS trimmed, array_to_string(list_concat(string_split(p_name, ' '), [split_part(p_brand, '#', 1) || '#' || split_part(p_brand, '#', 2)]), '|') AS tokens FROM part")
def name_tokens(spark, sf_dir):
    """Abbreviations apart, marks at the ends gone, alpha tokens."""
    name = F.col("p_name")
    told = F.concat(F.lit("J. R. "), name), F.concat(F.lit("'"), name, F.lit(";.\"")), F.concat_ws(" ", name, "p_brand")
    return _part(spark, sf_dir).select("p_partkey", F.array_join(nlp.abbreviation_parts(told[0]), "|").alias("parts"), nlp.trimmed_marks(told[1]).alias("trimmed"), F.array_join(nlp.alpha_tokens(told[2]), "|").alias("tokens"))


_WORDS_SQL = r"s AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[()\[\]{}\x22]')) AS value, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[()\[\]{}\x22]'), 1) - 1 AS seq FROM documents)"


@query("WITH " + _WORDS_SQL + ", o AS (SELECT *, greatest(sum(CASE WHEN value IN ('(', '[', '{') THEN 1 WHEN value IN (')', ']', '}') THEN -1 ELSE 0 END) OVER w, 0) AS inside, sum((value = '\"')::INT) OVER w % 2 = 1 AND value <> '\"' AS quoted FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT inside::BIGINT AS inside, quoted, count(*) AS n FROM o GROUP BY ALL")
def brackets_and_quotes(spark, sf_dir):
    toks = postings.tokens(table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))), T.same, T.matches(r"[\p{L}\p{N}]+|[()\[\]{}\x22]"))
    told = nlp.bracketed(toks.select("doc_id", F.lit(0).alias("sent"), F.col("pos").alias("seq"), "value"))
    return told.groupBy("inside", "quoted").agg(F.count("*").alias("n"))


@query(r"WITH w AS (SELECT p_partkey, p_name, p_brand FROM part) SELECT p_partkey AS doc_id, 4 AS first, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' Works' AS value, 2::BIGINT AS n FROM w")
def quoted_entities(spark, sf_dir):
    """Capitalized words between quotation marks, in a sentence that is no title."""
    first = F.initcap(F.substring_index("p_name", " ", 1))
    text = F.split(F.concat(F.lit('they call it " '), first, F.lit(' Works " here')), " ")
    rows = _part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("sent"), F.posexplode(text).alias("seq", "value"), F.lit("N").alias("cls"))
    return nlp.entity_sequences(rows).select("doc_id", "first", "value", "n")


@query("SELECT p_partkey AS doc_id, 1 AS n_skipped, 3 AS n_pronouns FROM part")
def own_pronouns(spark, sf_dir):
    """Of `his own A met her and it saw B`, the first pronoun refers to nothing new."""
    text = F.split(F.concat(F.lit("his own "), F.substring_index("p_name", " ", 1), F.lit(" met her and it saw "), F.substring_index("p_name", " ", -1)), " ")
    rows = _part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("sent"), F.posexplode(text).alias("seq", "value"), F.lit("N").alias("cls"))
    told = nlp.own_skipped(rows).withColumn("g", nlp.gender_of(F.col("value")).isNotNull().cast("int"))
    return told.groupBy("doc_id").agg(F.sum(F.col("skip").cast("int")).cast("int").alias("n_skipped"), F.sum("g").cast("int").alias("n_pronouns"))


# --- markup ------------------------------------------------------------------------------------

#: A page of markup for each part: quotes, entities, comments, lists, formats, links of all kinds, codes.
PAGE = (
    "concat('== ', p_name, ' ==\\n<!-- note -->\\'\\'\\'', p_type, '\\'\\'\\' said &ldquo;', p_name, '&rdquo; &amp; \"', p_brand, '\" — so.\\n* one [[File:', p_size, '.png]]\\n** two [http://h/', p_size, ' ', p_name, ']\\n"
    "[[Category:', p_type, ']] <nowiki>[[', p_brand, ']]</nowiki> <math>x^', p_size, '</math> [[', p_name, '#', p_brand, ']]\\n\\nEnd \"open http://u/', p_size, ' 20240101T000000Z\\n')"
)


def _pages(spark, sf_dir):
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.expr(PAGE).alias("text"))


@query(
    "WITH p AS (SELECT p_partkey AS doc_id, p_name, p_type, p_brand, p_size::VARCHAR AS z FROM part) "
    "SELECT doc_id, 'heading' AS type, 'h1' AS id, p_name AS text FROM p UNION ALL SELECT doc_id, 'list', 'l1', '' FROM p UNION ALL SELECT doc_id, 'list', 'l2', '' FROM p UNION ALL SELECT doc_id, 'filelink', z || '.png', 'File:' || z || '.png' FROM p "
    "UNION ALL SELECT doc_id, 'weblink', 'http://h/' || z, p_name FROM p UNION ALL SELECT doc_id, 'category', p_type, 'Category:' || p_type FROM p UNION ALL SELECT doc_id, 'nowiki', '', '[[' || p_brand || ']]' FROM p UNION ALL SELECT doc_id, 'math', '', 'x^' || z FROM p "
    "UNION ALL SELECT doc_id, 'pagelink', p_name, p_name || '#' || p_brand FROM p UNION ALL SELECT doc_id, 'weblink', 'http://u/' || z, '' FROM p UNION ALL SELECT doc_id, 'time', '', '20240101T000000Z' FROM p"
)
def markup_items(spark, sf_dir):
    """Every item of the pages but texts and breaks."""
    return markup.items(markup.parsed(_pages(spark, sf_dir))).filter(~F.col("type").isin("text", "br")).select("doc_id", "type", "id", "text")


@query("SELECT p_partkey AS doc_id, p_type || ' said \"' || p_name || '\" & \"' || p_brand || '\" - so.' AS text FROM part")
def markup_text(spark, sf_dir):
    """The first text of each page: formats gone, entities decoded, typographic signs folded, quoted strings kept."""
    first = F.get(F.filter("items", lambda i: i["type"] == "text"), F.lit(0))
    return markup.parsed(_pages(spark, sf_dir)).select("doc_id", first.alias("i")).filter("i is not null").select("doc_id", F.trim("i.text").alias("text"))


@query("WITH p AS (SELECT p_partkey AS doc_id, p_name, p_type, p_size FROM part), l AS (SELECT unnest(['heading', 'quotes', 'string', 'list', 'link', 'weblink', 'nowiki', 'math', 'quotemark', 'timestamp', 'break']) AS kind, unnest([1, 2, 1, 2, 3, 2, 1, 1, 1, 1, 1]) AS each) SELECT kind, each * (SELECT count(*) FROM p) AS n FROM l")
def markup_lexemes(spark, sf_dir):
    return markup.lexemes(_pages(spark, sf_dir)).filter("kind <> 'text'").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS doc_id, p_type AS owner, 'name' AS key, array_to_string(list(p_name ORDER BY p_partkey), ',') AS value, len(array_to_string(list(p_name ORDER BY p_partkey), ',')) <= 80 AS inline FROM part GROUP BY ALL")
def attribute_folding(spark, sf_dir):
    rows = _part(spark, sf_dir).select(F.col("p_brand").alias("doc_id"), F.col("p_type").alias("owner"), F.lit("name").alias("key"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("value"))
    return markup.folded(rows)


@query("SELECT p_brand AS doc_id, '<doc>' || array_to_string(list('<part id=\"' || p_partkey || '\">' || p_name || ' &amp; &lt;' || p_size || '&gt;</part>' ORDER BY p_partkey), '') || '</doc>' AS xml FROM part GROUP BY p_brand")
def xml_documents(spark, sf_dir):
    rows = _part(spark, sf_dir).select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("seq"), F.lit("part").alias("type"), F.col("p_partkey").cast("string").alias("id"), F.concat("p_name", F.lit(" & <"), F.col("p_size").cast("string"), F.lit(">")).alias("text"))
    return markup.xml_of(rows)


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) AS n_runs FROM documents WHERE regexp_matches(text, '(?i)\\b(bgcolor|align|width|style|class)\\s*[=:]') OR len(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda r: len(r) * greatest(len(regexp_extract_all(r, '[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+')) - 1, 0) > 48)) > 0")
def markup_strange(spark, sf_dir):
    found = markup.strange(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).cast("long").alias("n_runs"))


@query("WITH " + STATS + " SELECT value, df, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 0), 6) AS idf FROM dfs, num")
def term_idf(spark, sf_dir):
    from ..operators import ranking
    from .index import index_of

    index = index_of(spark, sf_dir)
    return rounded(index.dfs().select("value", "df", ranking.idf(F.lit(float(index.n)), F.col("df")).alias("idf")), "idf")
