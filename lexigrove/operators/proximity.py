"""Matches near each other: range joins, phrases, passages, accumulated neighbours.

Pairs within a range are joined on (document, bucket of positions) and the next bucket, so
the work grows with the matches near each other, not with a document's squared length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def near_pairs(left: DataFrame, right: DataFrame, reach: int, ordered: bool = False) -> DataFrame:
    """(doc_id, pos, other_pos, left columns, right columns as other_*) with positions at most ``reach`` apart."""
    width = max(reach, 1)
    a = left.withColumn("_bucket", F.explode(F.array(*(F.floor(F.col("pos") / width) + d for d in (-1, 0, 1)))))
    b = right.select("doc_id", *(F.col(c).alias(f"other_{c}") for c in right.columns if c != "doc_id"), F.floor(F.col("pos") / width).alias("_bucket"))
    apart = F.col("other_pos") - F.col("pos")
    fits = (apart > 0) & (apart <= reach) if ordered else (F.abs(apart) <= reach)
    return a.join(b, ["doc_id", "_bucket"]).filter(fits).drop("_bucket")


def with_struct(toks: DataFrame, is_delimiter: Column, name: str = "sent") -> DataFrame:
    """The number of the sentence (or paragraph) of each token: delimiters before it."""
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return toks.withColumn(name, F.coalesce(F.sum(is_delimiter.cast("long")).over(w), F.lit(0).cast("long")))


def within_struct(left: DataFrame, right: DataFrame, reach: int, name: str = "sent", ordered: bool = False) -> DataFrame:
    """Pairs in range and in one sentence."""
    return near_pairs(left, right, reach, ordered).filter(F.col(name) == F.col(f"other_{name}"))


def phrase(docs: DataFrame, words: list[str], tokens: str = "toks") -> DataFrame:
    """(doc_id, pos) where the words follow each other immediately, from an array column of tokens."""
    n, arr = len(words), F.col(tokens)
    fits = lambda i: F.slice(arr, i, F.lit(n)) == F.array(*map(F.lit, words))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(arr) - n + 1, F.lit(1))), fits)
    return docs.filter(F.array_contains(arr, words[0])).select("doc_id", F.explode(starts).alias("pos")).withColumn("pos", F.col("pos") - 1)


def window_hits(hits: DataFrame, size: int) -> DataFrame:
    """For each hit (doc_id, pos, term): distinct terms and hits among the ``size`` positions from it on."""
    w = W.partitionBy("doc_id").orderBy("pos").rangeBetween(0, size - 1)
    return hits.select("*", F.size(F.collect_set("term").over(w)).alias("n_terms"), F.count("*").over(w).alias("n_hits"))


def best_passages(hits: DataFrame, size: int = 40) -> DataFrame:
    """(doc_id, start, n_terms, n_hits): the window with most terms, then hits, then the first."""
    told = window_hits(hits, size)
    best = F.max_by(F.struct(F.col("pos").alias("start"), "n_terms", "n_hits"), F.struct("n_terms", "n_hits", -F.col("pos")))
    return told.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.*")


def highlighted(tokens: Column, start: Column, size: int, terms: list[str] | Column, before: str = "<b>", after: str = "</b>") -> Column:
    """A passage's tokens joined by spaces, those of the query marked."""
    is_term = (lambda t: F.array_contains(terms, F.lower(t))) if isinstance(terms, Column) else (lambda t: F.lower(t).isin(*terms))
    return F.array_join(F.transform(F.slice(tokens, start + 1, F.lit(size)), lambda t: F.when(is_term(t), F.concat(F.lit(before), t, F.lit(after))).otherwise(t)), " ")


def proximity_tf(hits: DataFrame, terms: DataFrame, window: int, cardinality: float, base: float, title_bonus: float = 0.0) -> DataFrame:
    """(doc_id, doclen, value, ff): counts damped to ``base``, hits near other terms in full, and a bonus for those in the title.

    ``hits`` has doc_id, doclen, value, pos, sent and in_title, ``terms`` has value and
    near (whether the term is rare enough for windows). A hit of a near term counts by the share
    of near terms that stand within half a window of it in its sentence, if these are
    ``cardinality`` of them."""
    total = terms.agg(F.sum(F.col("near").cast("int")).alias("n_near"))
    told = hits.join(F.broadcast(terms.select("value", "near").crossJoin(total)), "value")  # a query's terms
    around = W.partitionBy("doc_id", "sent").orderBy("pos").rangeBetween(-(window // 2), window // 2)
    found = F.size(F.collect_set(F.when(F.col("near"), F.col("value"))).over(around))
    full = F.when(F.col("near") & (found >= F.ceil(F.col("n_near") * cardinality)), found / F.col("n_near")).otherwise(0.0)
    rows = told.withColumn("_full", full)
    ff = base * F.count("*") + (1 - base) * F.sum("_full") + title_bonus * F.sum(F.col("in_title").cast("int"))
    return rows.groupBy("doc_id", "doclen", "value").agg(ff.alias("ff"))


def accumulated_near(hits: DataFrame, forward: DataFrame, n_terms: int, reach: int = 30, cardinality: float = 0.75, cofactor: float = 2.5, k: int = 20) -> DataFrame:
    """(doc_id, link, weight): forward values (doc_id, pos, value) near hits, best ``k`` of a document.

    Each place of a value weighs (distinct query terms in range / all terms) ** cofactor, where
    these are at least ``cardinality`` of them."""
    pairs = near_pairs(forward.select("doc_id", "pos", "value"), hits.select("doc_id", "pos", "term"), reach)
    by_place = pairs.groupBy("doc_id", "value", "pos").agg(F.count_distinct("other_term").alias("n"))
    enough = by_place.filter(F.col("n") >= cardinality * n_terms)
    sums = enough.groupBy("doc_id", F.col("value").alias("link")).agg(F.sum(F.pow(F.col("n") / n_terms, F.lit(cofactor))).alias("weight"))
    w = W.partitionBy("doc_id").orderBy(F.desc("weight"), "link")
    return sums.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def first_positions(hits: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, positions): the first ``k`` places of matches in each document."""
    return hits.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("pos")), 1, k).alias("positions"))


def bound_variables(left: DataFrame, right: DataFrame, reach: int, k: int | None = None, ordered: bool = False) -> DataFrame:
    """(doc_id, value, n): values of the right side of pairs within range, how often they are bound."""
    pairs = near_pairs(left.select("doc_id", "pos"), right.select("doc_id", "pos", "value"), reach, ordered)
    out = pairs.groupBy("doc_id", F.col("other_value").alias("value")).agg(F.count("*").alias("n"))
    if k is None:
        return out
    w = W.partitionBy("doc_id").orderBy(F.desc("n"), "value")
    return out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def titles_at(passages: DataFrame, headings: DataFrame) -> DataFrame:
    """Passages (doc_id, start, ...) with ``paratitle``, the last heading (doc_id, pos, value) at or before their start."""
    marks = passages.select("doc_id", F.col("start").alias("pos"), F.lit(1).alias("_p"), F.lit(None).cast("string").alias("value")).unionByName(headings.select("doc_id", "pos", F.lit(0).alias("_p"), "value"))
    w = W.partitionBy("doc_id").orderBy("pos", "_p").rowsBetween(W.unboundedPreceding, 0)
    told = marks.withColumn("paratitle", F.last("value", ignorenulls=True).over(w)).filter("_p = 1")
    return passages.join(told.select("doc_id", F.col("pos").alias("start"), "paratitle").distinct(), ["doc_id", "start"], "left")


def pieces_joined(pieces: DataFrame, glue: str = " --- ") -> DataFrame:
    """(doc_id, abstract): the pieces (doc_id, pos, piece) of each document in order, joined."""
    return pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"]), glue).alias("abstract"))
