"""Positional postings and the statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def tokens(docs: DataFrame, normalize: T.Normalizer = T.lowered, tokenize: T.Normalizer = T.words, *keep: str) -> DataFrame:
    """(doc_id, pos, value) and kept columns; positions count from 0."""
    return docs.select("doc_id", *keep, F.posexplode(tokenize(normalize(F.col("text")))).alias("pos", "value"))


def term_counts(toks: DataFrame) -> DataFrame:
    """(doc_id, value, tf)."""
    return toks.groupBy("doc_id", "value").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, tokenize: T.Normalizer = T.lower_words) -> DataFrame:
    """(doc_id, doclen), without a shuffle: positions are distinct within a document."""
    return docs.select("doc_id", F.size(tokenize(F.col("text"))).cast("long").alias("doclen"))


def document_frequencies(docs: DataFrame, tokenize: T.Normalizer = T.lower_words) -> DataFrame:
    """(value, df). Words are made distinct within their document's array, so one partial aggregate does."""
    return docs.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("value")).groupBy("value").agg(F.count("*").alias("df"))


def collection_size(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"))


def with_df(terms: DataFrame, df_stats: DataFrame) -> DataFrame:
    """Terms with their df, 0 where the collection lacks them."""
    return terms.join(df_stats, "value", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long")))


def positions(toks: DataFrame, where: Column) -> DataFrame:
    """(doc_id, min_pos, next_pos) of the tokens that a condition selects."""
    return toks.filter(where).groupBy("doc_id").agg(F.min("pos").alias("min_pos"), (F.max("pos") + 1).alias("next_pos"))


def succeeding(items: DataFrame, is_marker: Column) -> DataFrame:
    """Markers with the position of the next item that is none (position = succ)."""
    # backwards, for frames that end at the last row are summed up anew for each row
    w = W.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    at = F.last(F.when(~is_marker, F.col("pos")), ignorenulls=True).over(w)
    return items.withColumn("at", at).filter(is_marker)


def merge_df(parts: DataFrame) -> DataFrame:
    """Sums of df increments by term (and type, if there)."""
    keys = [c for c in ("type", "value") if c in parts.columns]
    return parts.groupBy(*keys).agg(F.sum("df").alias("df"))


def df_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed change of df by term, unchanged terms left out."""
    both = before.select("value", (-F.col("df")).alias("df")).unionByName(after.select("value", "df"))
    return merge_df(both).filter("df <> 0")


def vocabulary(counts: DataFrame, least: int) -> DataFrame:
    return counts.filter(F.col("df") >= least)


def histogram(df_stats: DataFrame, bins: int, low: Column, high: Column) -> DataFrame:
    """(bin, center, n_terms) of df over equal bins."""
    width = (high - low) / bins
    k = F.least(F.floor((F.col("df") - low) / width), F.lit(bins - 1)).cast("long")
    return df_stats.groupBy(k.alias("bin")).agg(F.count("*").alias("n_terms"))


def conflicts(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that stand with more than one value."""
    return pairs.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("first_value")).filter("n_values > 1")


def distinct_or_fail(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """One row a key; a key of two values fails the job."""
    one = pairs.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_other"))
    told = F.when(F.col(value).eqNullSafe(F.col("_other")), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("two values for "), F.col(key).cast("string"))))
    return one.select(key, told.alias(value))


def rarity(counts: DataFrame) -> DataFrame:
    """(value, tf, weight): rarity scaled between the rarest possible and the most frequent."""
    total = counts.agg(F.sum("tf").cast("double").alias("n"), F.max("tf").alias("most"))
    raw = lambda tf: 1 / (F.log((F.col("n") - 0.5) / (tf + 0.5)) + 1)
    low, high = raw(F.lit(0)), raw(F.col("most"))
    scaled = F.when(high == low, F.lit(0.0)).otherwise((raw(F.col("tf")) - low) / (high - low))
    return counts.crossJoin(F.broadcast(total)).select("value", "tf", scaled.alias("weight"))  # one row of totals


def cumulative_cut(usage: DataFrame, group: str, share: float = 0.6, least: int = 3) -> DataFrame:
    """Most used values of a group: of those used ``least`` times, as long as the more used
    ones hold less than ``share`` of all uses.

    Values of one usage stay or go together, so sums run over a group's histogram of usages, of
    which there are at most about the root of twice its uses, and not over its values."""
    kept = usage.filter(F.col("usage") >= least)
    histogram = kept.groupBy(group, "usage").agg(F.count("*").alias("_n"))
    uses = F.col("usage") * F.col("_n")
    told = histogram.withColumn("_before", F.sum(uses).over(W.partitionBy(group).orderBy(F.desc("usage"))) - uses).withColumn("_total", F.sum(uses).over(W.partitionBy(group)))
    cut = told.filter(F.col("_before") < share * F.col("_total")).groupBy(group).agg(F.min("usage").alias("_cut"))
    return kept.join(cut, group).filter(F.col("usage") >= F.col("_cut")).select(*usage.columns)


def dominant(weights: DataFrame, key: str, label: str, weight: str, factor: float = 2.0, least: float = 2.0) -> DataFrame:
    """The label of the greatest weight where it is over ``factor`` times the next and over ``least``; else null."""
    w = W.partitionBy(key).orderBy(F.desc(weight), label)
    ranked = weights.select("*", F.row_number().over(w).alias("_r"), F.lead(weight).over(w).alias("_next"))
    sure = (F.col(weight) > factor * F.coalesce("_next", F.lit(0.0))) & (F.col(weight) > least)
    return ranked.filter("_r = 1").select(key, F.when(sure, F.col(label)).alias(label))


def fields_paired(headings: DataFrame, levels: int = 6) -> DataFrame:
    """Sections from headings (doc_id, pos, level): each ends where the next of its level or above begins."""
    # backwards, for frames that end at the last row are summed up anew for each row
    w = W.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    nexts = {f"_n{k}": F.min(F.when(F.col("level") <= k, F.col("pos"))).over(w) for k in range(1, levels + 1)}
    end = F.lit(None).cast("long")
    for k in range(levels, 0, -1):
        end = F.when(F.col("level") <= k, F.col(f"_n{k}")).otherwise(end) if k == levels else F.when(F.col("level") == k, F.col(f"_n{k}")).otherwise(end)
    return headings.withColumns(nexts).select("doc_id", F.col("pos").alias("start"), "level", end.alias("end"))
