"""Candidate selection, restrictions, samples and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holding(counts: DataFrame, terms: DataFrame, least: int | Column | None = None) -> DataFrame:
    """(doc_id): documents that hold at least ``least`` of the terms with df > 0; all of them unless given."""
    live = terms.filter("df > 0").select("value") if "df" in terms.columns else terms.select("value")
    found = counts.join(F.broadcast(live), "value").groupBy("doc_id").agg(F.count_distinct("value").alias("n"))
    if least is None:
        need = live.agg(F.count("*").alias("need"))
        return found.crossJoin(F.broadcast(need)).filter("n >= need").select("doc_id")  # one row
    return found.filter(F.col("n") >= least).select("doc_id")


def title_cardinality(n: int) -> int:
    """Terms that a title must hold: all of up to two, two of three, three of more."""
    return n if n < 3 else 2 if n == 3 else 3


def only_stopwords(terms: DataFrame, n: Column | int) -> DataFrame:
    """Whether every term has df 0 or at least a twelfth of the collection."""
    n = F.lit(n) if isinstance(n, int) else n
    return terms.agg(F.min(((F.col("df") == 0) | (F.col("df") >= n / 12)).cast("int")).cast("boolean").alias("only_stopwords"))


def found_or_fail(terms: DataFrame) -> DataFrame:
    """The terms; the job fails if none of them stands in the collection."""
    most = terms.agg(F.max("df").alias("_most"))
    told = F.when(F.col("_most") > 0, F.col("value")).otherwise(F.raise_error(F.lit("features not found")))
    return terms.crossJoin(F.broadcast(most)).withColumn("value", told).drop("_most")  # one row


def restricted(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.join(docs.select("doc_id"), "doc_id", "left_semi")


def either(*selections: DataFrame) -> DataFrame:
    out = selections[0]
    for s in selections[1:]:
        out = out.unionByName(s)
    return out.distinct()


def aligned(refs: DataFrame, links: DataFrame) -> DataFrame:
    """References whose position is a link's, in one document."""
    return refs.join(links.select("doc_id", "pos", F.col("value").alias("link")), ["doc_id", "pos"])


def seeded(key: Column, seed: int = 0) -> Column:
    """A key's draw: a hash of it and the seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def seeded_sample(rows: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows drawn by a seeded hash of their key."""
    return rows.orderBy(seeded(F.col(key), seed), key).limit(k)


def sharded(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.col(key), F.lit(n)))
