"""Weighting schemes over term counts, and rank lists.

Formulas after Robertson and Zaragoza (2009); document frequencies and the collection size
are those of the whole collection, and the average length is a constant of the scheme.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scheme:
    """A ranking scheme's constants."""

    name: str
    k1: float = 1.2
    b: float = 0.75
    avgdoclen: float = 1000.0
    pageweight: float | None = None  # share of the page weight
    window: int | None = None  # proximity window
    cardinality: float = 0.6
    ffbase: float = 0.4
    title_bonus: float = 4.0
    maxdf: float = 0.2
    links: float | None = None  # share of link features
    near: tuple[tuple[str, int], ...] = ()  # forward features that are accumulated near matches, with their ranges
    near_cardinality: float = 0.75
    cofactor: float = 2.5
    limit_per_doc: int = 20


def _link_scheme(name: str, *near: tuple[str, int]) -> Scheme:
    return Scheme(name, avgdoclen=500.0, pageweight=0.2, near=near)


#: The schemes by name.
SCHEMES = {
    s.name: s
    for s in (
        Scheme("BM25"),
        Scheme("BM25pg", pageweight=0.2),
        Scheme("BM25pff", window=60),
        Scheme("BM25std", window=60, links=0.7),
        _link_scheme("NBLNK", ("linkid", 30)),
        _link_scheme("TILNK", ("veclfeat", 30)),
        _link_scheme("VCLNK", ("vecfname", 30)),
        _link_scheme("STDLNK", ("linkid", 30), ("veclfeat", 30), ("vecfname", 20)),
        Scheme("BM25old", k1=0.75, b=2.1),
    )
}


def scheme(name: str) -> Scheme:
    """A scheme by name; unknown names fail."""
    if name not in SCHEMES:
        raise ValueError(f"unknown scheme: {name}")
    return SCHEMES[name]


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(0.0))


def tf_weight(tf: Column, doclen: Column, s: Scheme) -> Column:
    return tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * doclen / s.avgdoclen))


def bm25(counts: DataFrame, terms: DataFrame, n: Column | int, s: Scheme = SCHEMES["BM25"], count: str = "tf") -> DataFrame:
    """(doc_id, score, n_terms) from (doc_id, value, tf, doclen) and query terms (value, df, weight)."""
    n = F.lit(float(n)) if isinstance(n, int) else n
    hit = counts.join(F.broadcast(terms), "value")  # a query's terms
    score = F.sum(F.col("weight") * idf(n, F.col("df")) * tf_weight(F.col(count), F.col("doclen"), s))
    return hit.groupBy("doc_id").agg(score.alias("score"), F.count_distinct("value").alias("n_terms"))


def mixed(first: Column, second: Column, share: float) -> Column:
    """share * second + (1 - share) * first."""
    return share * second + (1 - share) * first


def with_pageweight(score: Column, pageweight: Column, share: float = 0.2) -> Column:
    return mixed(score, score * (pageweight / 10), share)


def pageweight_of(references: Column) -> Column:
    return F.tanh(references / 50)


def by_formula(ranks: DataFrame, formula: str, name: str = "score", **weights: float) -> DataFrame:
    """Ranks with a score by a formula of SQL over their columns and named weights, as ``d * _1 + (1 - d) * _0``.

    Columns that are null count as 0; a weight hides a column of its name."""
    parts = [c for c in ranks.columns if c not in weights]
    filled = ranks.select(*(F.coalesce(F.col(c), F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in ranks.dtypes if c in parts), *(F.lit(float(v)).alias(k) for k, v in weights.items()))
    return filled.withColumn(name, F.expr(formula)).select(*dict.fromkeys([*parts, name]))


def weighted_sum(ranks: DataFrame, name: str = "score", **weights: float) -> DataFrame:
    """Ranks with the sum of their score columns times the weights named after these."""
    return by_formula(ranks, " + ".join(f"{w!r}D * `{c}`" for c, w in ((c, float(w)) for c, w in weights.items())) or "0.0D", name)


def top(ranks: DataFrame, k: int, first: int = 0, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """Ranks first .. first + k, ties by the least key."""
    return ranks.orderBy(F.desc(score), tie).offset(first).limit(k)


def top_in_groups(rows: DataFrame, group: str, k: int, score: str, tie: str) -> DataFrame:
    w = W.partitionBy(group).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def merged(shards: DataFrame, shard: str, k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """Each shard's best k, merged; ties by shard, then key."""
    best = top_in_groups(shards, shard, k, score, tie)
    return best.orderBy(F.desc(score), shard, tie).limit(k)


def has_more(ranks: DataFrame, k: int, first: int = 0) -> DataFrame:
    """Whether rank first + k exists, told from one more row than is shown."""
    return top(ranks, k + 1, first).agg((F.count("*") > k).alias("has_more"), F.least(F.count("*"), F.lit(k).cast("long")).alias("n_shown"))
