"""Quality rules: robust multivariate outliers, in DataFrame functions alone.

A document fails the base rules below ``MIN_WORDS`` words or when more than half of its
words lie in repeated 3-word windows. The others are points of five transformed
statistics: log length, log mean word length, and the shares of symbols, repeated lines
and repeated words. For each language and source, a minimum-covariance-determinant
estimate is found from three deterministic starts about the medians (mean absolute
deviations, scatter of tanh scores, scatter of spatial signs) by concentration steps: keep
the half with the smallest Mahalanobis distances, estimate mean and covariance from it,
again, until the determinant falls no more. Of all starts, the estimate of least
determinant counts. Shares are zero in most documents, which would leave the determinant 0,
so a fixed variance is added on the diagonal, as the regularised estimate (MRCD) does. A
document goes if its squared distance exceeds ``LIMIT``. Groups of fewer than ``MIN_GROUP``
points use their language's estimate, and languages of fewer points that of all documents;
only in a table of fewer points is nothing rejected beyond the base rules.

All statistics cover all rows and are the same in any order of the rows: the points are
whole numbers of steps of 2**-10 (logarithms) or 2**-14 (shares), so that their sums and
products add up exactly, and medians and the half's limit count the values, of which there are
a bounded number. Sums and counts are merged from partial ones, and groups get their estimate
by broadcast (all of them if they are few, else those that hold more than 1/2000 of the
points), so no group meets in one task. Sums are exact up to 2e10 points in a group.

Defined cases: null text has no words and fails the base rules; a null language or source
is a value of its own; repeated rows are judged alike; an empty table gives no rows; a
column of the input that bears a result's name gives way to the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, joined, stored, table, text_of

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
HALF = 0.5
#: Fall of the determinant's logarithm under which steps have converged.
FALL = 1e-3
#: Squared Mahalanobis distance beyond which a document goes: one clean normal point in a million.
LIMIT = 36.0
#: Standard deviations added to the covariance, by statistic.
FLOORS = (0.1, 0.03, 0.01, 0.12, 0.12)
P = len(FLOORS)
#: Steps of each statistic in one.
STEPS = (1 << 10, 1 << 10, 1 << 14, 1 << 14, 1 << 14)
#: Steps of start scatters, and of the logarithm of a distance.
FINE, NEAR = 1 << 28, 1 << 12
#: Points that an estimate needs.
MIN_GROUP = 10 * P
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _windows(words: Column) -> Column:
    """Hash and place of every 3-word window, sorted."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    grams = F.zip_with(pairs, F.slice(words, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0))), lambda ab, c: F.xxhash64(ab["a"], ab["b"], c))
    whole = F.slice(grams, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    return F.sort_array(F.transform(whole, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))


def measured(docs: DataFrame) -> DataFrame:
    """The six base statistics of each row; other columns pass through."""
    df = docs.drop(*STATS).withColumn("_text", text_of(docs))
    kept = [c for c in df.columns if c != "_text"]
    df = df.withColumn("_words", F.filter(F.split("_text", SPACE + "+"), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.translate(x, BLANK, "") != ""))
    df = df.withColumn("_grams", _windows(F.col("_words")))
    hash_at = lambda i: F.get(F.col("_grams"), i)["g"]
    df = df.withColumn("_found", F.filter("_grams", lambda x, i: x["g"].eqNullSafe(hash_at(i - 1)) | x["g"].eqNullSafe(hash_at(i + 1))))
    return df.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten(F.transform("_found", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _points(df: DataFrame) -> DataFrame:
    """_q{k}, the statistics in whole steps, and _x{k}, their values."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    x = (F.log(words), F.log(chars / words), F.col("n_symbols") / chars, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words)
    df = df.withColumns({f"_q{k}": F.floor(v * STEPS[k] + 0.5) for k, v in enumerate(x)})
    return df.withColumns({f"_x{k}": F.col(f"_q{k}") / STEPS[k] for k in range(P)})


def _gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    for n in range(1, 500):
        term *= x / (a + n)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def consistency(p: int = P, half: float = HALF) -> float:
    """What makes the covariance of the inner half that of a whole normal sample."""
    low, high = 0.0, 100.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(p / 2, mid / 2) < half else (low, mid)
    return half / _gamma_p(p / 2 + 1, low / 2)


def _number(v: float) -> str:
    """A double of SQL."""
    return f"{v!r}D"


def _cholesky(df: DataFrame) -> DataFrame:
    """_l{i}{j} of the lower factor of _c{i}{j}."""
    cells = []
    for i, j in PAIRS:
        v = " - ".join([f"_c{i}{j}", *(f"_l{i}{k} * _l{j}{k}" for k in range(j))])
        cells.append(f"sqrt(greatest({v}, 1e-12D)) as _l{i}{j}" if i == j else f"({v}) / _l{j}{j} as _l{i}{j}")
    return df.selectExpr("*", *cells)


def _distance(df: DataFrame) -> DataFrame:
    """_d2, the squared Mahalanobis distance of _x{k} to _m{k} under _l{i}{j}."""
    scores = [f"({' - '.join([f'_x{i} - _m{i}', *(f'_l{i}{k} * _z{k}' for k in range(i))])}) / _l{i}{i} as _z{i}" for i in range(P)]
    return df.selectExpr("*", *scores, f"{' + '.join(f'_z{k} * _z{k}' for k in range(P))} as _d2")


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _starts(points: DataFrame, keys: list[str], spark: SparkSession, total: int) -> DataFrame:
    """Mean, Cholesky factor and number of points (_n) of each start (_start) for each group of at least MIN_GROUP points."""
    medians = points.groupBy(*keys).agg(F.count("*").alias("_n"), F.count("*").alias("_size"), *(F.percentile(f"_q{k}", F.lit(0.5)).alias(f"_h{k}") for k in range(P)))
    medians = stored(medians.filter(F.col("_n") >= MIN_GROUP), spark, "medians")
    apart = joined(points, medians, keys, "_size", total).groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.first("_n").alias("_size"), *(F.first(f"_h{k}").alias(f"_h{k}") for k in range(P)), *(F.sum(F.abs(2 * F.col(f"_q{k}") - F.col(f"_h{k}") * 2).cast("long")).alias(f"_a{k}") for k in range(P))
    )
    spread = apart.selectExpr(
        *keys, "_n", "_size",
        *(f"_h{k} / {STEPS[k]} as _m{k}" for k in range(P)),
        *(f"sqrt(pow({_number(1.2533)} * _a{k} / {2 * STEPS[k]} / _n, 2) + {_number(FLOORS[k] ** 2)}) as _s{k}" for k in range(P)),
    )
    spread = stored(spread, spark, "spread")
    z = joined(points, spread, keys, "_size", total).selectExpr(
        *keys, *(f"(_x{k} - _m{k}) / _s{k} as _z{k}" for k in range(P)),
        f"greatest({' + '.join(f'_z{k} * _z{k}' for k in range(P))}, 1e-12D) as _norm",
        *(f"floor(tanh(_z{k}) * {1 << 14} + 0.5D) as _t{k}" for k in range(P)),
    )
    scatter = z.groupBy(*keys).agg(
        *(F.expr(f"sum(_t{k}) as _t{k}") for k in range(P)),
        *(F.expr(f"sum(_t{i} * _t{j}) as _t{i}{j}") for i, j in PAIRS),
        *(F.expr(f"sum(floor(_z{i} * _z{j} / _norm * {FINE} + 0.5D)) as _u{i}{j}") for i, j in PAIRS),
    )
    known = stored(scatter.join(spread, keys), spark, "scatter")
    kinds = (
        {p: _number(float(p[0] == p[1])) for p in PAIRS},
        {(i, j): f"(_t{i}{j} / _n - _t{i} / _n * (_t{j} / _n)) / {1 << 28}" for i, j in PAIRS},
        {(i, j): f"{P} * _u{i}{j} / {FINE} / _n" for i, j in PAIRS},
    )
    sized = lambda v, i, j: f"{v} * _s{i} * _s{j}" + (f" + {_number(FLOORS[i] ** 2)}" if i == j else "")
    starts = None
    for k, kind in enumerate(kinds):
        one = _cholesky(known.selectExpr("*", *(f"{sized(v, i, j)} as _c{i}{j}" for (i, j), v in kind.items()))).select(*keys, F.lit(k).alias("_start"), *_fields(), F.lit(1e9).alias("_det"), "_n")
        starts = one if starts is None else starts.unionByName(one)
    return stored(starts, spark, "starts")


def _stepped(points: DataFrame, moving: DataFrame, keys: list[str], spark: SparkSession, total: int, groups: int) -> DataFrame:
    """One concentration step of all starts; _was is the determinant before."""
    at = [*keys, "_start"]
    # a group's starts travel in one row, so each point is met once
    packed = moving.groupBy(*keys).agg(F.first("_n").alias("_size"), F.sort_array(F.collect_list(F.struct("_start", *_fields(), "_det", "_n"))).alias("_each"))
    near = joined(points, packed, keys, "_size", total, n_found=groups).select(*keys, F.explode("_each").alias("_of"), *(f"_{c}{k}" for c in "qx" for k in range(P))).select("*", "_of.*").drop("_of")
    near = _distance(near).withColumn("_near", F.floor(F.log1p("_d2") * NEAR)).select(*at, "_det", "_n", "_near", *(f"_q{k}" for k in range(P)))
    inner = stored(near.groupBy(*at).agg(F.first("_n").alias("_size"), F.percentile("_near", F.lit(HALF)).alias("_limit")), spark, "inner")
    held = joined(near, inner, at, "_size", total, n_found=3 * groups).filter(F.col("_near") <= F.col("_limit"))
    sums = held.groupBy(*at).agg(
        F.first("_det").alias("_was"), F.first("_n").alias("_n"), F.count("*").alias("_h"),
        *(F.expr(f"sum(_q{k}) as _a{k}") for k in range(P)), *(F.expr(f"sum(_q{i} * _q{j}) as _a{i}{j}") for i, j in PAIRS),
    )
    scale = _number(consistency())
    cov = lambda i, j: f"{scale} * (_a{i}{j} / _h / {STEPS[i] * STEPS[j]} - _m{i} * _m{j})" + (f" + {_number(FLOORS[i] ** 2)}" if i == j else "")
    fresh = sums.selectExpr("*", *(f"_a{k} / _h / {STEPS[k]} as _m{k}" for k in range(P)), *(f"{cov(i, j)} as _c{i}{j}" for i, j in PAIRS))
    fresh = _cholesky(fresh).selectExpr("*", f"2 * ({' + '.join(f'ln(_l{k}{k})' for k in range(P))}) as _det")
    return stored(fresh.select(*at, *_fields(), "_det", "_n", "_was"), spark, "step")


def _estimate(points: DataFrame, keys: list[str], spark: SparkSession) -> DataFrame:
    """Mean, Cholesky factor, log determinant (_det) and points (_n) of each group of at least MIN_GROUP points, the least of all starts."""
    total = points.count()
    moving, seen = _starts(points, keys, spark, total), None
    groups = moving.count() // 3
    while not moving.isEmpty():
        fresh = _stepped(points, moving, keys, spark, total, groups)
        seen = fresh.drop("_was") if seen is None else seen.unionByName(fresh.drop("_was"))
        # each round lowers a determinant by a fixed part, and the floors bound it from below
        moving = fresh.filter(F.col("_det") < F.col("_was") - FALL).drop("_was")
    if seen is None:
        return moving.drop("_start")
    best = seen.groupBy(*keys).agg(F.min_by(F.struct(*_fields(), "_det", "_n"), F.struct("_det", "_start")).alias("_best"))
    return stored(best.select(*keys, "_best.*"), spark, "estimate")


def _fields() -> list[str]:
    return [*(f"_m{k}" for k in range(P)), *(f"_l{i}{j}" for i in range(P) for j in range(i + 1))]


def _keyed() -> tuple[Column, Column, Column]:
    """Keys of the estimates over all documents, over a language, over a language and source."""
    return F.lit("0"), F.concat(F.lit("1"), F.col("_lang")), F.concat(F.lit("2"), F.length("_lang").cast("string"), F.col("_lang"), F.col("_source"))


def assess(docs: DataFrame, spark: SparkSession, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns unless given) with the base statistics, base_failed, distance2 and kept."""
    names = docs.columns if carry is None else carry
    told = docs.select(F.col("text"), F.struct(*names).alias("_row"), *(F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit("-")).alias(f"_{c}") for c in ("lang", "source")))
    rows = stored(measured(told).drop("text"), spark, "measured")
    points = _points(rows.filter(~base_failed())).select("_lang", "_source", *(f"_{c}{k}" for c in "qx" for k in range(P)))
    counts = stored(points.groupBy("_lang", "_source").agg(F.count("*").alias("_n2")), spark, "counts")
    counts = counts.join(counts.groupBy("_lang").agg(F.sum("_n2").alias("_n1")), "_lang").crossJoin(F.broadcast(counts.agg(F.sum("_n2").alias("_n0"))))
    # the language's estimate where a group has none, that of all documents where the language has none
    level = lambda of: F.when(F.col("_n2") >= MIN_GROUP, of(2)).when(F.col("_n1") >= MIN_GROUP, of(1)).when(F.col("_n0") >= MIN_GROUP, of(0))
    counts = counts.withColumns({"_key": level(lambda k: _keyed()[k]), "_size": level(lambda k: F.col(f"_n{k}"))}).filter("_key is not null")
    told = stored(counts.select("_lang", "_source", "_key", "_size", F.col("_n2").alias("_points")), spark, "groups")
    needed = stored(told.select("_key", "_size").distinct(), spark, "needed")
    apart = points.withColumn("_key", F.explode(F.array(*_keyed())))
    total = counts.agg(F.sum("_n2")).first()[0] or 0
    found = _estimate(stored(joined(apart, needed, ["_key"], "_size", total), spark, "points"), ["_key"], spark)
    estimates = stored(told.join(found.select("_key", *_fields()), "_key").drop("_key", "_size"), spark, "estimates")
    judged = _distance(joined(_points(rows), estimates, ["_lang", "_source"], "_points", total, "left"))
    failed = base_failed()
    return judged.select(
        *(F.col("_row")[c].alias(c) for c in names if c not in STATS and c not in ("base_failed", "distance2", "kept")),
        *STATS,
        failed.alias("base_failed"),
        F.when(~failed, F.col("_d2")).alias("distance2"),
        (~failed & (F.col("_d2").isNull() | (F.col("_d2") <= LIMIT))).alias("kept"),
    )


def keep_good(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    whole = docs.select(*(c for c in ("lang", "source", "text")), F.struct(*docs.columns).alias("whole"))
    return assess(whole, spark, ["whole"]).filter("kept").select("whole.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict for every document."""
    return assess(table(spark, sf_dir, "documents"), spark, ["doc_id", "lang", "source"])
