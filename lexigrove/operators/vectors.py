"""Vector lookups, similarity search, signatures, and concepts."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import new_folder

#: Signature words of 64 bits, and the greatest Hamming distance of a match, of all bits.
WORDS, MAX_DISTANCE = 32, 480


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def summed(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: the sum of all vectors, by places in partial aggregates."""
    by_place = vectors.select(F.posexplode(as_doubles(F.col(column))).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    whole = by_place.agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("xs"))  # as many as dimensions
    return whole.select(F.transform("xs", lambda p: p["x"]).alias(column))


def nearest(vectors: DataFrame, query: DataFrame, k: int, similarity=dot) -> DataFrame:
    """(vec_id, score) of the best ``k`` against a one-row query; ties by vec_id."""
    q = query.select(as_doubles(F.col("embedding")).alias("_q")).limit(1)
    told = vectors.crossJoin(F.broadcast(q))  # one row
    return told.select("vec_id", similarity(as_doubles(F.col("embedding")), F.col("_q")).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def sharing_concept(bridge: DataFrame, features: DataFrame) -> DataFrame:
    """Features that share a concept with any of those given, over a bridge (vec_id, concept)."""
    concepts = bridge.join(features.select("vec_id"), "vec_id", "left_semi").select("concept").distinct()
    return bridge.join(concepts, "concept", "left_semi").select("vec_id").distinct()


def planes(dim: int, words: int = WORDS, seed: int = 7) -> list[list[float]]:
    """Normal vectors of the signature's planes, from a seed."""
    rng = random.Random(seed)
    return [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(64 * words)]


def signed(vectors: DataFrame, dim: int, words: int = WORDS, seed: int = 7, column: str = "embedding") -> DataFrame:
    """With ``signature``, an array of longs of the signs of random projections.

    A matrix product for a batch, which built-in expressions would spell out plane by plane."""
    names = vectors.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + ", signature array<bigint>"
    table = planes(dim, words, seed)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        p = np.array(table)
        for b in batches:
            v = np.array(b.column(names.index(column)).to_pylist(), float).reshape(-1, dim)
            bits = np.einsum("id,pd->ip", v, p) >= 0
            packed = np.packbits(bits, axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(packed), pa.list_(pa.int64()))], [*names, "signature"])

    return vectors.mapInArrow(run, schema)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def nearest_signed(vectors: DataFrame, query: DataFrame, k: int, limit: int = MAX_DISTANCE) -> DataFrame:
    """(vec_id, distance) of the best ``k`` signatures within a distance of a one-row query's."""
    q = query.select(F.col("signature").alias("_q")).limit(1)
    told = vectors.crossJoin(F.broadcast(q)).select("vec_id", hamming(F.col("signature"), F.col("_q")).alias("distance"))  # one row
    return told.filter(F.col("distance") <= limit).orderBy("distance", "vec_id").limit(k)


def best_of_probes(told: DataFrame, k: int, shards: int = 64) -> DataFrame:
    """The best ``k`` (probe, vec_id, score) of each probe, ranked in shards of its rows first, so no task ranks all of them."""
    order = W.orderBy(F.desc("score"), "vec_id")
    for own in (["probe", "_shard"], ["probe"]):
        told = told.withColumn("_shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))) if "_shard" in own else told
        told = told.withColumn("_r", F.row_number().over(order.partitionBy(*own))).filter(F.col("_r") <= k).drop("_r")
    return told.drop("_shard")


def nearest_of_probes(vectors: DataFrame, probes: DataFrame, k: int, most: int = 10_000) -> DataFrame:
    """(probe, vec_id, score): for each probe (vec_id, embedding) the best ``k`` of all vectors by cosine; at most ``most`` probes, which go to all executors."""
    if probes.count() > most:
        raise ValueError(f"more than {most} probes at once")
    p = probes.select(F.col("vec_id").alias("probe"), as_doubles(F.col("embedding")).alias("_e"))
    told = vectors.crossJoin(F.broadcast(p)).select("probe", "vec_id", cosine(as_doubles(F.col("embedding")), F.col("_e")).alias("score"))
    return best_of_probes(told, k)


@dataclass
class BandIndex:
    """Vectors by the bands of their signatures, in a folder: written once, read by the bands' keys.

    A band is ``bits`` signs of random projections; its number is the bucket's key. A row has
    the vector with it, so candidates are ranked where they are read. Keys are dealt over folders
    by their value and sorted in their files, so a probe reads the row groups of its keys alone.

    A probe looks, in each band, at the ``looks`` keys that take the least projections to get to
    (multi-probe): bits whose projection is nearest to zero are flipped first. Equal vectors are
    one row (``vec_id`` of the least, ``copies``), so a vector that many rows have fills no bucket."""

    spark: SparkSession
    path: str
    dim: int
    bands: int
    bits: int
    seed: int

    FOLDERS = 16

    @classmethod
    def write(cls, vectors: DataFrame, spark: SparkSession, dim: int, bands: int = 8, bits: int = 8, seed: int = 7, path: str | None = None) -> BandIndex:
        """Index (vec_id, embedding); vectors that are null or of another length are left out."""
        index = cls(spark, path or new_folder(spark, "bands"), dim, bands, bits, seed)
        kept = vectors.filter(F.size("embedding") == dim).select(F.col("vec_id").cast("long").alias("vec_id"), as_doubles(F.col("embedding")).alias("embedding"))
        kept = kept.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).select("vec_id", "copies", "embedding")
        rows = index._keyed(kept, 1).select("band", "key", "vec_id", "copies", "embedding", F.pmod("key", F.lit(cls.FOLDERS)).alias("folder"))
        rows.repartition(bands * cls.FOLDERS, "band", "folder").sortWithinPartitions("band", "folder", "key").write.partitionBy("band", "folder").parquet(index.path)
        return index

    def rows(self) -> DataFrame:
        return self.spark.read.schema("key long, vec_id long, copies long, embedding array<double>, band int, folder int").parquet(self.path)

    def _keyed(self, vectors: DataFrame, looks: int) -> DataFrame:
        """Rows with ``band`` and ``key``, for the first ``looks`` keys of each band."""
        names, dim, bands, bits = vectors.columns, self.dim, self.bands, self.bits
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + ", band int, key long"
        table = [row for row in planes(dim, -(-bands * bits // 64), self.seed)[: bands * bits]]
        at = names.index("embedding")

        def run(batches):
            import numpy as np
            import pyarrow as pa

            p = np.array(table)
            # flips of the few bits of least margin, as subsets of ranks
            near = min(bits, max(1, looks).bit_length() + 3)
            subsets = (np.arange(1 << near)[:, None] >> np.arange(near)) & 1 if looks > 1 else np.zeros((1, near), int)
            for b in batches:
                v = b.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                margin = np.einsum("id,pd->ip", v, p).reshape(len(v), bands, bits)
                own = ((margin >= 0) << np.arange(bits)).sum(axis=2)
                order = np.argsort(abs(margin), axis=2, kind="stable")[:, :, :near]
                cost = np.einsum("ibn,sn->ibs", np.take_along_axis(abs(margin), order, axis=2) ** 2, subsets)
                least = np.argsort(cost, axis=2, kind="stable")[:, :, :looks]
                flips = np.einsum("ibn,sn->ibs", 1 << order, subsets)
                keys = own[:, :, None] ^ np.take_along_axis(flips, least, axis=2)
                n = keys.shape[2]
                rows = np.repeat(np.arange(len(v)), bands * n)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in b.columns), pa.array(np.tile(np.repeat(np.arange(bands), n), len(v)), pa.int32()), pa.array(keys.ravel(), pa.int64())], [*names, "band", "key"])

        return vectors.mapInArrow(run, schema)

    def candidates(self, probes: DataFrame, looks: int, most: int = 10_000) -> DataFrame:
        """(probe, vec_id, copies, embedding, _e): what stands under each probe's keys, a vector as often as it is met; at most ``most`` probes, whose keys go to all executors."""
        if probes.count() > most:
            raise ValueError(f"more than {most} probes at once")
        keys = self._keyed(probes.select(F.col("vec_id").alias("probe"), "embedding"), looks).select("probe", "band", "key", F.pmod("key", F.lit(self.FOLDERS)).cast("int").alias("folder"), F.col("embedding").alias("_e"))
        return self.rows().join(F.broadcast(keys), ["band", "folder", "key"]).select("probe", "vec_id", "copies", "embedding", "_e")

    def nearest(self, probes: DataFrame, k: int, looks: int = 24, least: float = -1.0) -> DataFrame:
        """(probe, vec_id, score, copies): the best ``k`` candidates of each probe by exact cosine, ``least`` or more."""
        score = cosine(as_doubles(F.col("embedding")), as_doubles(F.col("_e")))
        told = self.candidates(probes, looks).select("probe", "vec_id", "copies", score.alias("score")).filter(F.col("score") >= least)
        return best_of_probes(told.groupBy("probe", "vec_id").agg(F.first("score").alias("score"), F.first("copies").alias("copies")), k)

    def share_read(self, probes: DataFrame, looks: int = 24) -> DataFrame:
        """(share): the mean share of the different vectors that a probe looks at."""
        n, n_probes = self.rows().filter("band = 0").count(), probes.count()
        return self.candidates(probes, looks).select("probe", "vec_id").distinct().agg((F.count("*") / (n * n_probes)).alias("share"))


def recall(found: DataFrame, exact: DataFrame, key: list[str] | str = "vec_id") -> DataFrame:
    """(recall): the share of the exact rows that were found."""
    hit = exact.join(found.select(*([key] if isinstance(key, str) else key), F.lit(1).alias("_hit")), key, "left")
    return hit.agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count("*")).alias("recall"))


def word_vectors(sentences: DataFrame, size: int = 256, window: int = 8, least: int = 5, column: str = "tokens", seed: int = 1, tasks: int | None = None):
    """A skip-gram model of token arrays; per-type minima are a filter before.

    So many tasks learn apart, by default one on each core, and what they learned is summed; with one, all text would go through it."""
    from pyspark.ml.feature import Word2Vec

    tasks = tasks or sentences.sparkSession.sparkContext.defaultParallelism
    return Word2Vec(vectorSize=size, windowSize=window, minCount=least, inputCol=column, outputCol="vector", seed=seed, numPartitions=tasks).fit(sentences)


def concepts(vectors: DataFrame, k: int, slack: float = 1.2, seed: int = 1) -> DataFrame:
    """(vec_id, concept): k-means centres; a vector belongs to every centre within ``slack`` times its least distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    fed = vectors.select("vec_id", as_doubles(F.col("embedding")).alias("v"), array_to_vector("embedding").alias("features"))
    centers = [c.tolist() for c in KMeans(k=k, seed=seed).fit(fed).clusterCenters()]  # k rows
    lit = F.array(*(F.array(*map(F.lit, c)) for c in centers))
    far = F.transform(lit, lambda c: F.aggregate(F.zip_with("v", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    told = fed.select("vec_id", far.alias("d"))
    return told.select("vec_id", F.posexplode("d").alias("concept", "distance"), F.array_min("d").alias("least")).filter(F.col("distance") <= slack * slack * F.col("least")).select("vec_id", "concept")
