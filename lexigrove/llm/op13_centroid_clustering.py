"""Centroid clustering by the kd-tree filter, exact in integers.

A vector counts if it has exactly ``dim`` components, all finite; each becomes the integer
floor(scale * x). Every task builds kd-trees over blocks of its vectors, once: a node has its
number of vectors, their componentwise sum and their box. The trees are written to the shared
folder, and each round reads them there:

* A node starts with its parent's centroids. The one nearest to the box's middle is the rival
  of all others; another one is strictly dominated, and leaves, if even the box's corner that
  suits it best is nearer to the rival.
* A node with one centroid left goes to it whole, by its count and sum.
* Leaves with several are resolved vector by vector, by exact distances to those left.

A centroid that ties with the rival somewhere in the box stays, so ties go to the smaller
number exactly as they do for each vector by itself. A task returns a count and a sum for each
centroid and component, so a round sends k * dim rows a task through one aggregation, and k *
dim numbers to the driver, whatever the input. No vector moves: copies, however many, stay in
their blocks, where nodes of equal vectors are not split and mostly go whole.

Defined cases: null, short, long and partly null or non-finite vectors are left out, and so
are those with a component of 2 ** 20 or more in magnitude, for squared distances would leave
the range of a long; repeated rows are vectors of their own, and rows that tie by hash as
first centroids are taken in order of their components; a null vec_id never starts a
centroid; of fewer vectors than k each is a centroid; an empty table gives no rows; a sum of
distances that leaves the range of a long is null; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

K, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
#: Vectors of a tree, and of a leaf.
BLOCK, LEAF = 4096, 32
#: Components from here on have no squared distance in a long.
TOO_LARGE = 1 << 20
TREES = "ids array<bigint>, points binary, spans array<int>, kids array<int>, low binary, high binary, sums binary"
ASSIGNED = "vec_id long, cluster int, distance long"


@dataclass
class Tree:
    """A kd-tree over a block's vectors, nodes in breadth-first order; a node holds the vectors from its first to its last place."""

    points: Any
    #: First place and end of each node, and its left child (the right one follows), or -1.
    spans: Any
    kids: Any
    low: Any
    high: Any
    sums: Any


def grown(points, leaf: int = LEAF):
    """(order, tree): nodes are halved at the median of their widest component."""
    import numpy as np

    order, spans, kids, low, high, sums = np.arange(len(points)), [(0, len(points))], [], [], [], []
    while len(kids) < len(spans):
        a, b = spans[len(kids)]
        own = points[order[a:b]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        sums.append(own.sum(axis=0, dtype=np.int64))
        widest = int((high[-1] - low[-1]).argmax())
        if b - a > leaf and high[-1][widest] > low[-1][widest]:
            half = (b - a) // 2
            order[a:b] = order[a:b][own[:, widest].argpartition(half)]
            kids.append(len(spans))
            spans += [(a, a + half), (a + half, b)]
        else:
            kids.append(-1)
    return order, Tree(points[order], np.array(spans), np.array(kids), np.array(low), np.array(high), np.array(sums))


def squared(points, centroids):
    """Exact squared distances of all pairs."""
    import numpy as np

    reach = max(int(abs(points).max(initial=0)), int(abs(centroids).max(initial=0)))
    # below 2 ** 21, all sums of 64 products are whole numbers that a double holds
    kind = np.float64 if reach < 1 << 21 and points.shape[1] <= 64 else np.int64
    p, c = points.astype(kind), centroids.astype(kind)
    return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def filtered(tree: Tree, centroids):
    """(whole, leaves): pairs of nodes and the centroid that takes them whole, and pairs of leaves and the centroids left there."""
    import numpy as np

    nodes, left = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    whole, leaves = [], []
    while len(nodes):
        low, high = tree.low[nodes], tree.high[nodes]
        gap = ((2 * centroids - (low + high)[:, None, :]) ** 2).sum(axis=2)
        rival = centroids[np.where(left, gap, np.iinfo(np.int64).max).argmin(axis=1)][:, None, :]
        away = centroids - rival
        corner = np.where(away > 0, high[:, None, :], low[:, None, :])
        # how much farther the corner is from the centroid than from its rival
        left = left & ((away * (centroids + rival - 2 * corner)).sum(axis=2) <= 0)
        alone, ends = left.sum(axis=1) == 1, tree.kids[nodes] < 0
        whole += zip(nodes[alone].tolist(), left[alone].argmax(axis=1).tolist(), strict=True)
        leaves += zip(nodes[ends & ~alone].tolist(), left[ends & ~alone], strict=True)
        down = ~alone & ~ends
        kids = tree.kids[nodes[down]]
        nodes, left = np.concatenate([kids, kids + 1]), np.concatenate([left[down], left[down]])
    return whole, leaves


def resolved(tree: Tree, leaves, centroids):
    """(places, clusters) of the vectors of leaves with several centroids."""
    import numpy as np

    if not leaves:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = tree.spans[[node for node, _ in leaves]]
    sizes = spans[:, 1] - spans[:, 0]
    at = np.concatenate([np.arange(a, b) for a, b in spans])
    left = np.repeat(np.stack([own for _, own in leaves]), sizes, axis=0)
    return at, np.where(left, squared(tree.points[at], centroids), np.iinfo(np.int64).max).argmin(axis=1)


def _trees(dim: int, scale: int, block: int, leaf: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def row(ids, points):
            order, tree = grown(points, leaf)
            least = next(t for t in (np.int8, np.int16, np.int32) if abs(points).max(initial=0) <= np.iinfo(t).max)
            values = ([ids[k] for k in order.tolist()], tree.points.astype(least).tobytes(), tree.spans.ravel().tolist(), tree.kids.tolist(), tree.low.tobytes(), tree.high.tobytes(), tree.sums.tobytes())
            kinds = (pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
            names = ("ids", "points", "spans", "kids", "low", "high", "sums")
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], list(names))

        ids, parts, held = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, block):
                some = b.slice(at, block)
                column = some.column("vec")
                x = column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)
                ids += some.column("vec_id").to_pylist()
                parts.append(np.floor(scale * x).astype(np.int64))
                held += len(x)
                if held >= block:
                    every = np.concatenate(parts)
                    yield row(ids[:block], every[:block])
                    ids, parts, held = ids[block:], [every[block:]], held - block
        if held:
            yield row(ids, np.concatenate(parts))

    return run


def _read(batches, dim: int):
    import numpy as np

    for b in batches:
        for k in range(b.num_rows):
            r = {name: b.column(name)[k] for name in b.schema.names}
            ids, raw = r["ids"].values, r["points"].as_buffer()
            kind = {1: np.int8, 2: np.int16, 4: np.int32}[len(raw) // (len(ids) * dim)]
            low, high, sums = (np.frombuffer(r[n].as_buffer(), np.int64).reshape(-1, dim) for n in ("low", "high", "sums"))
            yield ids, Tree(np.frombuffer(raw, kind).reshape(-1, dim).astype(np.int64), r["spans"].values.to_numpy().reshape(-1, 2), r["kids"].values.to_numpy(), low, high, sums)


def _sums(centers, dim: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = np.array(centers, np.int64).reshape(-1, dim)
        counts, sums = np.zeros(len(c), np.int64), np.zeros((len(c), dim), np.int64)
        for _, tree in _read(batches, dim):
            whole, leaves = filtered(tree, c)
            for node, z in whole:
                counts[z] += tree.spans[node, 1] - tree.spans[node, 0]
                sums[z] += tree.sums[node]
            at, own = resolved(tree, leaves, c)
            for z in np.unique(own).tolist():
                mine = tree.points[at[own == z]]
                counts[z] += len(mine)
                sums[z] += mine.sum(axis=0)
        rows = [(z, axis, int(counts[z]), int(sums[z, axis])) for z in np.flatnonzero(counts).tolist() for axis in range(dim)]
        kinds = {"cluster": pa.int32(), "axis": pa.int32(), "n": pa.int64(), "total": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))

    return run


def _nearest(centers, dim: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = np.array(centers, np.int64).reshape(-1, dim)
        for ids, tree in _read(batches, dim):
            own = np.zeros(len(ids), np.int64)
            whole, leaves = filtered(tree, c)
            for node, z in whole:
                own[tree.spans[node, 0] : tree.spans[node, 1]] = z
            at, z = resolved(tree, leaves, c)
            own[at] = z
            away = ((tree.points - c[own]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array(away, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def kept_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec) of the vectors that count."""
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    limit = float(TOO_LARGE * DIM / scale)
    return named.filter((F.size("vec") == dim) & F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < limit), F.lit(False))))


def clustered(vectors: DataFrame, spark: SparkSession, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, block: int = BLOCK, leaf: int = LEAF) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector that counts, and the final centroids (k times dim numbers)."""
    kept = kept_vectors(vectors, dim, scale)
    whole = F.transform("vec", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    first = kept.filter("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), whole.alias("z"))
    centers = [list(r["z"]) for r in first.orderBy("h", "z").limit(k).collect()]
    trees = stored(kept.mapInArrow(_trees(dim, scale, block, leaf), TREES), spark, "trees")
    for _ in range(rounds if centers else 0):
        sums = trees.mapInArrow(_sums(centers, dim), "cluster int, axis int, n long, total long")
        for r in sums.groupBy("cluster", "axis").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect():
            centers[r["cluster"]][r["axis"]] = int(r["total"]) // r["n"]
    return trees.mapInArrow(_nearest(centers, dim), ASSIGNED), centers


def with_inertia(vectors: DataFrame, spark: SparkSession, **more) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts."""
    found, centers = clustered(vectors, spark, **more)
    found = stored(found, spark, "assigned")
    named = spark.createDataFrame([(z, ",".join(map(str, c))) for z, c in enumerate(centers)], "cluster int, named string")
    by_cluster = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    every = found.agg(F.try_sum("distance").alias("inertia"))
    told = by_cluster.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(every))  # k rows and one
    told = told.select("cluster", "cluster_inertia", "inertia", F.sha2(F.col("named").cast("binary"), 256).alias("centroid_sha256"))
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's cluster after three rounds from 16 hashed starts."""
    return with_inertia(table(spark, sf_dir, "embeddings"), spark)


def _sql() -> str:
    square = "list_sum(list_transform(list_zip(e, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, vec_id, e, c, d FROM (SELECT rid, vec_id, e, c, {square} AS d FROM v, c{r}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)")
        if r < ROUNDS:
            steps.append(f"""s{r} AS (SELECT c, axis, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS axis FROM a{r}) GROUP BY c, axis),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY axis) AS z FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.z, c{r}.z) AS z FROM c{r} LEFT JOIN m{r} USING (c))""")
    return f"""WITH k AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < {TOO_LARGE})) = {DIM}),
v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM k),
f AS (SELECT sha256('{SEED}:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {K}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e AS z FROM f),
{", ".join(steps)}
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)"""


#: The rounds written out, all vectors against all centroids.
ORACLE_SQL = _sql()
