"""SimHash near duplicates by tiled exact comparison of fingerprints.

A bit of a document's fingerprint is set if it is set in over half of its shingles' hashes.
Fingerprints link at ``radius`` or fewer differing bits, and all pairs of different
fingerprints are covered, without an index that could miss one:

1. Prints. Tasks hash whole texts a slice of shingles at a time. Equal fingerprints are one
   row from here on, however many documents have them.
2. Tiles. A fingerprint's tile is its population count and, where more than ``TILE`` share
   that, a part of it by hash. Two fingerprints whose population counts differ beyond the
   radius cannot link, so only pairs of tiles within it are made, each once. A pair is a task's
   unit of work: two arrays of fingerprints.
3. Comparison. Within a pair, both tiles are halved at the median of the byte whose population
   counts spread most, down to ``PART`` fingerprints. Two parts are skipped if their boxes of
   the eight bytes' population counts lie farther apart than the radius (differing bits are at
   least the sum of the bytes' differences); all others are compared whole, by exclusive-or
   and bit counts in numpy. A pair returns a spanning forest of its links, so n fingerprints
   that all link give n - 1 rows there, not n * n / 2.

Components of the forests' edges are the documents' classes. Tiles grow with the number of
fingerprints between two bounds (64 kB to 1 MB), so that each goes to some 64 others and a
task's memory stays bounded. The work is that of an exact comparison: it grows with the square
of the number of different fingerprints, less what the boxes skip (README).

Defined cases: null and empty texts have fingerprint zero, and link as any other; fewer words
than a shingle are one shingle; a bit in exactly half of the hashes is not set; repeated rows
are rows of their own with one fingerprint; a null doc_id links, but is no component's least
one unless alone; an empty table gives no rows; a very long text is hashed in slices; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined, slices, stored, table
from .components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a tile, at least and at most; between them, one part in 64 of all.
TILE, TILES = (8192, 131_072), 64
#: Fingerprints of a part that is compared whole.
PART = 256
#: Shingles hashed at once.
HASHED = 65_536
PRINTS = "doc_id long, print long"


def bit_votes(hashes, starts):
    """For each run of hashes, how many have each bit (lowest first)."""
    import numpy as np

    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprints(texts: list[bytes | None], size: int = SHINGLE):
    """The fingerprint of each text, as uint64."""
    import numpy as np
    from xxhash import xxh64_intdigest

    votes, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes, owners, starts = [], [], []

    def count():
        if hashes:
            np.add.at(votes, owners, bit_votes(np.array(hashes, np.uint64), starts))
        for held in (hashes, owners, starts):
            held.clear()

    for k, text in enumerate(texts):
        words = (text or b"").lower().split()
        n = max(1, len(words) - size + 1) if words else 0
        totals[k] = n
        joint = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        firsts = np.concatenate([[0], ends[:-1] + 1])
        del words
        for at in range(0, n, HASHED):
            upto = min(n, at + HASHED)
            lasts = ends[at + size - 1 : upto + size - 1] if n > 1 or len(ends) == size else ends[-1:]
            owners.append(k)
            starts.append(len(hashes))
            hashes += [xxh64_intdigest(joint[a:b], SEED) for a, b in zip(firsts[at:upto].tolist(), lasts.tolist(), strict=True)]
            if len(hashes) >= HASHED:
                count()
    count()
    return np.packbits(2 * votes > totals[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _prints(size: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in slices(batches, "text"):
            prints = fingerprints(b.column("text").to_pylist(), size)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64), pa.int64())], ["doc_id", "print"])

    return run


def halved(prints, part: int = PART):
    """(prints, ends, low, high): the prints in parts of at most so many, and the parts' boxes of the bytes' population counts."""
    import numpy as np

    counts = np.bitwise_count(prints.view(np.uint8).reshape(-1, 8)).astype(np.int8)
    todo, parts = [np.arange(len(prints))], []
    while todo:
        at = todo.pop()
        if len(at) <= part:
            parts.append(at)
            continue
        spread = counts[at].std(axis=0)
        half = len(at) // 2
        order = at[counts[at, int(spread.argmax())].argpartition(half)]
        todo += [order[half:], order[:half]]
    order = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    ends = np.cumsum([len(p) for p in parts])
    low = np.array([counts[p].min(axis=0) for p in parts], np.int8).reshape(-1, 8)
    high = np.array([counts[p].max(axis=0) for p in parts], np.int8).reshape(-1, 8)
    return prints[order], ends, low, high


class Forest:
    """Union by array: keeps of many links those that join two trees."""

    def __init__(self, n: int):
        import numpy as np

        self.root, self.edges = np.arange(n), []

    def tops(self, at):
        import numpy as np

        top = self.root[at]
        while not np.array_equal(top, up := self.root[top]):
            top = up
        self.root[at] = top
        return top

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    def join(self, i, j) -> None:
        """``i`` and ``j``: arrays of linked places."""
        import numpy as np

        a, b = self.tops(i), self.tops(j)
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return
        # one link for each pair of trees
        _, first = np.unique(np.minimum(a, b)[apart] * len(self.root) + np.maximum(a, b)[apart], return_index=True)
        for k in apart[first].tolist():
            x, y = self.find(i[k]), self.find(j[k])
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.edges.append((int(i[k]), int(j[k])))


def linked(left, right, radius: int = RADIUS, part: int = PART):
    """Edges (uint64, uint64) that connect what links between two tiles (within one, if ``right`` is None)."""
    import numpy as np

    a, a_ends, a_low, a_high = halved(left, part)
    b, b_ends, b_low, b_high = (a, a_ends, a_low, a_high) if right is None else halved(right, part)
    shift = 0 if right is None else len(a)
    forest = Forest(len(a) + (0 if right is None else len(b)))
    for x, end in enumerate(a_ends.tolist()):
        start = int(a_ends[x - 1]) if x else 0
        apart = np.maximum(0, np.maximum(b_low - a_high[x], a_low[x] - b_high)).sum(axis=1)
        own = a[start:end, None]
        for y in np.flatnonzero(apart <= radius).tolist():
            if right is None and y < x:
                continue
            first = int(b_ends[y - 1]) if y else 0
            i, j = np.nonzero(np.bitwise_count(own ^ b[None, first : b_ends[y]]) <= radius)
            i, j = i + start, j + first + shift
            if right is None:
                i, j = i[i < j], j[i < j]
            if len(i):
                forest.join(i, j)
    every = a if right is None else np.concatenate([a, b])
    return every[[i for i, _ in forest.edges]], every[[j for _, j in forest.edges]]


def _compared(radius: int, part: int):
    def run(rows):
        import numpy as np
        import pyarrow as pa

        rows = rows.sort_by("side")
        tiles = [np.ascontiguousarray(v.values.to_numpy()).view(np.uint64) for v in rows.column("prints")]
        u, v = linked(tiles[0], tiles[1] if len(tiles) > 1 else None, radius, part)
        return pa.table({"u": pa.array(u.view(np.int64), pa.int64()), "v": pa.array(v.view(np.int64), pa.int64())})

    return run


def link_edges(prints: DataFrame, spark: SparkSession, radius: int = RADIUS, tile: tuple[int, int] = TILE, part: int = PART) -> DataFrame:
    """(u, v): edges that connect all fingerprints (column ``print``, distinct) within the radius."""
    prints = prints.withColumn("ones", F.bit_count("print").cast("int"))
    many = {r["ones"]: r["n"] for r in prints.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # at most 65 rows
    size = min(max(tile[0], sum(many.values()) // TILES), tile[1])
    parts = F.array(*(F.lit(-(-many.get(ones, 0) // size)) for ones in range(65)))
    dealt = prints.withColumn("part", F.pmod(F.xxhash64("print"), parts[F.col("ones")]).cast("int"))
    tiles = stored(dealt.groupBy("ones", "part").agg(F.collect_list("print").alias("prints")), spark, "tiles")
    near = F.filter(F.sequence(F.col("ones") - radius, F.col("ones") + radius), lambda q: q.between(0, 64))
    ends = F.flatten(F.transform(near, lambda q: F.transform(F.filter(F.sequence(F.lit(0), parts[q]), lambda k: k < parts[q]), lambda k: F.struct(q.alias("ones"), k.alias("part")))))
    own = F.struct("ones", "part")
    met = tiles.select("prints", own.alias("own"), F.explode(ends).alias("other"))
    met = met.select(F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), (F.col("own") > F.col("other")).cast("int").alias("side"), "prints")
    return met.groupBy("first", "second").applyInArrow(_compared(radius, part), "u long, v long")


def fingerprinted(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, print) of every row; ``print`` holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_prints(size), PRINTS)


def with_components(docs: DataFrame, spark: SparkSession, radius: int = RADIUS, size: int = SHINGLE, tile: tuple[int, int] = TILE, part: int = PART) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the least doc_id reachable by links."""
    prints = stored(fingerprinted(docs, size), spark, "prints")
    classes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), spark, "classes")
    edges = stored(link_edges(classes.select("print"), spark, radius, tile, part), spark, "edges")
    roots = components(edges, spark).select(F.col("u").alias("print"), F.col("v").alias("root"))
    rooted = stored(classes.join(roots, "print", "left").select("print", "rep", "copies", F.coalesce("root", "print").alias("root")), spark, "rooted")
    first = stored(rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("size")), spark, "roots")
    named = joined(rooted, first, ["root"], "size", rooted.count()).select("print", "component_id", F.col("copies").alias("size"))
    found = joined(prints, stored(named, spark, "named"), ["print"], "size", prints.count())
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, by four differing bits."""
    return with_components(table(spark, sf_dir, "documents"), spark)
