"""Spelling variants, fingerprints and clusters against brute force, and the odd cases of input."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexigrove.llm import op11_spelling_variants as variants
from lexigrove.llm import op12_simhash as simhash
from lexigrove.llm import op13_centroid_clustering as centroids

SCHEMA = "doc_id long, text string, word string, n long, print long, key long, part int, root string"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, 3, 4, "r") for i, t in rows], SCHEMA)


def read(sf_dir):
    return duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_words(rows, drops=199):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % drops == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def brute_forms(words):
    near = {w: set() for w in words}
    letters = sorted({c for w in words for c in w})
    for w in words:
        for v in {w[:k] + c + w[k + d :] for k in range(len(w) + 1) for c in letters for d in (0, 1)} - {w}:
            if v in near:
                near[w].add(v)
                near[v].add(w)
    form = {w: best for w, own in near.items() if own and words[best := min(own, key=lambda v: (-words[v], v))] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def forms(found):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect())


def test_variants_query(spark, sf_dir):
    got = forms(variants.op11_spelling_variants(spark, sf_dir))
    assert got == brute_forms(brute_words(read(sf_dir))) and any(r[1] for r in got)


VARIED = [
    (1, "Planet planet PLANET planet planet " * 40 + "planes planes planes planes planes " * 2), (2, "plane planets " * 5 + "élanet " * 5), (None, "nothing " * 6), (3, None), (4, ""), (5, "!?"), (6, "plan×et plan÷et " * 5),
    (6, "ÉLANET " * 5), (7, "x" * 2_000_003 + " " + "word" * 3 + " "), (8, "Hotels hotels\thotels\nhotels hotels-hotel hôtels"), (8, "Hotels hotels\thotels\nhotels hotels-hotel hôtels"), (9, "abcdef abcdeg abcdeh abcdxf abczef abydef axcdef " * 5),
]


@pytest.mark.parametrize("hot", [1, 3, 64])
def test_variants_odd(spark, empty, hot):
    docs = documents(spark, VARIED)
    for drops in (199, 2):
        want = brute_forms(brute_words(VARIED, drops))
        assert forms(variants.grouped(variants.counted(docs, drops=drops), spark, hot=hot)) == want and want
    assert variants.grouped(variants.counted(empty), spark).count() == 0


def test_variants_chain_and_ties(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "zzzzzz": 5, "zzzzzx": 30, "zzzzzy": 30, "qqqqqq": 6, "qqqqqqq": 29}
    got = forms(variants.grouped(spark.createDataFrame(list(words.items()), "word string, n long"), spark))
    assert got == brute_forms(words)
    told = {r[0]: r for r in got}
    assert told["aaaaaa"][2] == "aabbbb" and told["zzzzzz"][1] == "zzzzzx" and told["qqqqqq"][1] is None


def test_variants_stretches(monkeypatch):
    monkeypatch.setattr(variants, "STRETCH", 7)
    text = "abcdef ghijklmnopq, short Überall" * 9
    assert variants.runs_of(text.encode()) == Counter(w for w in re.findall("[a-zÀ-ÿ]+", lowered(text)) if len(w) >= 6)
    assert variants.runs_of(b"abcdef\xffghijkl") == Counter(["abcdef", "ghijkl"])


def brute_print(t, size=4):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + size]), seed=42) for k in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, radius):
    root = list(range(len(ids)))
    for _ in ids:
        before = list(root)
        for a in range(len(ids)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= radius:
                    root[a] = root[b] = min(root[a], root[b], key=lambda k: ids[k])
        if root == before:
            break
    return [ids[r] for r in root]


def test_simhash_query(spark, sf_dir):
    rows = read(sf_dir)
    prints = [brute_print(t) for _, t in rows]
    want = sorted((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute_components([i for i, _ in rows], prints, 4), strict=True))
    got = simhash.op12_simhash(spark, sf_dir)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == want and len({r[2] for r in want}) < len(want)


def test_simhash_odd(spark, empty):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(1, base), (2, base.upper()), (2, base.upper()), (3, base.replace("word150", "x")), (4, None), (5, ""), (6, " \n\t"), (7, "two words"), (8, "TWO words"), (9, "two\nWORDS"), (10, " ".join(f"w{i % 977}x{i % 13}" for i in range(150_000))), (11, "a b a b")]
    prints = [brute_print(t) for _, t in rows]
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.with_components(documents(spark, rows), spark).collect())
    assert got == sorted((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute_components([i for i, _ in rows], prints, 4), strict=True))
    assert {c for i, _, c in got if i in (4, 5, 6)} == {4}
    alone = simhash.with_components(documents(spark, [(None, "just this"), (None, "")]), spark).collect()
    assert [r["component_id"] for r in alone] == [None, None]
    assert simhash.with_components(empty, spark).count() == 0


def test_simhash_tiles(spark):
    rng = np.random.default_rng(5)
    heart = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = sorted({int(x) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))) for x in heart for _ in range(30)} | {0, 15, (1 << 64) - 1})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = brute_components(prints, prints, 4)
    for tile in ((10, 50), (100, 100), (5000, 5000)):
        found = {(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.link_edges(spark.createDataFrame([(p,) for p in signed], "print long"), spark, tile=tile, part=8).collect()}
        assert all((u ^ v).bit_count() <= 4 for u, v in found)
        root = {p: p for p in prints}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in found:
            x, y = sorted((find(u), find(v)))
            root[y] = x
        assert [find(p) for p in prints] == want
        # a forest within each pair of tiles, not all links
        if tile[0] == 5000:
            links = sum((a ^ b).bit_count() <= 4 for a in prints for b in prints if a < b)
            assert len(found) < links


def test_simhash_slices(monkeypatch):
    texts = [None, b"a", b"a b c d", b" ".join(b"w%d" % k for k in range(500)), b"", b"x y z"]
    want = [brute_print((t or b"").decode()) for t in texts]
    for hashed in (1, 7, 65_536):
        monkeypatch.setattr(simhash, "HASHED", hashed)
        assert simhash.fingerprints(texts).tolist() == want


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centers = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), z) for z, c in enumerate(centers))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for z in set(own):
            mine = [v for (_, v), y in zip(kept, own, strict=True) if y == z]
            centers[z] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    by = Counter()
    for _, d, z in found:
        by[z] += d
    return sorted(((i, z, d, by[z], sum(by.values()), hashlib.sha256(",".join(map(str, centers[z])).encode()).hexdigest()) for i, d, z in found), key=str)


def clusters(found):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in found.collect()), key=str)


def test_clusters_query(spark, sf_dir):
    got = clusters(centroids.op13_centroid_clustering(spark, sf_dir))
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{sf_dir}/embeddings.parquet'")
    want = con.sql(f"select vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 from ({centroids.ORACLE_SQL})").fetchall()
    assert got == sorted(want, key=str)
    rows = duckdb.sql(f"select vec_id, embedding from '{sf_dir}/embeddings.parquet'").fetchall()
    assert got == brute_clusters(rows)


@pytest.mark.parametrize(("block", "leaf"), [(7, 2), (64, 4), (4096, 32)])
def test_clusters_odd(spark, block, leaf):
    rng = np.random.default_rng(3)
    around = rng.normal(size=(8, 64))
    rows = [(k, (around[k % 8] + rng.normal(size=64) * 0.02).tolist()) for k in range(150)]
    rows += [(1000, rows[0][1])] * 70 + [(2000 + k, [float(k % 3)] * 64) for k in range(40)]  # copies and ties
    rows += [(3000, None), (3001, []), (3002, [1.0] * 63), (3003, [1.0] * 65), (3004, [None] + [1.0] * 63), (3005, [float("nan")] + [1.0] * 63), (3006, [float("inf")] + [1.0] * 63), (None, [0.5] * 64), (3007, [-1e5] + [0.0] * 63)]
    frame = spark.createDataFrame([(i, v, 1, "c", 2, 3) for i, v in rows], "vec_id long, embedding array<double>, cluster int, ids string, n long, distance long")
    assert clusters(centroids.with_inertia(frame, spark, block=block, leaf=leaf)) == brute_clusters(rows)
    assert centroids.with_inertia(frame.limit(0), spark).count() == 0
    few = frame.filter("vec_id < 5")
    assert clusters(centroids.with_inertia(few, spark)) == brute_clusters([r for r in rows if r[0] is not None and r[0] < 5])
    assert centroids.with_inertia(frame.filter("vec_id = 0").withColumn("embedding", F.array_repeat(F.lit(2.0**20), 64)), spark).count() == 0


def test_clusters_prune():
    rng = np.random.default_rng(4)
    hearts = rng.integers(-60, 60, (16, 64))
    points = np.concatenate([h + rng.integers(-2, 3, (200, 64)) for h in hearts])
    _, tree = centroids.grown(points)
    whole, leaves = centroids.filtered(tree, hearts)
    taken = sum(tree.spans[n, 1] - tree.spans[n, 0] for n, _ in whole)
    assert taken > len(points) // 2 and taken + len(centroids.resolved(tree, leaves, hearts)[0]) == len(points)
