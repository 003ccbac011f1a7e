"""Word vectors by skip-gram with negative sampling, partitions trained apart and averaged.

In each round every task goes over its own rows from the model of the round before: frequent
words are left out at random, windows have random widths, and each pair of a word and a
neighbour is set against ``negative`` words drawn by the 0.75th power of their counts. A task
returns, for blocks of words, its vectors times the pairs it saw of each word; their sums over all
tasks, divided by the pairs, are the next model. Words that no task saw stay.

The model holds every word that stands often enough, two vectors of ``size`` floats each; it goes
through the driver and to each task, so it must fit there (``most`` bounds it, if it is given). Draws depend on the seed, the round and the partition, so a task that is run
again gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a block of the model; pairs of a step.
BLOCK, STEP = 1024, 256


def vocabulary(docs: DataFrame, column: str, least: int = 5, least_of: dict[str, int] | None = None, most: int | None = None) -> list[tuple[str, int]]:
    """(word, count) by falling count: words that stand ``least`` times, those with a prefix of ``least_of`` as often as it says."""
    need = F.lit(least)
    for prefix, n in (least_of or {}).items():
        need = F.when(F.col("word").startswith(prefix), n).otherwise(need)
    counts = docs.select(F.explode(column).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= need)
    ordered = counts.orderBy(F.desc("n"), "word")
    return [(r["word"], r["n"]) for r in (ordered if most is None else ordered.limit(most)).collect()]


def pairs(rows: list[list[int]], window: int, rng):
    """(words, neighbours) within windows of random widths up to ``window``, for rows of word numbers."""
    import numpy as np

    flat = np.array([w for r in rows for w in r], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    width = rng.integers(1, window + 1, len(flat))
    left, right = [], []
    for d in range(1, window + 1):
        same = row[:-d] == row[d:]
        for a, b, reach in ((flat[:-d], flat[d:], width[:-d]), (flat[d:], flat[:-d], width[d:])):
            near = same & (reach >= d)
            left.append(a[near])
            right.append(b[near])
    left, right = np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])
    order = rng.permutation(len(left))
    return left[order], right[order]


def learned(model, left, right, draw, negative: int, rate: float, rng):
    """Gradient steps of a pair of matrices over pairs, in place."""
    import numpy as np

    own, other = model
    for at in range(0, len(left), STEP):
        c, o = left[at : at + STEP], right[at : at + STEP]
        t = np.concatenate([o[:, None], np.searchsorted(draw, rng.random((len(c), negative)))], axis=1)
        label = np.zeros(t.shape)
        label[:, 0] = 1.0
        label[:, 1:] = np.where(t[:, 1:] == o[:, None], np.nan, 0.0)  # a drawn neighbour tells nothing
        v, u = own[c], other[t]
        g = np.nan_to_num(label - 1.0 / (1.0 + np.exp(-np.clip(np.einsum("bd,bkd->bk", v, u), -30, 30)))) * rate
        np.add.at(own, c, np.einsum("bk,bkd->bd", g, u))
        np.add.at(other, t.ravel(), (g[:, :, None] * v[:, None, :]).reshape(-1, v.shape[1]))


def _round(words: list[str], counts: list[int], model, k: int, column: int, window: int, negative: int, sample: float, rate: float, seed: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, k, TaskContext.get().partitionId()])
        number, n = {w: i for i, w in enumerate(words)}, np.array(counts, float)
        share = n / n.sum()
        keep = np.minimum(1.0, np.sqrt(sample / share) + sample / share)
        draw = np.cumsum(n**0.75)
        draw /= draw[-1]
        mine = [m.copy() for m in model]
        seen = [np.zeros(len(words)), np.zeros(len(words))]
        for b in batches:
            rows = [[number[w] for w in r or () if w in number] for r in b.column(column).to_pylist()]
            rows = [[w for w, u in zip(r, rng.random(len(r)).tolist(), strict=True) if u < keep[w]] for r in rows]
            left, right = pairs(rows, window, rng)
            learned(mine, left, right, draw, negative, rate, rng)
            for of, at in zip(seen, (left, right), strict=True):
                of += np.bincount(at, minlength=len(words))
        out = []
        for kind in (0, 1):
            for at in range(0, len(words), BLOCK):
                weight = seen[kind][at : at + BLOCK]
                if weight.any():
                    out.append((kind, at, weight.tobytes(), (mine[kind][at : at + BLOCK] * weight[:, None]).tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["kind", "first", "seen", "sums"])

    return run


def _added(table):
    import numpy as np
    import pyarrow as pa

    seen, sums = (sum(np.frombuffer(x, float) for x in table.column(c).to_pylist()) for c in ("seen", "sums"))
    return pa.table({"kind": table.column("kind")[:1].cast(pa.int32()), "first": table.column("first")[:1].cast(pa.int32()), "seen": pa.array([seen.tobytes()], pa.binary()), "sums": pa.array([sums.tobytes()], pa.binary())})


def skip_gram(docs: DataFrame, size: int = 256, window: int = 8, negative: int = 16, sample: float = 1e-5, least: int = 5, least_of: dict[str, int] | None = None, rounds: int = 5, rate: float = 0.025, seed: int = 1, column: str = "tokens", most: int | None = None) -> DataFrame:
    """(word, vector) learned from arrays of words."""
    import numpy as np

    spark, known = docs.sparkSession, vocabulary(docs, column, least, least_of, most)
    words, counts = [w for w, _ in known], [n for _, n in known]
    rng, rows = np.random.default_rng(seed), docs.select(column)
    model = [(rng.random((len(words), size)) - 0.5) / size, np.zeros((len(words), size))]
    schema = "kind int, first int, seen binary, sums binary"
    for k in range(rounds if words else 0):
        step = rows.mapInArrow(_round(words, counts, model, k, 0, window, negative, sample, rate * (1 - k / (rounds + 1)), seed), schema)
        for r in step.groupBy("kind", "first").applyInArrow(_added, schema).collect():  # the model, in blocks
            seen = np.frombuffer(r["seen"], float)
            at, fresh = r["first"] + np.flatnonzero(seen), np.frombuffer(r["sums"], float).reshape(len(seen), size)
            model[r["kind"]][at] = fresh[seen > 0] / seen[seen > 0][:, None]
    return spark.createDataFrame([(w, v.tolist()) for w, v in zip(words, model[0], strict=True)], "word string, vector array<double>")
