"""Blocks of documents, and which of their keys other blocks share.

A block is a bounded set of documents, dealt by a hash. ``shared_keys`` finds which 64-bit
keys stand in two or more blocks: each block sends each of its distinct keys once, in one
packet for each range of key values; a range's task answers every packet with a bit for
each key. However many documents share a key, a range receives it at most once a block, so
no key is hot. Ranges and blocks grow in number with the input, not in size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a block, about.
BLOCK_BYTES = 8_000_000
#: Distinct words whose hashes a worker keeps at once.
CACHED_WORDS = 400_000
ANSWER = "block int, span int, bits binary"


class WordHashes(dict):
    """64-bit hash of a word, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def count_blocks(docs: DataFrame, spark: SparkSession, block_bytes: int = BLOCK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(64, total // block_bytes + 1)


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to clash with no column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def dealt(docs: DataFrame, n: int, name: str = "block") -> DataFrame:
    """With a column for the block; ``text`` null becomes empty."""
    return docs.withColumn("text", F.coalesce(F.col("text"), F.lit(""))).withColumn(name, F.pmod(F.xxhash64("doc_id", F.length("text"), F.crc32(F.substring("text", 1, 64).cast("binary"))), F.lit(n)).cast("int"))


def mixed(x):
    """A bijection on uint64 that spreads values over the whole range."""
    import numpy as np

    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(h, k: int):
    """Polynomial hash of every k consecutive values; as long as ``h``, the last k - 1 not meant."""
    import numpy as np

    base, n = 0x9E3779B97F4A7C15, len(h)
    done, out, at, width, part = 0, np.zeros(n, np.uint64), 0, 1, h.astype(np.uint64)

    def later(a, by):
        b = np.zeros(n, np.uint64)
        if by < n:
            b[: n - by] = a[by:]
        return b

    while width <= k:
        if k & width:
            # words at .. at + width follow the ``done`` words that ``out`` covers
            out = out * np.uint64(pow(base, width, 1 << 64)) + later(part, done)
            done += width
        part = part * np.uint64(pow(base, width, 1 << 64)) + later(part, width)
        width *= 2
    return mixed(out)


def sliding(a, k: int, op):
    """op over every k consecutive values, the end filled from what is there."""
    import numpy as np

    out, width = a.copy(), 1
    while width < k:
        step = min(width, k - width)
        if step < len(out):
            out[:-step] = op(out[:-step], out[step:].copy())
        width += step
    return np.ascontiguousarray(out)


def packets(block: int, keys, spans: int):
    """Record batch of a block's sorted distinct keys, cut by range."""
    import numpy as np
    import pyarrow as pa

    cuts = np.searchsorted(keys, bounds(spans))
    ends = [*cuts[1:], len(keys)]
    rows = [(s, keys[a:b].tobytes()) for s, (a, b) in enumerate(zip(cuts, ends, strict=True)) if b > a]
    return pa.table({"block": pa.array([block] * len(rows), pa.int32()), "span": pa.array([s for s, _ in rows], pa.int32()), "keys": pa.array([k for _, k in rows], pa.binary())})


def bounds(spans: int):
    """Least key of each of so many equal ranges."""
    import numpy as np

    return np.arange(spans, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // spans)


def _answer(table, crowd: int = 0):
    import numpy as np
    import pyarrow as pa

    arrays = [np.frombuffer(k.as_buffer(), np.uint64) for k in table.column("keys")]
    everything = np.sort(np.concatenate(arrays)) if arrays else np.zeros(0, np.uint64)
    common = np.unique(everything[1:][everything[1:] == everything[:-1]])
    crowds = np.unique(everything[crowd:][everything[crowd:] == everything[:-crowd]]) if crowd else common[:0]
    columns = {"block": table.column("block").cast(pa.int32()), "span": table.column("span").cast(pa.int32())}
    for name, some in (("bits", common), ("crowded", crowds)):
        bits = []
        for a in arrays:
            hit = np.zeros(len(a), bool)
            if len(some):
                hit[np.searchsorted(a, some[np.isin(some, a, assume_unique=True)])] = True
            bits.append(np.packbits(hit).tobytes())
        columns[name] = pa.array(bits, pa.binary())
    return pa.table(columns if crowd else {k: columns[k] for k in ("block", "span", "bits")})


def shared_keys(sent: DataFrame, crowd: int = 0) -> DataFrame:
    """Answer rows (block, span, bits) for packet rows (block, span, keys).

    With ``crowd``, the column ``crowded`` has a bit for each key that more blocks than that hold."""
    return sent.groupBy("span").applyInArrow(lambda table: _answer(table, crowd), f"{ANSWER}, crowded binary" if crowd else ANSWER)


def answered(keys, answer, spans: int, column: str = "bits"):
    """Boolean for each of a block's sorted distinct keys: it stands in another block too (or, for ``crowded``, in many)."""
    import numpy as np

    out = np.zeros(len(keys), bool)
    cuts = [*np.searchsorted(keys, bounds(spans)), len(keys)]
    for s, bits in zip(answer.column("span").to_pylist(), answer.column(column).to_pylist(), strict=True):
        a, b = cuts[s], cuts[s + 1]
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out
