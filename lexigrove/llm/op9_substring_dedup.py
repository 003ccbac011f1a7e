"""Substring dedup by relative Lempel-Ziv parsing against reference blocks of the whole corpus.

The corpus is its own reference. Equal windows of ``WINDOW`` words have an equal seed: the
16-word sequence of least hash in them. A *piece* is a maximal run of windows with one seed,
and the reference is kept in blocks by seed, so whatever a piece can share with any text of
the corpus lies in one reference block. Three passes over the dealt texts:

1. Seeds. Blocks of documents exchange their seeds' hashes and learn which stand elsewhere,
   and which are *crowded*: held by over ``CROWD`` blocks of documents.
2. Factors. Each block of documents sends its distinct pieces with such a seed, as word
   hashes, to the seed's reference block. There all pieces are indexed by a suffix array
   over word ids; each piece is factored greedily from its first word, a factor being the
   longest match with any other place of the reference. A factor of ``WINDOW`` words or more
   is a duplicate span, and so is each window across a factor's end that matches whole, for
   the greedy parse may cut a passage that stands elsewhere uncut.
3. Spans. The blocks get one bit for each window back; the words of such windows go.

A crowded seed (one at the rim of a passage that everybody quotes, in ever other company)
would fill a reference block. Its windows are longer anchors themselves, so they are told
by the hashes of all their words, spread over all blocks. The results are the same.

Words are told by 64-bit hashes; all windows of all texts take part, and each is judged on
the input. Pieces are sent once for each block of documents, so copies meet in small number.

Defined cases: null text has no words; empty tables give no rows; repeated rows are
documents of their own, so all their windows repeat; documents of under 35 words lose
nothing; a very long text is one document of its block, and its pieces are as short as any;
of equal passages all go, none is preferred; extra columns pass through ``without_repeats``
whatever their names, and do not matter elsewhere.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .common import table

WINDOW = 35
SEED = 16
#: Blocks of documents beyond which a seed is crowded.
CROWD = 1024
#: Reference blocks for each block of documents: pieces overlap, and a suffix array takes ten times its words.
REFERENCES = 4
SENT = "block int, span int, keys binary"
PIECES = "block int, span int, keys binary, words binary, runs binary, twice binary"


def _words(texts, window: int):
    """Words of each text, flat hashes, first word of each text, and which windows are whole."""
    import numpy as np

    look = B.WordHashes().__getitem__
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(look, w), np.uint64, len(w)) for w in words)])
    edge = np.zeros(len(flat) + 1, np.int32)
    long = sizes >= window
    np.add.at(edge, starts[:-1][long], 1)
    np.add.at(edge, starts[1:][long] - window + 1, -1)
    return words, flat, starts, np.cumsum(edge[:-1]) > 0


def _seeds(flat, whole, window: int, seed: int):
    """The least seed hash of each whole window (0 elsewhere), and the hashes at all seeds' places."""
    import numpy as np

    grams = B.rolling(flat, seed) | np.uint64(1)
    width = window - seed + 1
    least = np.where(whole, B.sliding(grams, width, np.minimum), np.uint64(0))
    # a place is a seed if its hash is the least of some whole window over it
    most = B.sliding(least[::-1].copy(), width, np.maximum)[::-1]
    return least, grams[(most == grams)]


def _counted(keys):
    import numpy as np

    return np.unique(keys, return_counts=True)


def _in(sorted_keys, values):
    import numpy as np

    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_keys, values)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == values


def _gathered(starts, sizes):
    """All places of ranges, flat."""
    import numpy as np

    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _pieces(flat, whole, answer, spans, window, seed):
    """A block's pieces with known seeds: (first window, windows, seed) in order of seed and content, and the places of crowded windows.

    Equal pieces follow each other; ``fresh`` marks the first of each."""
    import numpy as np

    least, seeds = _seeds(flat, whole, window, seed)
    keys, counts = _counted(seeds)
    elsewhere, crowded = B.answered(keys, answer, spans), B.answered(keys, answer, spans, "crowded")
    held = keys[((counts > 1) | elsewhere) & ~crowded]
    heads = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])) if len(least) else np.zeros(0, np.int64)
    runs = np.diff(np.append(heads, len(least)))
    many = np.repeat(_in(keys[crowded], least[heads]), runs) & whole if len(heads) else np.zeros(0, bool)
    mine = _in(held, least[heads]) & (whole[heads] if len(heads) else np.zeros(0, bool))
    heads, runs = heads[mine], runs[mine]
    own = least[heads]
    # windows of one seed differ in length or in a hash of all their words
    digest = np.zeros(len(heads), np.uint64)
    if len(heads):
        rolled = B.rolling(flat, window)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.mixed(rolled ^ np.uint64(0x5BD1E995)))])
        first, last = rolled[heads], rolled[heads + runs - 1]
        digest = B.mixed(total[heads + runs] - total[heads] + B.mixed(first) * np.uint64(3) + B.mixed(last) * np.uint64(5) + runs.astype(np.uint64))
    order = np.lexsort((runs, digest, own))
    heads, runs, own, digest = heads[order], runs[order], own[order], digest[order]
    fresh = np.ones(len(heads), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (digest[1:] != digest[:-1])
    return heads, runs, own, fresh, np.flatnonzero(many)


def matched(words, starts, sizes, window: int):
    """The longest match of each place that begins a window with any other such place, in words (0 elsewhere).

    ``words`` has the pieces' word hashes one after another; piece k is ``sizes[k]`` words
    from ``starts[k]`` on. A suffix array over word ids is sorted by doubling to twice the
    window or so, more than a match can be long unless a text repeats a few words over and over;
    the neighbours there hold the longest match, whose length the ranks of all widths give. In
    such texts a match of that depth may come out shorter than it is, which splits its factor."""
    import numpy as np

    n = len(words)
    match = np.zeros(n, np.int64)
    room = (np.repeat(starts + sizes, sizes) - np.arange(n)).astype(np.int32)  # words left in the piece
    places = np.flatnonzero(room >= window)
    if len(places) < 2:
        return match
    ranks, width = [np.unique(words, return_inverse=True)[1].reshape(-1).astype(np.int32) + 1], 1
    while width < window:
        now = ranks[-1].astype(np.int64)
        later = np.zeros(n, np.int64)
        later[: n - width] = now[width:]
        later[room <= width] = 0  # a piece's end sorts before all words
        ranks.append(np.unique(now * (int(now.max()) + 1) + later, return_inverse=True)[1].reshape(-1).astype(np.int32) + 1)
        width *= 2
    order = places[np.argsort(ranks[-1][places], kind="stable")]
    left, right = order[:-1], order[1:]
    length = np.zeros(len(left), np.int64)
    for rank in reversed(ranks):
        a, b = np.minimum(left + length, n - 1), np.minimum(right + length, n - 1)
        length += np.where(rank[a] == rank[b], width, 0)
        width //= 2
    length = np.minimum(length, np.minimum(room[left], room[right]))
    np.maximum.at(match, left, length)
    np.maximum.at(match, right, length)
    return match


def factored(words, starts, sizes, twice, window: int = WINDOW):
    """Whether each place of the pieces begins a duplicate window, by greedy factors and a check about their ends.

    ``twice`` marks pieces that stand in their block of documents more than once."""
    import numpy as np

    n = len(words)
    match = matched(words, starts, sizes, window)
    inside, about = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    at, end = starts.copy(), starts + sizes
    while len(at):
        live = at + window <= end
        at, end = at[live], end[live]
        length = np.maximum(match[at], 1)
        after, long = at + length, length >= window
        np.add.at(inside, at[long], 1)
        np.add.at(inside, after[long] - window + 1, -1)
        # windows that begin in the factor's last words lie across its end
        np.add.at(about, np.maximum(after - window + 1, at), 1)
        np.add.at(about, after, -1)
        at = after
    duplicate = (np.cumsum(inside)[:n] > 0) | (np.cumsum(about)[:n] > 0) & (match >= window)
    duplicate[_gathered(starts[twice], sizes[twice])] = True
    return duplicate


def _index(spans, window, seed):
    def run(key, table_):
        _, flat, _, whole = _words(table_.column("text").to_pylist(), window)
        keys, _ = _counted(_seeds(flat, whole, window, seed)[1])
        return B.packets(key[0].as_py(), keys, spans)

    return run


def _send(spans, references, window, seed):
    def run(key, table_, answer):
        import numpy as np
        import pyarrow as pa

        _, flat, _, whole = _words(table_.column("text").to_pylist(), window)
        heads, runs, own, fresh, many = _pieces(flat, whole, answer, spans, window, seed)
        hashes = _counted(B.rolling(flat, window)[many])[0] if len(many) else np.zeros(0, np.uint64)
        firsts = np.flatnonzero(fresh)
        counts = np.diff(np.append(firsts, len(heads)))
        heads, runs, own = heads[firsts], runs[firsts], own[firsts]
        rows = []
        limits = B.bounds(references)
        cuts, keyed = np.append(np.searchsorted(own, limits), len(own)), np.append(np.searchsorted(hashes, limits), len(hashes))
        for s in range(references):
            a, b, c, d = cuts[s], cuts[s + 1], keyed[s], keyed[s + 1]
            if a < b or c < d:
                words = flat[_gathered(heads[a:b], runs[a:b] + window - 1)]
                rows.append((key[0].as_py(), s, hashes[c:d].tobytes(), words.tobytes(), runs[a:b].astype(np.int32).tobytes(), np.packbits(counts[a:b] > 1).tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({f.split()[0]: pa.array([r[k] for r in rows], kinds[k]) for k, f in enumerate(PIECES.split(", "))})

    return run


def _reference(window):
    """A reference block: all its pieces indexed, each factored; a bit for each window goes back, and one for each crowded window's hash."""

    def run(table_):
        import numpy as np
        import pyarrow as pa

        runs = [np.frombuffer(x, np.int32) for x in table_.column("runs").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(r)).astype(bool) for x, r in zip(table_.column("twice").to_pylist(), runs, strict=True)]
        words = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in table_.column("words"))])
        sizes = np.concatenate([np.zeros(0, np.int64), *runs]).astype(np.int64) + window - 1
        starts = np.cumsum(sizes) - sizes
        duplicate = factored(words, starts, sizes, np.concatenate([np.zeros(0, bool), *flags]), window)
        # of a piece's places, the first ``run`` begin windows
        told, at, bits = duplicate[_gathered(starts, sizes - window + 1)], 0, []
        for r in runs:
            bits.append(np.packbits(told[at : at + int(r.sum())]).tobytes())
            at += int(r.sum())
        keys = B._answer(table_.select(["block", "span", "keys"])).column("bits")
        return pa.table({"block": table_.column("block").cast(pa.int32()), "span": table_.column("span").cast(pa.int32()), "bits": keys, "windows": pa.array(bits, pa.binary())})

    return run


def _spans(spans, references, window, seed, emit):
    def run(key, table_, answers):
        import numpy as np
        import pyarrow.compute as pc

        first, second = (answers.filter(pc.equal(answers.column("pass"), k)) for k in (1, 2))
        words, flat, starts, whole = _words(table_.column("text").to_pylist(), window)
        heads, runs, own, fresh, many = _pieces(flat, whole, first, spans, window, seed)
        gone = np.zeros(len(flat) + window + 1, np.int32)
        firsts = np.flatnonzero(fresh)
        limits = np.append(np.searchsorted(own[firsts], B.bounds(references)), len(firsts))
        length = runs[firsts]
        told = np.zeros(int(length.sum()), bool)
        begins = np.cumsum(length) - length
        for s, bits in zip(second.column("span").to_pylist(), second.column("windows").to_pylist(), strict=True):
            a, b = limits[s], limits[s + 1]
            if a < b:
                m = int(length[a:b].sum())
                told[begins[a] : begins[a] + m] = np.unpackbits(np.frombuffer(bits, np.uint8), count=m).astype(bool)
        kind = np.cumsum(fresh) - 1
        twice = _gathered(heads, runs)[told[_gathered(begins[kind], runs)]] if len(heads) else np.zeros(0, np.int64)
        if len(many):
            hashes = B.rolling(flat, window)[many]
            keys, counts = _counted(hashes)
            twice = np.concatenate([twice, many[_in(keys[(counts > 1) | B.answered(keys, second, references)], hashes)]])
        np.add.at(gone, twice, 1)
        np.add.at(gone, twice + window, -1)
        return emit(table_, words, starts, np.cumsum(gone)[: len(flat)] > 0)

    return run


def _digest(table_, words, starts, gone):
    import numpy as np
    import pyarrow as pa

    n_removed, digests, spans = [], [], []
    for k, w in enumerate(words):
        g = gone[starts[k] : starts[k + 1]]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
        spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
        n_removed.append(int(g.sum()))
        kept = b" ".join(w if not n_removed[-1] else [x for x, out in zip(w, g.tolist(), strict=True) if not out])
        digests.append(hashlib.sha256(kept).hexdigest())
    return pa.table({
        "doc_id": table_.column("doc_id").cast(pa.int64()), "n_words": pa.array([len(w) for w in words], pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
    })


def _texts(names):
    def run(table_, words, starts, gone):
        import pyarrow as pa

        out = []
        for k, (w, text) in enumerate(zip(words, table_.column("text").to_pylist(), strict=True)):
            g = gone[starts[k] : starts[k + 1]]
            out.append(b" ".join(x for x, drop in zip(w, g.tolist(), strict=True) if not drop).decode("utf-8", "surrogatepass") if g.any() else text)
        return pa.table({n: pa.array(out, pa.string()) if n == "text" else table_.column(n) for n in names})

    return run


def _parsed(docs: DataFrame, spark: SparkSession, emit, schema: str, window: int, seed: int, block_bytes: int, crowd: int) -> DataFrame:
    n = B.count_blocks(docs, spark, block_bytes)
    name = B.free_name(docs, "block")
    by_block = B.dealt(docs, n, name).groupBy(name)
    first = B.shared_keys(by_block.applyInArrow(_index(n, window, seed), SENT), crowd)
    m = n * REFERENCES
    sent = by_block.cogroup(first.groupBy("block")).applyInArrow(_send(n, m, window, seed), PIECES)
    second = sent.groupBy("span").applyInArrow(_reference(window), f"{B.ANSWER}, windows binary")
    both = first.withColumns({"windows": F.lit(None).cast("binary"), "pass": F.lit(1)}).unionByName(second.withColumns({"crowded": F.lit(None).cast("binary"), "pass": F.lit(2)}))
    return by_block.cogroup(both.groupBy("block")).applyInArrow(_spans(n, m, window, seed, emit), schema)


def find_repeats(docs: DataFrame, spark: SparkSession, window: int = WINDOW, seed: int = SEED, block_bytes: int = B.BLOCK_BYTES, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of every document; spans count words."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: bigint, length: bigint>>"
    return _parsed(docs.select("doc_id", "text"), spark, _digest, schema, window, seed, block_bytes, crowd)


def without_repeats(docs: DataFrame, spark: SparkSession, window: int = WINDOW, seed: int = SEED, block_bytes: int = B.BLOCK_BYTES, crowd: int = CROWD) -> DataFrame:
    """The documents, with the duplicate spans cut from ``text``; where nothing goes, the text stays as it is."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return _parsed(docs, spark, _texts(docs.columns), schema, window, seed, block_bytes, crowd)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows standing elsewhere cover."""
    return find_repeats(table(spark, sf_dir, "documents"), spark)
