"""SentencePiece segmentations, sampled and lossless.

A text's pieces form a lattice over its characters. Forward filtering sums, for each
place, the weights of all segmentations up to it; backward sampling then draws pieces from
the end, each with its share of those sums, so a whole segmentation is drawn with the share
of its weight in that of all. A piece's weight is ``(1 + merge rank) ** -ALPHA``, its rank in the
vocabulary. No piece holds a character before a space, or a line feed beside another
character, so the lattice falls apart there, and at every other place that no piece crosses:
the stretches of distinct parts are filtered once for a batch, and all their occurrences are
drawn side by side in numpy. A part of over ``LONG`` characters is one stretch of its own: its
sums are filtered place by place over the pieces that end there, in logarithms, and it is drawn
from its end in chunks whose pieces are looked up anew, so its arrays stay small, and a rule
line of a million characters takes seconds.

Draws are hashes of the row key, the stretch's number and the piece's, so the same row gives
the same segmentation in any order, partition or retry. A character that is no piece stands
as its UTF-8 bytes' pieces. Decoding joins the pieces' bytes and drops the first space; it
gives back every text, those with the mark U+2581 included, which counts as no space.

Defined cases: null text counts as empty (no ids); a null key counts as 0; rows with equal
key and text are equal; a very long text is worked on in batches of parts; equal weights are
no ties, for pieces are drawn; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

ALPHA = 1.0
#: Texts' characters that are worked on together, about.
BATCH = 3_000_000
#: Characters of a part beyond which it is worked on alone, and of its chunks.
LONG, CHUNK = 2048, 65_536
OUT = "doc_id long, n_chars long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean"


class Pieces:
    """The vocabulary: pieces by text with plain spaces, their weights, and every id's bytes."""

    def __init__(self, path: str | None = None, alpha: float = ALPHA):
        import numpy as np
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.size, self.ids, self.bytes, self.byte_ids = sp.vocab_size(), {}, [], [0] * 256
        ranks = {}
        for k in range(self.size):
            p = sp.id_to_piece(k)
            if sp.is_byte(k):
                value = int(p[3:5], 16)
                self.byte_ids[value] = k
                self.bytes.append(bytes([value]))
            elif sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
                self.bytes.append(b"")
            else:
                p = p.replace("▁", " ")
                self.bytes.append(p.encode())
                if not ("\n" in p or " " in p.lstrip(" ")):
                    self.ids[p] = k
                    ranks[p] = -sp.get_score(k)
        self.longest = max(map(len, self.ids))
        hashes = {self._hash(p): (k, ranks[p]) for p, k in self.ids.items()}
        self.keys = np.array(sorted(hashes), np.uint64)
        self.values = np.array([hashes[int(h)][0] for h in self.keys], np.int64)
        self.weight = np.array([(2.0 + max(0.0, hashes[int(h)][1])) ** -alpha for h in self.keys])
        # a bit for each top part of a key: nearly all other strings are told apart here
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys >> np.uint64(42)] = True

    BASE = 0x9E3779B97F4A7C15
    SPREAD = 0xFF51AFD7ED558CCD

    def _hash(self, p: str) -> int:
        h = 0
        for c in p:
            h = (h * self.BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return (h * self.SPREAD) & 0xFFFFFFFFFFFFFFFF

    def segment(self, texts: list[str], seeds):
        """Ids of each text; characters that are no piece as ``size`` plus their code point."""
        import re

        import numpy as np

        split = re.compile(r" *[^ \n]+| +|\n").findall
        parts, counts = [], []
        for t in texts:
            p = split(" " + t) if t else []
            parts += p
            counts.append(len(p))
        number = np.arange(len(parts)) - np.repeat(np.cumsum([0, *counts])[:-1], counts)
        seed = seeds[np.repeat(np.arange(len(texts)), counts)] + number.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        drawn, sizes, at = [], [], 0
        while at < len(parts):
            end, held = at, 0
            while end < len(parts) and len(parts[end]) <= LONG and (end == at or held + len(parts[end]) <= BATCH):
                held += len(parts[end])
                end += 1
            if end == at:
                end += 1
                ids = self._drawn_alone(parts[at], seed[at])
                many = np.array([len(ids)])
            else:
                ids, many = self._drawn(parts[at:end], seed[at:end])
            drawn.append(ids)
            sizes.append(many)
            at = end
        ids, ends = np.concatenate([np.zeros(0, np.int64), *drawn]), np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes]))
        cuts = ends[np.cumsum([0, *counts])]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _edges(self, chars, place, span: int):
        """(piece, weight, begins): by length and last character the piece that ends there and its weight, and the least start of a piece there.

        ``place`` tells how many characters of its part stand before each character."""
        import numpy as np

        n = len(chars)
        piece, weight = np.full((span, n), -1, np.int32), np.zeros((span, n), np.float32)
        live, rolled, power, begins = np.arange(n), np.zeros(n, np.uint64), 1, np.arange(n)
        for k in range(span):
            # hash of the k + 1 characters ending here: one more character in front
            inside = place[live] >= k
            live, rolled = live[inside], rolled[inside]
            rolled = rolled + (chars[live - k] + np.uint64(1)) * np.uint64(power)
            power = power * self.BASE & 0xFFFFFFFFFFFFFFFF
            spread = rolled * np.uint64(self.SPREAD)
            hit = np.flatnonzero(self.maybe[spread >> np.uint64(42)])
            at = np.searchsorted(self.keys, spread[hit])
            at[at == len(self.keys)] = 0
            fits = self.keys[at] == spread[hit]
            held = live[hit[fits]]
            piece[k, held], weight[k, held], begins[held] = self.values[at[fits]], self.weight[at[fits]], held - k
        if span:
            alone = piece[0] < 0
            piece[0, alone], weight[0, alone] = self.size + chars[alone].astype(np.int32), 1.0 / (2.0 + self.size)
        return piece, weight, begins

    def _drawn_alone(self, part: str, seed):
        """Ids of the pieces of one long part."""
        import math
        from itertools import pairwise

        import numpy as np

        chars = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n, span = len(chars), self.longest

        def chunk(a, b):
            """Pieces and weights, by length, that end at places a to b."""
            first = max(0, a - span + 1)
            piece, weight, _ = self._edges(chars[first:b], np.arange(b - first), span)
            return piece[:, a - first :], weight[:, a - first :]

        # forward: the logarithm of each place's sum; ``total`` has the last ones by a common scale
        logs, total, scale = np.zeros(n + 1), [1.0], 0.0
        for a in range(0, n, CHUNK):
            b = min(n, a + CHUNK)
            weight = chunk(a, b)[1].T
            at, length = np.nonzero(weight)
            cuts = np.searchsorted(at, np.arange(b - a + 1)).tolist()
            edges = list(zip((-length - 1).tolist(), weight[at, length].astype(float).tolist(), strict=True))
            sums, scales = [], []
            for x, y in pairwise(cuts):
                run = 0.0
                for back, w in edges[x:y]:
                    run += w * total[back]
                if run < 1e-200:
                    total = [t / run for t in total[-span:]]
                    scale += math.log(run)
                    run = 1.0
                total.append(run)
                sums.append(run)
                scales.append(scale)
            total = total[-span:]
            logs[a + 1 : b + 1] = np.log(sums) + scales
        # backward, from the last chunk
        ids, end, step = [], n, 0
        for a in range((n - 1) // CHUNK * CHUNK, -1, -CHUNK):
            b = min(n, a + CHUNK)
            piece, weight = chunk(a, b)
            before = np.arange(a + 1, b + 1)[:, None] - np.arange(1, span + 1)
            share = np.where(before >= 0, weight.T * np.exp(logs[np.maximum(before, 0)] - logs[a + 1 : b + 1, None]), 0.0)
            below = np.cumsum(share, axis=1)
            below /= below[:, -1:]
            numbers = np.arange(step, step + b - a, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
            draws = ((_mixed(seed + numbers) >> np.uint64(11)).astype(float) / (1 << 53)).tolist()
            first = step
            while end > a:
                row = below[end - 1 - a]
                k = int(row.searchsorted(draws[step - first], side="right"))
                ids.append(int(piece[k, end - 1 - a]))
                end -= k + 1
                step += 1
        return np.array(ids[::-1], np.int64)

    def _drawn(self, parts: list[str], seeds):
        """Ids of the pieces of all parts, in order, and their number in each part."""
        import numpy as np

        index: dict[str, int] = {}
        occurrence = np.fromiter((index.setdefault(p, len(index)) for p in parts), np.int64, len(parts))
        distinct = list(index)
        lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
        base = np.concatenate([[0], np.cumsum(lengths)])
        chars = np.frombuffer("".join(distinct).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(chars)
        word = np.repeat(np.arange(len(distinct)), lengths)
        span = min(self.longest, int(lengths.max()) if len(lengths) else 0)
        piece, weight, begins = self._edges(chars, np.arange(n) - base[word], span)
        # stretches: from each place that no piece crosses to the next
        heads = np.flatnonzero(np.minimum.accumulate(begins[::-1])[::-1] == np.arange(n))
        stretches = np.diff(np.append(heads, n))
        firsts = np.searchsorted(heads, base)  # of each distinct part, and the end
        # forward filtering, all stretches side by side: the sum up to a place, edge by edge
        below = np.zeros((span, n), np.float32)
        total = np.ones(n)  # of each place, in units of its part's scale there
        order = np.argsort(-stretches, kind="stable")
        active, first = stretches[order], heads[order]
        for j in range(int(active[0]) if len(active) else 0):
            at = first[: int(np.searchsorted(-active, -j, side="left"))] + j
            sums = np.zeros((min(span, j + 1), len(at)))
            for k in range(len(sums)):
                sums[k] = weight[k, at] * (total[at - k - 1] if k < j else 1.0)
                if k:
                    sums[k] += sums[k - 1]
            run = sums[-1]
            below[: len(sums), at] = sums / run
            total[at] = run
            if j >= span and j % 8 == 0:
                # only ratios matter: scale the last ``span`` places of long parts alike
                scale = run.copy()
                for k in range(span):
                    total[at - k] /= scale
        # backward sampling, all occurrences side by side
        many = np.diff(firsts)[occurrence]
        ends = np.cumsum(many)
        turn = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)  # of the stretch in its part
        unit = np.repeat(firsts[occurrence], many) + turn
        seed = np.repeat(seeds, many) + turn.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        left, who, step, drawn = stretches[unit], np.arange(len(unit)), 0, []
        while len(who):
            at = heads[unit[who]] + left[who] - 1
            u = (_mixed(seed[who] + np.uint64(step * 0x8CB92BA72F3D8DD7 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(float) / (1 << 53)
            k, open_, r = np.zeros(len(at), np.int64), np.arange(len(at)), u.astype(np.float32)
            for length in range(span - 1):
                open_ = open_[r[open_] >= below[length, at[open_]]]
                if not len(open_):
                    break
                k[open_] = length + 1
            # rounding may end on an edge that is not there: the longest before it that is
            for i in np.flatnonzero(weight[k, at] <= 0):
                k[i] = int(np.flatnonzero(weight[:, at[i]] > 0)[-1])
            drawn.append((who, np.full(len(who), step, np.int32), piece[k, at]))
            left[who] -= k + 1
            who = who[left[who] > 0]
            step += 1
        if not drawn:
            return np.zeros(0, np.int64), np.zeros(len(parts), np.int64)
        who, steps, ids = (np.concatenate(x) for x in zip(*drawn, strict=True))
        # drawn from the end: a stretch's last piece comes first
        number = np.bincount(who, minlength=len(unit))
        after = np.cumsum(number)
        out = np.empty(len(ids), np.int64)
        out[after[who] - 1 - steps] = ids
        totals = np.concatenate([np.zeros(1, np.int64), after])[np.concatenate([np.zeros(1, np.int64), ends])]
        return out, np.diff(totals)

    def expanded(self, ids):
        """With bytes' ids in place of characters that are no piece, and how many these are."""
        import numpy as np

        if not (ids >= self.size).any():
            return ids, 0
        out, n = [], 0
        for k in ids.tolist():
            if k < self.size:
                out.append(k)
            else:
                raw = chr(k - self.size).encode("utf-8", "surrogatepass")
                out += [self.byte_ids[b] for b in raw]
                n += len(raw)
        return np.array(out, np.int64), n

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _encoded(path, alpha, with_ids):
    def run(batches):
        import hashlib
        import zlib

        import numpy as np
        import pyarrow as pa

        pieces = Pieces(path, alpha)
        names = [x.split()[0] for x in OUT.split(", ")]
        kinds = [*[pa.int64()] * 5, pa.string(), pa.bool_()]
        for b in batches:
            keys, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH):
                    size += len(texts[end])
                    end += 1
                seeds = _mixed(np.array([(k or 0) & 0xFFFFFFFFFFFFFFFF for k in keys[at:end]], np.uint64))
                rows, lists = [], []
                for key, text, raw in zip(keys[at:end], texts[at:end], pieces.segment(texts[at:end], seeds), strict=True):
                    ids, n = pieces.expanded(raw)
                    back = pieces.decode(ids)
                    rows.append((key, len(text), len(ids), n, zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
                    if with_ids:
                        lists.append(ids)
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(lists, pa.list_(pa.int64()))] if with_ids else arrays, [*names, "ids"] if with_ids else names)
                at = end

    return run


def encode(docs: DataFrame, path: str | None = None, alpha: float = ALPHA, with_ids: bool = True) -> DataFrame:
    """Sampled ids of each text (array ``ids`` if asked for), what they decode to, and counts."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return source.mapInArrow(_encoded(path, alpha, with_ids), OUT + (", ids array<bigint>" if with_ids else ""))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentation of every document, decoded again."""
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
