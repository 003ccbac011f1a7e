"""Edit-aware token counts.

A document's pre-tokens (matches of the vocabulary's pattern) are leaves, kept with their texts
in buckets under a segment tree of character and token sums; there is no other copy of the
text. An edit finds its leaf by descending the sums, goes back over those leaves whose match
could see the edit, and matches anew from there, over the texts of as many leaves as it takes,
until a boundary falls on an old one; the pattern only looks ahead, so all later leaves stand
as they are. Only the new leaves are encoded, and only the sums above their buckets change.
Buckets that have grown fourfold are cut, with the sums over all buckets made anew.

Defined cases: null text counts as empty, with 0 tokens; an edit outside the text is cut to
it; edits of one document apply in order of their places, overlapping ones from the end of
the one before; a very long text is one tree, whose edits touch their own leaves alone; edits at
one place apply in the order given; an empty table gives no rows; repeated rows are counted each; extra columns
are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import table, text_of

#: Leaves of a bucket at first.
BUCKET = 64
#: Characters that are matched beyond an edit at first, and those beyond a match that it may depend on, with some to spare.
ROOM, LOOK = 64, 8
#: Pre-tokens whose counts a worker keeps at once.
KEPT = 400_000
COUNTS = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_leaves long, n_reencoded long, edited_sha256 string"
#: What the registered query edits: addresses, long numbers, and keys, replaced by a mark.
REDACTED = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]*\w|\b\d[\d -]{5,}\d\b|\b(?=\w*\d)[A-Za-z0-9_]{20,}\b")
MARK = "[redacted]"


class LeafCounts(dict):
    """Tokens of a pre-token."""

    def __init__(self, path=None):
        import public_tokenizers
        import regex

        self.encode = encoder(path).encode_ordinary
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def __missing__(self, leaf: str) -> int:
        if len(self) > KEPT:
            self.clear()
        n = self[leaf] = len(self.encode(leaf))
        return n


class TokenTree:
    """Segment tree over buckets of pre-tokens."""

    def __init__(self, text: str, counts: LeafCounts):
        self.counts, self.encoded = counts, 0
        leaves = counts.pattern.findall(text)
        self.n_leaves = len(leaves)
        self.leaves = [leaves[k : k + BUCKET] for k in range(0, len(leaves), BUCKET)] or [[]]
        self.tokens = [[counts[x] for x in part] for part in self.leaves]
        self._grow()

    def _grow(self) -> None:
        """The sums over all buckets."""
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.sums = [0] * (2 * self.width), [0] * (2 * self.width)
        self.chars[self.width : self.width + len(self.leaves)] = [sum(map(len, part)) for part in self.leaves]
        self.sums[self.width : self.width + len(self.tokens)] = map(sum, self.tokens)
        for k in range(self.width - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    def _split(self) -> None:
        """Cut buckets that have grown, and leave out those that are empty."""
        self.leaves = [part[k : k + BUCKET] for part in self.leaves for k in range(0, len(part), BUCKET)] or [[]]
        self.tokens = [part[k : k + BUCKET] for part in self.tokens for k in range(0, len(part), BUCKET)] or [[]]
        self._grow()

    @property
    def text(self) -> str:
        return "".join("".join(part) for part in self.leaves)

    @property
    def sizes(self) -> list[list[int]]:
        """Characters of the leaves, by bucket."""
        return [list(map(len, part)) for part in self.leaves]

    @property
    def length(self) -> int:
        return self.chars[1]

    @property
    def total(self) -> int:
        return self.sums[1]

    def _update(self, bucket: int) -> None:
        k = bucket + self.width
        self.chars[k], self.sums[k] = sum(map(len, self.leaves[bucket])), sum(self.tokens[bucket])
        while k > 1:
            k //= 2
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    def _leaf(self, place: int) -> tuple[int, int, int]:
        """Bucket, index there, and start of the leaf at a place (of the last one at the end)."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if place - start >= self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        b = min(k - self.width, len(self.leaves) - 1)
        i = 0
        while i + 1 < len(self.leaves[b]) and place - start >= len(self.leaves[b][i]):
            start += len(self.leaves[b][i])
            i += 1
        return b, i, start

    def _ahead(self, b: int, i: int, size: int) -> tuple[str, bool]:
        """At least so many characters from a leaf on, in whole leaves, and whether the text ends with them."""
        out, held = [], 0
        while b < len(self.leaves):
            for leaf in self.leaves[b][i:] if i else self.leaves[b]:
                if held >= size:
                    return "".join(out), False
                out.append(leaf)
                held += len(leaf)
            b, i = b + 1, 0
        return "".join(out), True

    def edit(self, start: int, end: int, put: str) -> None:
        """Replace text[start:end]."""
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        if start == end and not put:
            return
        b, i, at = self._leaf(start)
        # leaves that end or look at the edit: the pattern looks up to two characters beyond a match, or four from its start
        while at > 0:
            pb, pi = (b, i - 1) if i else (b - 1, len(self.leaves[b - 1]) - 1)
            while pi < 0:
                pb -= 1
                pi = len(self.leaves[pb]) - 1
            a = at - len(self.leaves[pb][pi])
            if max(at + 2, a + 4) <= start:
                break
            b, i, at = pb, pi, a
        room, put_end, shift = ROOM, start - at + len(put), len(put) - (end - start)
        while (found := self._matched(b, i, at, start, end, put, room, put_end, shift)) is None:
            room *= 4
        new, ob, oi = found
        tokens = [self.counts[x] for x in new]
        self.encoded += len(new)
        gone = 0
        for k in range(b, ob + 1):
            lo, hi = (i if k == b else 0), (oi if k == ob else len(self.leaves[k]))
            gone += hi - lo
            self.leaves[k][lo:hi], self.tokens[k][lo:hi] = (new, tokens) if k == b else ([], [])
            self._update(k)
        self.n_leaves += len(new) - gone
        if len(self.leaves[b]) > 4 * BUCKET:
            self._split()

    def _matched(self, b: int, i: int, at: int, start: int, end: int, put: str, room: int, put_end: int, shift: int):
        """(new leaves, bucket and index of the first old one that stays) over ``room`` characters beyond the edit; None if these are too few."""
        raw, whole = self._ahead(b, i, end - at + room)
        text = raw[: start - at] + put + raw[end - at :]
        sure = len(text) if whole else len(text) - LOOK
        ob, oi, old, new = b, i, at, []
        for m in self.counts.pattern.finditer(text):
            if m.start() >= put_end:
                here = at + m.start() - shift
                while ob < len(self.leaves) and old < here:
                    if oi < len(self.leaves[ob]):
                        old += len(self.leaves[ob][oi])
                        oi += 1
                    else:
                        ob, oi = ob + 1, 0
                if old == here:
                    return new, min(ob, len(self.leaves) - 1), oi if ob < len(self.leaves) else len(self.leaves[-1])
            if m.end() > sure:
                return None
            new.append(m[0])
        return (new, len(self.leaves) - 1, len(self.leaves[-1])) if whole else None


def redactions(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), MARK) for m in REDACTED.finditer(text)]


def apply_edits(tree: TokenTree, edits: list[tuple[int, int, str]]) -> int:
    """Apply edits given in places of the first text; how many."""
    shift = done = 0
    for start, end, put in sorted(edits):
        start, end = max(start, done), max(end, done)
        end = min(end, tree.length - shift)
        start = min(start, end)
        tree.edit(start + shift, end + shift, put)
        shift += len(put) - (end - start)
        done = end
    return len(edits)


def _counts(path):
    def run(batches):
        import hashlib

        import pyarrow as pa

        counts = LeafCounts(path)
        for b in batches:
            given = b.column("edits").to_pylist() if "edits" in b.schema.names else None
            rows = []
            for k, (doc_id, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)):
                tree = TokenTree(text or "", counts)
                before = tree.total
                n = apply_edits(tree, redactions(text or "") if given is None else [(e["start"], e["end"], e["text"] or "") for e in given[k] or []])
                rows.append((doc_id, before, n, tree.total, tree.n_leaves, tree.encoded, hashlib.sha256(tree.text.encode("utf-8", "surrogatepass")).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 6 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in COUNTS.split(", ")])

    return run


def count_with_edits(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts before and after edits: those of a column ``edits`` (array<struct<start, end, text>>), else redactions."""
    extra = ["edits"] if "edits" in docs.columns else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"), *extra).mapInArrow(_counts(path), COUNTS)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after redaction."""
    return count_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
