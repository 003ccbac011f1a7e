"""Spelling variants by an even-partition pigeonhole join.

Words are counted within tasks first, then by word. Two words differ by one edit only if one of
two halves is whole in both: a word of m code points is indexed under its first m // 2 and
under the rest, with m and the half's number. Words of m and of m + 1 code points probe these:
those of m with the same halves, those one longer with the first m // 2 code points and with
what follows one place further on, for the edit has taken or shifted just the other half. What
meets under a key are candidates; they are deduplicated and verified by one edit.

Keys that many words hold (a frequent ending) are not compared within: the half that they leave
open has the edit, so its entries are indexed once more by its own two halves, with the key as
a prefix, until at most ``HOT`` entries are left under a key or one code point is open, where
the alphabet bounds them. No key has a list of all pairs of a hot half, and no link is lost.

A word's form is its near word of most occurrences, if that has ``RATIO`` times its own; forms
are followed to the last by doubling, so their chains take a logarithm of rounds.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one in the
hash; repeated rows are counted as often as they stand; of near words with equal counts the
least in code-point order is the form; a word without near words has null form and form_n, and
is its own root; an empty table gives no rows; a very long text is read in stretches that end
between words, a very long run of letters is one word; only A-Z are lower-cased; bytes that
are no UTF-8 end words; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined, slices, stored, table

LETTERS = "a-zÀ-ÿ"
#: Code points and occurrences of a word, at least; one in so many hashes drops a code point; a form has so many times the occurrences.
SHORTEST, LEAST, DROPS, RATIO = 6, 5, 199, 5
#: Entries of a key that are compared with each other, at most.
HOT = 64
#: Characters of a text read at once; words that a task counts before it hands them on.
STRETCH, HELD = 1_000_000, 200_000
ENTRIES = ("key", "kind", "word", "rest")


def runs_of(text: bytes, shortest: int = SHORTEST):
    """A Counter of the text's maximal runs of letters, lower-cased, of so many code points or more."""
    import re
    from collections import Counter

    # a match of this many letters or more starts where its run does
    runs, other = re.compile(f"[{LETTERS}]{{{shortest},}}"), re.compile(f"[^{LETTERS}]")
    text, found, at = text.lower().decode("utf-8", "replace"), Counter(), 0
    while at < len(text):
        end = other.search(text, at + STRETCH)
        end = end.start() if end else len(text)
        found.update(runs.findall(text, at, end))
        at = end
    return found


def _counts(shortest: int, drops: int):
    def run(batches):
        from collections import defaultdict
        from zlib import crc32

        import pyarrow as pa

        def rows(total):
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        total = defaultdict(int)
        for b in slices(batches, "text"):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                base = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in runs_of(text or b"", shortest).items():
                    h = crc32(word.encode(), base)
                    if h % drops == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) < shortest:
                            continue
                    total[word] += n
            if len(total) > HELD:
                yield rows(total)
                total.clear()
        yield rows(total)

    return run


def counted(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, drops: int = DROPS) -> DataFrame:
    """(word, n) of all words of so many code points and occurrences; one in ``drops`` (document, run) pairs loses a code point by hash."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return raw.mapInArrow(_counts(shortest, drops), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def halves(entries: DataFrame) -> DataFrame:
    """Each entry under both halves of what it leaves open.

    Kind 0 is an indexed word, kind 1 one that is a code point longer than those that it probes."""
    m = F.length("rest") - F.col("kind")
    half = F.floor(m / 2).cast("int")
    behind = half + F.col("kind")  # a longer word's second half stands one place further on
    first = F.struct(F.lit(1).alias("which"), F.substring("rest", F.lit(1), half).alias("whole"), F.substring("rest", half + 1, F.length("rest")).alias("open"))
    second = F.struct(F.lit(2).alias("which"), F.substring("rest", behind + 1, F.length("rest")).alias("whole"), F.substring("rest", F.lit(1), behind).alias("open"))
    both = entries.select("key", "kind", "word", m.alias("m"), F.explode(F.array(first, second)).alias("e"))
    return both.select(F.xxhash64("key", "m", "e.which", "e.whole").alias("key"), "kind", "word", F.col("e.open").alias("rest"))


def near_pairs(words: DataFrame, spark: SparkSession, hot: int = HOT) -> DataFrame:
    """(a, b): all pairs of words one edit apart, each once; ``a`` is not the longer one."""
    kinds = F.explode(F.array(F.lit(0), F.lit(1))).alias("kind")
    entries = stored(halves(words.select(F.lit(0).cast("long").alias("key"), "word", F.col("word").alias("rest"), kinds)), spark, "halves")
    found = None
    while True:
        by_key = entries.groupBy("key").agg(F.sum(1 - F.col("kind")).alias("indexed"), F.count("*").alias("size"), F.max(F.length("rest") - F.col("kind")).alias("open"))
        some = stored(by_key.filter("indexed > 0 and size > 1"), spark, "keys").withColumn("again", (F.col("size") > hot) & (F.col("open") > 1))
        met = stored(joined(entries, some.select("key", "again", "size"), ["key"], "size", entries.count()), spark, "met")
        cold = met.filter(~F.col("again"))
        left = cold.filter("kind = 0").select("key", F.col("word").alias("a"))
        pairs = left.join(cold.select("key", "kind", F.col("word").alias("b")), "key").filter((F.col("kind") == 1) | (F.col("a") < F.col("b"))).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        if met.filter("again").isEmpty():
            return found.distinct().filter(F.levenshtein("a", "b", 1) == 1)
        entries = stored(halves(met.filter("again").select(*ENTRIES)), spark, "halves")


def followed(forms: DataFrame, spark: SparkSession) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, in doubling steps."""
    roots = stored(forms.select("word", F.col("form").alias("root")), spark, "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), spark, "roots")
        roots = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return roots


def grouped(words: DataFrame, spark: SparkSession, ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n), each once."""
    words = stored(words.select("word", "n"), spark, "words")
    pairs = near_pairs(words, spark, hot)
    both = stored(pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"))), spark, "near")
    told = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = told.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    best = words.join(best, "word", "left").withColumn("has", F.coalesce(-F.col("best.order") >= ratio * F.col("n"), F.lit(False)))
    formed = stored(best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best.near")).alias("form"), F.when(F.col("has"), -F.col("best.order")).alias("form_n")), spark, "forms")
    roots = followed(formed.filter("form is not null"), spark)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of all documents with its form and root."""
    return grouped(counted(table(spark, sf_dir, "documents")), spark)
