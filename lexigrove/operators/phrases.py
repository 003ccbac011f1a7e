"""Phrase dictionaries, their matching, and query analysis."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import stored


#: Share of a dictionary's phrases from which on a word is a stop word there.
STOP = 0.001


def dictionary(names: DataFrame, column: str = "name", stopwords: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """(phrase, words, n, id): names by normalized words, of equal ones the first by ``order`` (the least, if none is given); stop words alone left out."""
    parsed = names.select(F.col(column).alias("name"), T.lower_words(F.col(column)).alias("words"), F.col(order or column).alias("_order")).filter(F.size("words") > 0)
    parsed = parsed.withColumn("phrase", F.array_join("words", "_"))
    if stopwords is not None:
        parsed = parsed.join(stopwords.select(F.col("value").alias("phrase")), "phrase", "left_anti")
    one = parsed.groupBy("phrase").agg(F.min(F.struct("_order", "name"))["name"].alias("id"), F.first("words").alias("words"))
    return one.select("phrase", "words", F.size("words").alias("n"), "id")


def keyed(phrases: DataFrame, stop: float = STOP) -> DataFrame:
    """Phrases with ``key``, the word that they are looked up by, and ``at``, its place in them.

    It is the first one that is no stop word of the dictionary, or the rarest one there."""
    each = phrases.select("phrase", F.posexplode("words").alias("at", "key"))
    held = each.groupBy("key").agg(F.count_distinct("phrase").alias("held"))
    total = phrases.agg(F.count("*").alias("_total"))
    told = each.join(held, "key").crossJoin(F.broadcast(total))  # one row
    stopped = F.col("held") > F.greatest(F.lit(1.0), F.col("_total") * stop)
    best = told.groupBy("phrase").agg(F.min(F.struct(F.when(stopped, F.col("held")).otherwise(0).alias("cost"), "at", "key")).alias("k"))
    return phrases.join(best, "phrase").select("phrase", "words", "n", "id", "k.key", "k.at")


#: Bits of the filter that word sequences pass before they are joined, and those of a block of it.
FILTER_BITS, BLOCK_BITS = 1 << 26, 1 << 13


def _hash_filter(known: DataFrame) -> dict[int, bytes]:
    """Which of FILTER_BITS values the hashes of a dictionary's phrases begin with, in blocks; 8 MB at most go to the driver and to the tasks."""

    def block(table):
        import numpy as np
        import pyarrow as pa

        held = np.zeros(BLOCK_BITS, bool)
        held[table.column("bit").to_numpy() % BLOCK_BITS] = True
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})

    bits = known.select(F.shiftrightunsigned("hash", 65 - FILTER_BITS.bit_length()).alias("bit")).distinct().withColumn("block", F.floor(F.col("bit") / BLOCK_BITS))
    return {r["block"]: bytes(r["bits"]) for r in bits.groupBy("block").applyInArrow(block, "block long, bits binary").collect()}


def _flat(lists):
    """The words of an array of lists one after another, their hashes, and where each list begins (and the last ends)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    words = lists.flatten()
    starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    told = pc.fill_null(words.cast(pa.string()), "").dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in told.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(told.dictionary))
    return words, each[told.indices.to_numpy()] if len(words) else each, starts


def _sequences(hashes, lengths: list[int]):
    """(n, hashes) for each length: of the n words from each place on, as far as there are so many."""
    import numpy as np

    h, done = np.zeros(len(hashes), np.uint64), 0
    for n in sorted(lengths):
        for k in range(done, min(n, len(hashes))):  # a word more
            h = h[: len(hashes) - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:]
        done = n
        if n > len(hashes):
            return
        x = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        yield n, x ^ (x >> np.uint64(32))


def _hash():
    """The hash of each whole sequence of words, as ``_kept`` makes it."""

    @F.arrow_udf("long")
    def run(lists: pa.Array) -> pa.Array:
        import numpy as np

        _, hashes, starts = _flat(lists)
        sizes, out = np.diff(starts), np.zeros(len(starts) - 1, np.uint64)
        for n, h in _sequences(hashes, np.unique(sizes[sizes > 0]).tolist()):
            own = np.flatnonzero(sizes == n)
            out[own] = h[starts[own]]
        return pa.array(out.view(np.int64))

    return run


def _kept(blocks: dict[int, bytes], lengths: list[int]):
    """The word sequences of given lengths of a document that the filter lets pass, with their places and hashes."""

    @F.arrow_udf("array<struct<pos: int, n: int, hash: long, words: array<string>>>")
    def run(lists: pa.Array) -> pa.Array:
        import numpy as np

        bits, shift = np.zeros(FILTER_BITS // 8, np.uint8), np.uint64(65 - FILTER_BITS.bit_length())
        for k, v in blocks.items():
            bits[k * BLOCK_BITS // 8 : (k + 1) * BLOCK_BITS // 8] = np.frombuffer(v, np.uint8)
        words, hashes, starts = _flat(lists)
        doc = np.repeat(np.arange(len(lists)), np.diff(starts))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for n, h in _sequences(hashes, lengths):
            bit = (h >> shift).astype(np.int64)
            at = np.flatnonzero(bits[bit >> 3] & (128 >> (bit & 7)))
            at = at[at + n <= starts[doc[at] + 1]]  # within its document
            found.append((at, np.full(len(at), n, np.int64), h[at]))
        at, n, h = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((n, at))
        at, n, h = at[order], n[order], h[order]
        ends = np.concatenate([[0], np.cumsum(n)])
        taken = np.arange(ends[-1]) - np.repeat(ends[:-1] - at, n)
        grams = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(taken)).cast(pa.string()))
        rows = pa.StructArray.from_arrays([pa.array(at - starts[doc[at]], pa.int32()), pa.array(n, pa.int32()), pa.array(h.view(np.int64)), grams], ["pos", "n", "hash", "words"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, starts), pa.int32()), rows)

    return run


def matched(docs: DataFrame, phrases: DataFrame, tokens: str = "toks", stop: float = STOP, keep: list[str] | None = None, at: list[str] | None = None) -> DataFrame:
    """(doc_id, pos, n, phrase, id): every place where a dictionary phrase stands.

    At every place, the word sequence of each length that the dictionary has (fetched first) is looked up as
    a whole, so it meets one phrase at most, whatever words the phrases share; ``stop`` is
    of no account. Sequences leave their document only if a filter of the phrases' hashes lets them pass, and
    are then compared by their words. The dictionary is written to the shared folder first, for it is read several times.
    Columns of documents named by ``keep`` go along, and of arrays named by ``at`` the value at the place."""
    known = stored(phrases.select("phrase", "words", "n", "id", _hash()("words").alias("hash")), phrases.sparkSession, "phrases")
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect() if r["n"])
    more = [*(keep or ()), *(at or ())]
    if not lengths:
        return known.limit(0).crossJoin(docs.limit(0).select("doc_id", *more)).select("doc_id", F.lit(0).alias("pos"), "n", "phrase", "id", *(keep or ()), *(F.get(c, F.lit(0)).alias(c) for c in at or ()))
    words = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    placed = docs.select("doc_id", *more, F.explode(_kept(_hash_filter(known), lengths)(words)).alias("_g")).select("doc_id", *(keep or ()), *(F.get(c, F.col("_g.pos")).alias(c) for c in at or ()), "_g.*")
    found = placed.join(known.drop("n"), ["hash", "words"])
    return found.select("doc_id", "pos", "n", "phrase", "id", *more)


def exclusive(found: DataFrame) -> DataFrame:
    """Matches that no longer match covers."""
    w = W.partitionBy("doc_id").orderBy("pos", F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    return found.withColumn("_end", F.max(F.col("pos") + F.col("n")).over(w)).filter(F.col("_end").isNull() | (F.col("_end") < F.col("pos") + F.col("n"))).drop("_end")


def feeder_lexems(names: DataFrame, column: str = "name", lower: bool = True) -> DataFrame:
    """(value, type): the distinct lexems of names, lowered or not, numbers apart from words."""
    read = T.lower_words if lower else T.words
    values = names.select(F.explode(read(F.col(column))).alias("value")).distinct()
    return values.withColumn("type", F.when(F.col("value").rlike("^[0-9]+$"), "number").otherwise("word"))


def rule_names(phrases: DataFrame, prefix: str | None = None) -> DataFrame:
    """A result name for each phrase: its cleaned name, or a prefix and a number from its hash."""
    if prefix is None:
        return phrases.withColumn("rule", T.rule_name(F.col("phrase")))
    return phrases.withColumn("rule", F.concat(F.lit(prefix), F.pmod(F.xxhash64("phrase"), F.lit(1 << 53)).cast("string")))


def words_of(text: str) -> list[str]:
    """A query's words, lowered."""
    import re

    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def query_grams(query: str, longest: int) -> list[str]:
    """Every word sequence of up to so many words within a comma part of a query, as phrases."""
    parts = map(words_of, query.split(","))
    return list(dict.fromkeys("_".join(w[i : i + n]) for w in parts for i in range(len(w)) for n in range(1, min(longest, len(w) - i) + 1)))


def merged(terms: list[dict]) -> list[dict]:
    """What is searched for: phrases of several words at their places, single words wherever no phrase begins."""
    held = {t["pos"]: {"value": t["value"], "length": t["length"]} for t in terms if t["type"] == "vecsfeat" and t["length"] > 1}
    for t in terms:
        if t["type"] == "stem":
            held.setdefault(t["pos"], {"value": t["value"], "length": 1})
    return [held[p] for p in sorted(held)]


def analyzed(query: str, phrases: dict[str, str] | None = None, longest: int | None = None) -> list[dict]:
    """A query's terms: longest dictionary phrases within comma parts, single words elsewhere.

    Phrases are as long as the dictionary's longest, unless ``longest`` sets a bound. Plain
    Python, for a query is a line: [{type, value, length, pos}]."""
    out, pos = [], 0
    longest = longest or max((p.count("_") + 1 for p in phrases or ()), default=1)
    for part in query.split(","):
        words = words_of(part)
        i = 0
        while i < len(words):
            n = next((n for n in range(min(longest, len(words) - i), 0, -1) if "_".join(words[i : i + n]) in (phrases or {})), 0)
            if n:
                out.append({"type": "vecsfeat", "value": phrases["_".join(words[i : i + n])], "length": n, "pos": pos + i})
            else:
                out.append({"type": "selstem", "value": words[i], "length": 1, "pos": pos + i})
            i += max(n, 1)
        out += [{"type": "stem", "value": w, "length": 1, "pos": pos + k} for k, w in enumerate(words)]
        pos += len(words)
    return out


def analyzed_or_words(query: str, analyze) -> list[dict]:
    """A query's terms by an analyzer; single words alone where it fails."""
    try:
        return analyze(query)
    except Exception:
        return [{"type": "stem", "value": w, "length": 1, "pos": k} for k, w in enumerate(words_of(query))]


def analyzed_queries(queries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(qid, type, value, length, pos) for a table of queries (qid, query): as ``analyzed`` for each, by joins.

    Phrases of the dictionary (``dictionary``) within a comma part are of type ``vecsfeat``, longest
    ones; words that none covers are ``selstem``, and all words are ``stem``. Without a
    dictionary there are words alone."""
    parts = F.transform(F.split(F.coalesce("query", F.lit("")), ","), T.lower_words)
    sized = queries.select("qid", parts.alias("parts")).select("qid", F.posexplode("parts").alias("part", "toks"), "parts")
    ahead = F.aggregate(F.slice("parts", F.lit(1), F.col("part")), F.lit(0), lambda n, p: n + F.size(p))
    told = sized.select(F.struct("qid", "part").alias("doc_id"), ahead.alias("ahead"), "toks")
    words = told.select("doc_id", "ahead", F.posexplode("toks").alias("at", "value"))
    row = lambda kind, length, value="value": [F.col("doc_id.qid").alias("qid"), F.lit(kind).alias("type"), F.col(value).alias("value"), length.cast("int").alias("length"), (F.col("ahead") + F.col("at")).alias("pos")]
    stems = words.select(*row("stem", F.lit(1)))
    if known is None:
        return stems
    found = exclusive(matched(told.select("doc_id", "toks"), known)).join(told.select("doc_id", "ahead"), "doc_id").withColumnRenamed("pos", "at")
    covered = found.select("doc_id", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("at"))
    open_ = words.join(covered, ["doc_id", "at"], "left_anti")
    return found.select(*row("vecsfeat", F.col("n"), "id")).unionByName(open_.select(*row("selstem", F.lit(1)))).unionByName(stems)


def vector_refs(terms: list[dict]) -> list[int]:
    """Indexes of feature references: values of F and a number."""
    return [int(t["value"][1:]) for t in terms if t["value"][:1] == "F" and t["value"][1:].isdigit()]


def sentence_weight(classes: list[str], weights: dict[str, float] | None = None) -> float:
    """Mean weight of token classes: verbs and entities 1, nouns 0.9, others 0.8."""
    weights = weights or {"V": 1.0, "E": 1.0, "N": 0.9}
    return sum(weights.get(c, 0.8) for c in classes) / len(classes) if classes else 0.0


# What separates sentences of a query, weights of classes, of a sentence, and the similarity from which on terms are one group.
SENTENCE_SEPARATORS, CLASS_WEIGHTS, SENTENCE_WEIGHT, GROUP_SIMILARITY = '";\n', {"V": 1.0, "E": 1.0, "N": 0.9, "*": 0.8}, 0.5, 0.6


def best_reading(query: str, classes: dict[str, str], weights: dict[str, float] | None = None, longest: int = 6) -> list[dict]:
    """The best reading of each sentence of a query: [{terms: [(term, class)], weight}].

    A sentence is any sequence of terms. A term is a run of words that the dictionary knows, words
    joined by ``_`` where white space and by ``-`` where other signs stand between them, of its
    classes (a string of letters) the one of most weight; any single word is one of class ``*``. A
    reading weighs half of the mean weight of its words, each by its term's class; of equal
    ones the one of fewer terms counts, then the one whose first terms are longer."""
    import re

    weights = weights or CLASS_WEIGHTS
    out = []
    for sentence in re.split(f"[{SENTENCE_SEPARATORS}]", query.lower()):
        found = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W_]+", sentence)]
        if not found:
            continue
        n = len(found)
        glue = ["_" if re.fullmatch(r"[\s_\u00a0\u2000-\u200b\u3000]*", sentence[a[2] : b[1]]) else "-" for a, b in zip(found, found[1:])]
        # best[i]: weight of the words from i on, terms taken, and the reading
        best: list[tuple] = [(0.0, 0, ())] * (n + 1)
        for i in range(n - 1, -1, -1):
            options, term = [], ""
            for j in range(i, min(n, i + longest)):
                term = found[j][0] if j == i else term + glue[j - 1] + found[j][0]
                kinds = [c for c in classes.get(term, "") if c in weights] + (["*"] if j == i else [])
                if kinds:
                    kind = max(kinds, key=lambda c: weights[c])
                    rest = best[j + 1]
                    options.append((rest[0] + weights[kind] * (j + 1 - i), rest[1] + 1, ((term, kind), *rest[2]), j - i))
            # longer first terms win among equals
            w, k, terms, _ = max(options, key=lambda o: (round(o[0], 9), -o[1], o[3]))
            best[i] = (w, k, terms)
        out.append({"terms": list(best[0][2]), "weight": SENTENCE_WEIGHT * best[0][0] / n})
    return out


def grouped_terms(terms: list[str], vectors: dict[str, list[float]], least: float = GROUP_SIMILARITY) -> list[list[str]]:
    """Terms of a query in groups, each with all that are as similar as that to one of it; terms without vectors stand alone."""
    import math

    def cosine(a: str, b: str) -> float:
        x, y = vectors.get(a), vectors.get(b)
        return sum(p * q for p, q in zip(x, y, strict=True)) / (math.hypot(*x) * math.hypot(*y) or 1.0) if x and y else 0.0

    groups: list[list[str]] = []
    for t in terms:
        near = [g for g in groups if any(cosine(t, o) >= least for o in g)]
        groups = [g for g in groups if g not in near] + [[o for g in near for o in g] + [t]]
    return groups
