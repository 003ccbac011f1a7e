"""Toxicity: a learned lexicon in a trie, Levenshtein automata, and context windows.

Training, on labelled rows alone (at most ``SAMPLE`` of them, by least hash of doc_id; one
of each group of near copies):
words and word beginnings that stand far more often in toxic than in clean documents become
the lexicon. A word scores by the longest lexicon entry that it is or begins with. Words
that are no entry are intersected, as Levenshtein automata of distance 1, with the trie of
the lexicon's whole terms; a misspelling counts as its term unless clean training documents
hold it too. Each hit has a window of ``REACH`` words: inside quotation marks, or after a
word of speech, it counts less, by a factor learned from the sample with a prior of one
half; next to a word of address it counts more. A logistic regression over the sums of a
document turns them into the score.

Labels, lang, source and doc_id are no inputs of a score: the lexicon is one for all texts.

Defined cases: null and empty texts get the score of no hits; repeated rows score alike; an
empty or one-sided label table gives the share of toxic labels (0 without any) as every
score; an empty documents table gives no rows; columns of the input pass through
``scored`` unless they bear a result's name, which wins.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_of

#: Labelled rows to learn from, at most.
SAMPLE = 20_000
#: Entries of the lexicon, at most, and documents that an entry needs.
ENTRIES, SUPPORT = 2_000, 6
#: Least ratio of an entry's shares of toxic and of clean documents.
LIFT = 4.0
STEMS = (4, 5, 6, 7, 8)
REACH = 6
# Common words of speech and of address in the corpus languages.
SPEECH = frozenset("said says say wrote writes called calls quote quoted dit disait écrit sagte sagt schrieb dijo dice escribió".split())
ADDRESS = frozenset("you your youre tu toi vous votre du dich dein ihr usted tú eres".split())
QUOTES = "\"“”„«»"
#: Marks that end a quotation, by its first mark, and first marks that end none.
CLOSES = {'"': '"', "“": "”", "”": "”", "„": "“”", "«": "»", "»": "«"}
DIRECTED = "“„«"
N_FEATURES = 6


def _words(text: str):
    import re

    return re.findall(r"\w+", text.lower())


def _term_counts(batches):
    """Documents, toxic and clean, that hold each word (=word) and word beginning (^stem)."""
    import pyarrow as pa

    seen: dict[str, list[int]] = {}
    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = set(_words(text or ""))
            for unit in {"=" + w for w in words} | {"^" + w[:k] for w in words for k in STEMS if len(w) >= k}:
                seen.setdefault(unit, [0, 0])[0 if toxic else 1] += 1
    rows = list(seen.items())
    for at in range(0, len(rows), 50_000):
        part = rows[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in part], pa.string()), pa.array([c[0] for _, c in part], pa.int64()), pa.array([c[1] for _, c in part], pa.int64())], ["unit", "tox", "cln"])


class Trie:
    """Children by character; ``term`` at the end of an entry."""

    __slots__ = ("next", "term")

    def __init__(self, terms=()):
        self.next, self.term = {}, None
        for t in terms:
            node = self
            for c in t:
                node = node.next.setdefault(c, Trie())
            node.term = t

    def near(self, word: str) -> str | None:
        """The least term within one insertion, deletion, substitution or transposition of a word.

        States of the word's Levenshtein automaton, (place, errors), walk the trie."""
        n, found = len(word), None
        todo = [(self, 0, 0)]
        while todo:
            node, at, errors = todo.pop()
            if node.term is not None and (n - at) + errors <= 1 and (found is None or node.term < found):
                found = node.term
            if at < n and word[at] in node.next:
                todo.append((node.next[word[at]], at + 1, errors))
            if not errors:
                for c, child in node.next.items():
                    todo.append((child, at, 1))
                    if at < n and c != word[at]:
                        todo.append((child, at + 1, 1))
                    if at + 1 < n and c == word[at + 1] and word[at] in child.next:
                        todo.append((child.next[word[at]], at + 2, 1))
                if at < n:
                    todo.append((node, at + 1, 1))
        return found


class Scorer:
    """Finds a document's hits and sums them up; keeps what it learned about words seen."""

    #: Word forms whose verdicts are kept at once.
    KEPT = 300_000

    def __init__(self, model: dict):
        self.terms, self.stems, self.known = model["terms"], model["stems"], set(model["innocent"])
        self.trie = Trie(t for t in self.terms if len(t) >= 4)
        # a swap across the middle of an even length changes both halves
        self.heads = {t[: len(t) // 2] for t in self.terms} | {t[: len(t) // 2 - 1] + t[len(t) // 2] for t in self.terms if len(t) % 2 == 0}
        self.tails = {t[-(len(t) // 2) :] for t in self.terms}
        self.cuts = sorted({len(h) for h in self.heads} | {len(t) for t in self.tails})
        self.quoted = model["quoted"]
        self.seen: dict[str, tuple | None] = {}

    def _verdict(self, w: str):
        """(weight, kind): kind 0 a term, 1 a misspelling, 2 a beginning; None for no hit."""
        if w in self.terms:
            return (self.terms[w], 0, w)
        # any other edit leaves a term's first or second half as it is
        if len(w) >= 3 and w not in self.known and any(w[:k] in self.heads or w[-k:] in self.tails for k in self.cuts) and (t := self.trie.near(w)):
            return (self.terms[t], 1, t)
        for k in reversed(STEMS):
            if len(w) >= k and (s := w[:k]) in self.stems:
                return (self.stems[s], 2, s)
        return None

    def hits(self, text: str):
        """(place, word, weight, kind, entry) of each hit, and the words."""
        words = _words(text)
        seen = self.seen
        if len(seen) > self.KEPT:
            seen.clear()
        out = []
        for at, w in enumerate(words):
            try:
                v = seen[w]
            except KeyError:
                v = seen[w] = self._verdict(w)
            if v is not None:
                out.append((at, w, *v))
        return out, words

    def context(self, text: str, words, found):
        """For each hit: inside quotation or after speech, and next to address."""
        import re

        # all places are those of the lowered text, which may be longer than the text
        text, spans, mark, open_at = text.lower(), [], None, 0
        if any(q in text for q in QUOTES):
            # a quotation ends at the mark that matches its first; one that could end as well as begin ends with its paragraph
            for m in re.finditer(rf"[{QUOTES}]|\n[^\S\n]*\n", text):
                if m[0] not in CLOSES:
                    mark = mark if mark in DIRECTED else None
                elif mark is None:
                    mark, open_at = m[0], m.start()
                elif m[0] in CLOSES[mark]:
                    spans.append((open_at, m.start()))
                    mark = None
        starts = [m.start() for m in re.finditer(r"\w+", text)] if spans else []
        out = []
        for at, *_ in found:
            near = words[max(0, at - REACH) : at + REACH + 1]
            before = words[max(0, at - REACH) : at]
            inside = any(a < starts[at] < b for a, b in spans) if starts else False
            out.append((inside or any(w in SPEECH for w in before), any(w in ADDRESS for w in near)))
        return out

    def features(self, text: str) -> list[float]:
        found, words = self.hits(text)
        told = self.context(text, words, found) if found else []
        n = max(len(words), 1)
        strong = stems = fuzzy = 0.0
        entries = set()
        for (_, _, weight, kind, entry), (quoted, addressed) in zip(found, told, strict=True):
            v = weight * (self.quoted if quoted else 1.0) * (1.5 if addressed else 1.0)
            if kind == 2:
                stems += v
            else:
                strong += v * (0.8 if kind else 1.0)
                fuzzy += kind
                entries.add(entry)
        return [math.log1p(strong), math.log1p(100 * strong / n), math.log1p(stems), math.log1p(100 * stems / n), float(min(len(entries), 5)), math.log1p(n) / 10]


def _fold(model):
    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model)
        for b in batches:
            rows = [scorer.features(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(N_FEATURES))], ["toxic", *(f"x{k}" for k in range(N_FEATURES))])

    return run


def _forms(model):
    """Misspellings in the sample by clean documents, and quoted hits by label."""

    def run(batches):
        import pyarrow as pa

        scorer, rows = Scorer(model), []
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                found, words = scorer.hits(text or "")
                if not toxic:
                    rows += [("~" + w, 1) for w in {h[1] for h in found if h[3] == 1}]
                told = scorer.context(text or "", words, found) if found else []
                for h, (quoted, _) in zip(found, told, strict=True):
                    if h[3] != 2:
                        rows.append((("quoted" if quoted else "plain") + str(int(bool(toxic))), 1))
        for at in range(0, len(rows), 50_000):
            part = rows[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int64())], ["what", "n"])

    return run


def _solved(h, g):
    """x with h x = g, by Gaussian elimination: a few rows."""
    import numpy as np

    a = np.hstack([h, g[:, None]])
    for k in range(len(g)):
        p = k + int(np.abs(a[k:, k]).argmax())
        a[[k, p]] = a[[p, k]]
        a[k] /= a[k, k]
        for r in range(len(g)):
            if r != k:
                a[r] = a[r] - a[r, k] * a[k]
    return a[:, -1]


def _logistic(x, y, ridge: float = 1.0, steps: int = 100):
    """Weights (intercept first) of a ridge logistic regression: Newton steps, halved while they do not help."""
    import numpy as np

    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    penalty = np.r_[1e-6, np.full(x.shape[1], ridge)]

    def value(w):
        t = (z * w).sum(axis=1)
        return float((y * t - np.logaddexp(0, t)).sum() - (penalty * w * w).sum() / 2)

    w, best = np.zeros(z.shape[1]), None
    best = value(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip((z * w).sum(axis=1), -40, 40)))
        g = (z * (y - p)[:, None]).sum(axis=0) - penalty * w
        v = p * (1 - p)
        h = np.array([[(z[:, i] * z[:, j] * v).sum() for j in range(len(w))] for i in range(len(w))]) + np.diag(penalty)
        step, t = _solved(h, g), 1.0
        while t > 1e-4 and value(w + t * step) <= best:
            t /= 2
        if t <= 1e-4:
            break
        w = w + t * step
        gain, best = value(w) - best, value(w)
        if gain < 1e-9 * max(1.0, abs(best)):
            break
    inner = w[1:] / scale
    return [float(w[0] - (inner * mean).sum()), *map(float, inner)]


def _families(batches):
    """Two least hashes of each text's word quadruples: near copies mostly share one."""
    import pyarrow as pa
    import xxhash

    for b in batches:
        found = []
        for text in b.column("text").to_pylist():
            w = _words(text or "")
            grams = {" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))}
            found.append(tuple(min(xxhash.xxh3_64_intdigest(g, seed=s) for g in grams) - (1 << 63) for s in (1, 2)))
        yield pa.RecordBatch.from_arrays([b.column("text"), b.column("toxic"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["text", "toxic", "a", "b"])


def one_of_family(rows: DataFrame) -> DataFrame:
    """One labelled row of each group of near copies, which would pass for evidence otherwise."""
    for key in ("a", "b"):
        rows = rows.groupBy(key).agg(F.min_by(F.struct("text", "toxic", *(c for c in ("a", "b") if c != key)), F.xxhash64("text")).alias("r")).select("r.*", key)
    return rows.select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, spark: SparkSession, held_out=None, sample: int = SAMPLE) -> dict:
    """The model, as plain values. ``held_out``: Column over doc_id of rows not to learn from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    if held_out is not None:
        known = known.filter(~held_out)
    # bounded: ``sample`` rows of two numbers
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    labelled = texts.join(F.broadcast(stored(chosen, spark, "chosen")), "doc_id").select("text", "toxic")
    rows = stored(one_of_family(labelled.mapInArrow(_families, "text string, toxic int, a long, b long")), spark, "labelled")
    total = {r["toxic"] > 0: r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_tox, n_cln = total.get(True, 0), total.get(False, 0)
    model = {"terms": {}, "stems": {}, "innocent": [], "quoted": 0.5, "weights": None, "share": n_tox / max(1, n_tox + n_cln)}
    if not n_tox or not n_cln:
        return model
    rows = rows.repartition(max(8, min(64, (n_tox + n_cln) // 300)))
    counts = rows.mapInArrow(_term_counts, "unit string, tox long, cln long").groupBy("unit").agg(F.sum("tox").alias("tox"), F.sum("cln").alias("cln"))
    lift = (F.col("tox") / n_tox) / ((F.col("cln") + 0.5) / n_cln)
    need = max(SUPPORT, n_tox // 100)
    best = counts.filter((F.col("tox") >= need) & (lift >= LIFT)).withColumn("lift", lift).orderBy(F.desc(F.col("tox") * F.log("lift")), "unit").limit(ENTRIES).collect()
    for r in best:
        kind, unit, weight = r["unit"][0], r["unit"][1:], math.log(r["lift"])
        if kind == "=" and r["lift"] >= 20 and r["tox"] >= need and len(unit) >= 3:
            model["terms"][unit] = weight
        elif kind == "^" and not any(unit[:k] in model["stems"] and model["stems"][unit[:k]] >= weight for k in STEMS if k < len(unit)):
            model["stems"][unit] = weight
    told = {r["what"]: r["n"] for r in rows.mapInArrow(_forms(model), "what string, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()}  # forms in at most ``sample`` rows
    model["innocent"] = sorted(w[1:] for w in told if w[0] == "~")
    quoted = (told.get("quoted1", 0) + 1) / (told.get("quoted0", 0) + told.get("quoted1", 0) + 2)
    plain = (told.get("plain1", 0) + 1) / (told.get("plain0", 0) + told.get("plain1", 0) + 1)
    model["quoted"] = max(0.0, min(1.0, quoted / plain))
    import numpy as np

    got = rows.mapInArrow(_fold(model), "toxic int, " + ", ".join(f"x{k} double" for k in range(N_FEATURES))).collect()  # at most ``sample`` rows of numbers
    model["weights"] = _logistic(np.array([[r[f"x{k}"] for k in range(N_FEATURES)] for r in got]), np.array([float(r["toxic"] > 0) for r in got]))
    return model


def score_of(features: list[float], model: dict) -> float:
    if model["weights"] is None:
        return model["share"]
    w = model["weights"]
    z = w[0] + sum(a * b for a, b in zip(w[1:], features, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _score(model, names):
    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model)
        for b in batches:
            scores = [score_of(scorer.features(t or ""), model) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(scores, pa.float64())], [*names, "score"])

    return run


def scored(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """The documents' columns (or ``keep``) with ``score`` and ``predicted``."""
    docs = docs.drop("score", "predicted")
    names = docs.columns if keep is None else keep
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    source = docs if "text" in names else docs.select(*names, "text")
    out = source.mapInArrow(_score(model, names), f"{fields + ', ' if fields else ''}score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out_column():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def drop_toxic(docs: DataFrame, spark: SparkSession, labels: DataFrame) -> DataFrame:
    """The documents that score under one half."""
    names = docs.columns
    model = train(docs, labels, spark, held_out_column())
    kept = scored(docs.select("text", F.struct(*names).alias("_row")), model).filter("predicted = 0")
    return kept.select("_row.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), spark, held_out_column())
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")), model, ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out_column(), F.lit(False)).alias("held_out"), "score", "predicted")
