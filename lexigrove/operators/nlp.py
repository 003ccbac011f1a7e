"""Passes over tagged tokens: classes, entities, references, gender, and sentence filters.

What columns can say stays in columns. The discourse passes depend on the order of a
document's sentences, with weights that decay from one to the next; they are folds over one
document (``discourse``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import is_date
from ..sources.shared import stored
from .phrases import exclusive, matched
from .tagger import roles

# Classes of Penn tags; T! ends a sentence, P! a part.
TAG_CLASSES = {
    "T!": ". ; LS", "P!": "-LRB- -RRB- , : #", "C": "CD", "X": "EX", "N": "FW NN NNS", "A": "JJ JJR JJS RB RBR RBS RP AFX", "M": "MD PDT", "E": "NNP NNPS", "U": "ADD",
    "R": "PRP PRP$", "V": "VB VBD VBG VBN VBP VBZ VVG VHG", "W": "WDT WP WP$ WRB", "": "CC DT IN TO POS HYPH $ S SBAR SBARQ SINV SQ SYM UH '' `` NFP XX _SP",
}
# Genders of pronouns.
PRONOUNS = {"he": "M", "his": "M", "him": "M", "she": "W", "her": "W", "it": "N", "its": "N", "they": "P", "their": "P"}

TOKEN = "doc_id long, sent int, seq int, value string, nlptag string, nlprole string"


def class_of(tag: Column) -> Column:
    """The class letter of a tag; ``?`` for tags outside the list."""
    out = F.lit("?")
    for letter, tags in TAG_CLASSES.items():
        out = F.when(tag.isin(*tags.split()), letter).otherwise(out)
    return F.when(tag.isNull() | (tag == ""), "").otherwise(out)


def gender_of(pronoun: Column) -> Column:
    out = F.lit(None).cast("string")
    for word, g in PRONOUNS.items():
        out = F.when(F.lower(pronoun) == word, g).otherwise(out)
    return out


#: The default tagger, where no model is plugged in: the first form that a word has gives its tag; the second value tells whether it is lowered.
FORMS = (
    (".", False, "^[.!?]$"), (",", False, "^[,;:]$"), ("CD", False, "^[0-9]+(st|nd|rd|th)?$"), ("DT", True, "^(the|a|an|this|that)$"), ("CC", True, "^(and|or|but)$"),
    ("IN", True, "^(of|in|on|for|with|from|by|at|as)$"), ("TO", True, "^to$"), ("PRP", True, f"^({'|'.join(PRONOUNS)}|you|we|i|them|us)$"), ("VBZ", True, "^(is|are|was|were|be|has|have|had)$"),
    ("RB", True, "ly$"), ("VBG", True, "ing$"), ("VBD", True, "ed$"), ("NNP", False, r"^\p{Lu}"),
)


def rule_tags(token: Column) -> Column:
    """Penn-like tags from a word's form alone."""
    out, low = F.lit("NN"), F.lower(token)
    for tag, lowers, form in reversed(FORMS):
        out = F.when((low if lowers else token).rlike(form), tag).otherwise(out)
    return out


class FormClasses(dict):
    """``class_of`` the rule tag of a word, in Python, kept for the words seen lately."""

    KEPT = 300_000

    def __init__(self):
        import re

        self.forms = [(tag, lowers, re.compile(form)) for tag, lowers, form in FORMS[:-1]]
        self.letters = {tag: letter for letter, tags in TAG_CLASSES.items() for tag in tags.split()}

    def __missing__(self, word: str) -> str:
        import unicodedata

        if len(self) > self.KEPT:
            self.clear()
        low = word.lower()
        tag = next((tag for tag, lowers, form in self.forms if form.search(low if lowers else word)), "NNP" if word and unicodedata.category(word[0]) == "Lu" else "NN")
        found = self[word] = self.letters[tag]
        return found


def merged_runs(tagged: DataFrame, joins=("N", "E")) -> DataFrame:
    """Runs of one class in a sentence as one item: (doc_id, sent, first, cls, value, n); of all classes if ``joins`` is None."""
    w = W.partitionBy("doc_id", "sent").orderBy("seq")
    alone = F.lit(False) if joins is None else ~F.col("cls").isin(*joins)
    new = F.coalesce((F.col("cls") != F.lag("cls").over(w)) | alone, F.lit(True))
    runs = tagged.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w))
    return runs.groupBy("doc_id", "sent", "run").agg(
        F.min("seq").alias("first"), F.min("cls").alias("cls"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda t: t["value"]), " ").alias("value"), F.count("*").alias("n")
    ).drop("run")


def voted_tags(tagged: DataFrame) -> DataFrame:
    """A word's tag where it stands between two of one other noun tag; ordinals count as CD."""
    w = W.partitionBy("doc_id", "sent").orderBy("seq")
    before, after = F.lag("nlptag").over(w), F.lead("nlptag").over(w)
    voted = F.when(F.col("value").rlike("^[0-9]+(st|nd|rd|th)$"), "CD").when((before == after) & before.isin("NNP", "NN") & F.col("nlptag").isin("NN", "NNP", "JJ"), before).otherwise(F.col("nlptag"))
    return tagged.withColumn("nlptag", voted)


def sentence_class(values: Column, tags: Column) -> Column:
    """numseq, date, title, sent or empty, in this order."""
    has_verb = F.exists(tags, lambda t: t.startswith("V") | (t == "MD"))
    numbers = F.size(values).between(1, 1000) & F.forall(tags, lambda t: t.isin("CD", ",", ".", ":"))
    title = F.exists(tags, lambda t: t.startswith("NNP")) & F.forall(tags, lambda t: t.isin("NNP", "NNPS", "IN", "DT", "CD", ",", "CC"))
    return F.when(is_date(values), "date").when(numbers, "numseq").when(title, "title").when(has_verb, "sent").otherwise("")


def names_within(part: Column, whole: Column) -> Column:
    """Every word of a name stands in another, as often at least."""
    count = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    return F.forall(part, lambda w: count(part, w) <= count(whole, w))


def usage(entities: DataFrame) -> DataFrame:
    """(doc_id, name, usage): 1 for a use in text, 1.5 in a title."""
    return entities.groupBy("doc_id", "name").agg(F.sum(F.when(F.col("kind") == "title", 1.5).otherwise(1.0)).alias("usage"))


def boosted(w: Column, uses: Column) -> Column:
    """A match's new weight: a third more, further thirds from 3 and 6 uses, its root from 9."""
    return w + w / 3 + F.when(uses >= 3, w / 3).otherwise(0.0) + F.when(uses >= 6, w / 3).otherwise(0.0) + F.when(uses >= 9, F.sqrt(w)).otherwise(0.0)


def sentence_filter(sentences: DataFrame, longest_run: int = 5) -> DataFrame:
    """Token arrays ``classes`` without verbs, with too many untagged tokens or a long run of them, go."""
    n, bare = F.size("classes"), F.size(F.filter("classes", lambda c: c == ""))
    run = F.array_max(F.transform(F.split(F.array_join(F.transform("classes", lambda c: F.when(c == "", "u").otherwise(" ")), ""), " +"), lambda x: F.length(x)))
    keep = F.exists("classes", lambda c: c == "V") & ~((n > 10) & (n <= 20) & (bare > 2 * n / 3)) & ~((n > 20) & (bare > n / 2)) & (F.coalesce(run, F.lit(0)) <= longest_run)
    return sentences.filter(keep)


def heading_carried(items: DataFrame, is_heading: Column) -> DataFrame:
    """Each item with the last heading before it in its document."""
    w = W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return items.withColumn("heading", F.last(F.when(is_heading, F.col("value")), ignorenulls=True).over(w))


def location_candidates(entities: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, location, n): what follows the last comma or ``of`` in entity names, within each document."""
    tail = F.trim(F.regexp_extract("name", r"(?:.*,|.*\bof )\s*(.+)$", 1))
    return entities.select("doc_id", tail.alias("location")).filter("location <> ''").groupBy("doc_id", "location").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def decayed_sum(rows: DataFrame, key: str, order: str, value: str, decay: float, levels: int = 4) -> DataFrame:
    """Running sum in which each earlier row of a key counts ``decay`` times as much per step.

    Powers stay within doubles: rows are summed in blocks, and what earlier blocks carry over is
    the same sum over blocks, ``levels`` deep."""
    size = max(2, min(500, int(600 / -math.log(decay)))) if 0 < decay < 1 else 500
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order)) - 1)
    placed = numbered.withColumns({"_b": F.floor(F.col("_n") / size), "_k": F.col("_n") % size})
    w = W.partitionBy(key, "_b").orderBy("_k")
    own = placed.withColumn("_own", F.sum(F.col(value) * F.pow(F.lit(decay), -F.col("_k"))).over(w) * F.pow(F.lit(decay), F.col("_k")))
    if levels == 0:
        return own.withColumn("decayed", F.col("_own")).drop("_n", "_b", "_k", "_own")
    ends = own.filter(F.col("_k") == size - 1).select(key, F.col("_b").alias(f"_block{levels}"), F.col("_own").alias("_end"))
    carried = decayed_sum(ends, key, f"_block{levels}", "_end", decay**size, levels - 1).select(key, (F.col(f"_block{levels}") + 1).alias("_b"), F.col("decayed").alias("_before"))
    both = own.join(carried, [key, "_b"], "left")
    return both.withColumn("decayed", F.col("_own") + F.coalesce("_before", F.lit(0.0)) * F.pow(F.lit(decay), F.col("_k") + 1)).drop("_n", "_b", "_k", "_own", "_before")


# Signs that alpha tokens are cut at.
ALPHA_DELIMITERS = "\u2019'\"`?!/;:.,-\u2014 )([]{}<>"


def abbreviation_parts(name: Column) -> Column:
    """Parts of a name that end in points, each with its point, trimmed."""
    return F.filter(F.transform(F.regexp_extract_all(name, F.lit(r"[^.]*\.|[^.]+$"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")


def trimmed_marks(name: Column) -> Column:
    """Without quotes, apostrophes, points, colons and semicolons at its ends."""
    return F.regexp_replace(name, "^['\u2019`\";.:]+|['\u2019`\";.:]+$", "")


def alpha_tokens(name: Column) -> Column:
    """Tokens of a trimmed name between delimiters, with a dash after those that anything but a space ends."""
    cut = "".join("\\" + c if c in "[]-^\\" else c for c in ALPHA_DELIMITERS)
    found = F.regexp_extract_all(trimmed_marks(name), F.lit(rf"[^{cut}]+(?:[{cut}]|$)"), F.lit(0))
    word = lambda t: F.regexp_replace(t, rf"[{cut}]$", "")
    return F.flatten(F.transform(found, lambda t: F.when(t.rlike(rf"[{cut}]$") & ~t.endswith(" "), F.array(word(t), F.lit("-"))).otherwise(F.array(word(t)))))


def inverse_references(spans: DataFrame, entities: DataFrame) -> DataFrame:
    """Spans (doc_id, text) with ``ref``, the name of the entity (doc_id, name, alias) that has the text as its alias."""
    known = entities.groupBy("doc_id", "alias").agg(F.min("name").alias("ref")).withColumnRenamed("alias", "text")
    return spans.join(known, ["doc_id", "text"], "left")


def own_skipped(tagged: DataFrame) -> DataFrame:
    """Pronouns with ``skip``: possessives before ``own``, and the neutral one before a form of be and a word that is no noun."""
    w = W.partitionBy("doc_id", "sent").orderBy("seq")
    after, later = F.lower(F.lead("value").over(w)), F.lead("cls", 2).over(w)
    neutral = (gender_of(F.col("value")) == "N") & after.isin("is", "was", "has") & ~F.coalesce(later, F.lit("")).isin("N", "E")
    return tagged.withColumn("skip", F.coalesce(gender_of(F.col("value")).isNotNull() & ((after == "own") | neutral), F.lit(False)))


def bracketed(tagged: DataFrame) -> DataFrame:
    """Tokens with ``inside``: how many brackets are open at them, and ``quoted``: whether they stand between quotation marks."""
    w = W.partitionBy("doc_id", "sent").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("value").isin("(", "[", "{"), 1).when(F.col("value").isin(")", "]", "}"), -1).otherwise(0)
    marks = F.sum((F.col("value") == '"').cast("int")).over(w)
    return tagged.withColumns({"inside": F.greatest(F.sum(step).over(w), F.lit(0)), "quoted": (marks % 2 == 1) & (F.col("value") != '"')})


def entity_sequences(tagged: DataFrame) -> DataFrame:
    """(doc_id, sent, first, value, n): runs of capitalized words in quotation marks or brackets, or in sentences that are titles."""
    placed = bracketed(tagged).withColumn("_kind", F.when(F.col("quoted"), "q").when(F.col("inside") > 0, "b").otherwise("t"))
    title = F.min((F.col("value").rlike(r"^\p{Lu}") | F.col("cls").isin("", "T!", "P!", "C")).cast("int")).over(W.partitionBy("doc_id", "sent"))
    able = placed.withColumn("_ok", F.col("value").rlike(r"^\p{Lu}") & ((F.col("_kind") != "t") | (title == 1)))
    w = W.partitionBy("doc_id", "sent").orderBy("seq")
    runs = able.withColumn("_new", ((F.col("_ok") != F.coalesce(F.lag("_ok").over(w), F.lit(False))) | (F.col("_kind") != F.coalesce(F.lag("_kind").over(w), F.col("_kind")))).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(w)).filter("_ok")
    return runs.groupBy("doc_id", "sent", "_run").agg(F.min("seq").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda t: t["value"]), " ").alias("value"), F.count("*").alias("n")).drop("_run")


# --- folds over one document -------------------------------------------------------------


def references(values: list[str], classes: list[str], roles: list[str], sents: list[int]) -> list[tuple[int, str | None, str | None]]:
    """(place, reference, gender) of a document's tokens that have one, in order.

    Entities gather gender votes from the pronouns that follow them, fading by 0.8 a
    sentence. A pronoun refers to the last subject of its gender (or of none known) within
    ten sentences, two where it stands in a conjunction. A name of fewer words refers to the
    fullest earlier name that holds them, weighted by recency. ``X is a N`` makes N a
    synonym of X, as do ``N X``, ``of N X`` and ``N of the M, X``, with their weights; a later
    ``the N`` refers to the X of most weight while that, fading by 0.85, is over 0.2."""
    subjects: list[list] = []  # name, sentence, gender or None
    names: dict[str, float] = {}
    holding: dict[str, set[str]] = {}  # names by word
    votes: dict[str, dict[str, float]] = {}
    updates: dict[str, int] = {}
    synonyms: dict[str, dict[str, float]] = {}
    low = [v.lower() for v in values]

    def same(noun: str, name: str, weight: float) -> None:
        known = synonyms.setdefault(noun, {})
        known[name] = min(2.5, known.get(name, 0.0) + weight) if name in known else weight

    out, last = [], None
    for k, word in enumerate(low):
        if sents[k] != last:
            names = {n: w * 0.8 for n, w in names.items() if w * 0.8 >= 0.1}
            votes = {n: {g: w * 0.8 for g, w in v.items() if w * 0.8 >= 0.3} for n, v in votes.items()}
            synonyms = {n: {e: w * 0.85 for e, w in v.items() if w * 0.85 >= 0.1} for n, v in synonyms.items()}
            subjects = [s for s in subjects if sents[k] - s[1] <= 10]
            last = sents[k]
        if classes[k] == "E":
            parts = values[k].split()
            fuller = [n for n in holding.get(parts[0], ()) if n in names and len(n.split()) > len(parts) and all(parts.count(p) <= n.split().count(p) for p in parts)]
            ref = max(fuller, key=lambda n: (names[n], -len(n), n)) if fuller else values[k]
            w = names.get(ref, 0.0)
            names[ref] = w + w / 3 if w else 1.0
            for p in ref.split():
                holding.setdefault(p, set()).add(ref)
            if roles[k] == "subj":
                known = votes.get(ref, {})
                best = sorted(known.values(), reverse=True)
                sure = best and best[0] > 2 * (best[1] if len(best) > 1 else 0.0)
                subjects.append([ref, sents[k], max(known, key=known.get) if sure else None])
            if k + 3 < len(low) and (low[k + 1], low[k + 2]) in (("is", "a"), ("was", "a"), ("is", "the"), ("was", "the"), ("is", "an")) and classes[k + 3] == "N":
                same(low[k + 3], ref, 2.0)
            if k and classes[k - 1] == "N":
                same(low[k - 1], ref, 2.7 if k > 1 and low[k - 2] == "of" else 1.0)
            if k > 4 and (values[k - 1], low[k - 4], low[k - 3]) == (",", "of", "the") and classes[k - 5] == classes[k - 2] == "N":
                same(low[k - 5], ref, 2.5)
            out.append((k, ref, None))
        elif word in PRONOUNS:
            ref, gender = None, PRONOUNS[word]
            reach = 2 if k and low[k - 1] in ("and", "or") else 10
            for s in reversed(subjects):
                if sents[k] - s[1] > reach:
                    break
                if s[2] in (None, gender):
                    ref = s[0]
                    v = votes.setdefault(ref, {})
                    updates[ref] = updates.get(ref, 0) + 1
                    v[gender] = v.get(gender, 0.0) + (1.2 if roles[k] == "subj" else 0.7) / math.sqrt(updates[ref])
                    s[2] = s[2] or gender
                    break
            out.append((k, ref, gender))
        elif classes[k] == "N" and k and low[k - 1] == "the" and max(synonyms.get(word, {}).values(), default=0.0) > 0.2:
            out.append((k, max(synonyms[word], key=lambda n: (synonyms[word][n], n)), None))
    return out


def fold_document(tokens: list[dict]) -> list[dict]:
    """``references`` for tokens (sent, seq, value, cls, role) in order: each with ref and gender."""
    found = {k: (ref, gender) for k, ref, gender in references(*([t[n] for t in tokens] for n in ("value", "cls", "role", "sent")))}
    return [{**t, "ref": found.get(k, (None, None))[0], "gender": found.get(k, (None, None))[1]} for k, t in enumerate(tokens)]


RESOLVED = "doc_id long, found array<struct<sent: int, seq: int, value: string, cls: string, role: string, ref: string, gender: string>>"


def discourse(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent, seq, value, cls, role, ref, gender): the entities, pronouns and synonyms of documents (doc_id, words), arrays by sentence.

    A document's sentences stand in its own row, so no token moves. A column ``classes`` of the same
    shape has the words' classes; without it, they are told by form. Subjects are those of ``tagger.roles``."""
    columns = ["doc_id", "words", *(["classes"] if "classes" in sentences.columns else [])]

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("sent", pa.int32()), ("seq", pa.int32()), *((n, pa.string()) for n in ("value", "cls", "role", "ref", "gender"))]))
        known = FormClasses()
        for b in batches:
            out, words_of = [], b.column("words").to_pylist()
            given = b.column("classes").to_pylist() if len(columns) > 2 else ([[known[w] for w in ws] for ws in doc or ()] for doc in words_of)
            for words, classes in zip(words_of, given, strict=True):
                flat = [(v, c, r, s, k) for s, (ws, cs) in enumerate(zip(words or (), classes or (), strict=True)) for k, (v, c, r) in enumerate(zip(ws, cs, roles(ws, cs), strict=True))]
                values, kinds, found_roles, sents, seqs = zip(*flat, strict=True) if flat else ((),) * 5
                out.append([{"sent": sents[k], "seq": seqs[k], "value": values[k], "cls": kinds[k], "role": found_roles[k], "ref": ref, "gender": gender} for k, ref, gender in references(values, kinds, found_roles, sents)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind)], ["doc_id", "found"])

    return sentences.select(*columns).mapInArrow(run, RESOLVED).select("doc_id", F.explode("found").alias("r")).select("doc_id", "r.*")


WORD_OR_SIGN = r"[\p{L}\p{N}'-]+|[^\s\p{L}\p{N}]"


def sentence_arrays(docs: DataFrame) -> DataFrame:
    """(doc_id, words) of texts, arrays by sentence; sentences end at . ! ? ;"""
    return docs.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?;])\s+"), lambda s: F.regexp_extract_all(s, F.lit(WORD_OR_SIGN), F.lit(0))).alias("words"))


def tagged_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, sent, seq, value, cls, role) of texts by the form tagger; an entity or pronoun that begins its sentence counts as subject."""
    sents = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?;])\s+")).alias("sent", "s"))
    toks = sents.select("doc_id", "sent", F.posexplode(F.regexp_extract_all("s", F.lit(WORD_OR_SIGN), F.lit(0))).alias("seq", "value"))
    cls = class_of(rule_tags(F.col("value")))
    return toks.select("doc_id", "sent", "seq", "value", cls.alias("cls"), F.when((F.col("seq") == 0) & cls.isin("E", "R"), "subj").otherwise("").alias("role"))


# --- names of several parts --------------------------------------------------------------


def parts_usage(names: DataFrame) -> DataFrame:
    """(doc_id, part, usage): uses of every name and of every beginning and ending of it."""
    words = F.split("name", " ")
    n = F.size(words)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array(F.array_join(F.slice(words, F.lit(1), k), " "), F.array_join(F.slice(words, k + 1, n), " ")))
    every = F.array_union(F.array("name"), F.when(n > 1, F.flatten(pieces)).otherwise(F.array().cast("array<string>")))
    return names.select("doc_id", "usage", F.explode(every).alias("part")).groupBy("doc_id", "part").agg(F.sum("usage").alias("usage"))


def split_names(names: DataFrame, spark: SparkSession | None = None, factor: float = 10.0, rounds: int | None = None) -> DataFrame:
    """Names cut in two where both parts are names themselves and the first is used over
    ``factor`` times as much as at any other cut; the parts take over the uses.

    Repeated until nothing is cut, each round's names written to the shared folder; a cut leaves
    fewer words to cut at, so rounds end with the longest name's words. With ``rounds``, so many
    are planned in one piece, without a session."""
    if rounds is not None:
        for _ in range(rounds):
            names = _cut_once(names, factor)[0]
        return names
    names = stored(names, spark, "names")
    while True:
        after, gone = _cut_once(names, factor)
        if gone.isEmpty():
            return names
        names = stored(after, spark, "names")


def _cut_once(names: DataFrame, factor: float) -> tuple[DataFrame, DataFrame]:
    """Names after one round of cuts, and (doc_id, name) of those cut."""
    used = parts_usage(names)
    own = names.select("doc_id", F.col("name").alias("part"))
    words = F.split("name", " ")
    cuts = names.filter(F.size(words) > 1).select("doc_id", "name", F.col("usage").alias("uses"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"), words.alias("w"))
    cuts = cuts.select("doc_id", "name", "uses", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"))
    known = cuts.join(own.withColumnRenamed("part", "head"), ["doc_id", "head"], "left_semi").join(own.withColumnRenamed("part", "tail"), ["doc_id", "tail"], "left_semi")
    told = known.join(used.select("doc_id", F.col("part").alias("head"), F.col("usage").alias("head_usage")), ["doc_id", "head"])
    whole = used.select("doc_id", F.col("part").alias("name"), F.col("usage").alias("name_usage"))
    w = W.partitionBy("doc_id", "name").orderBy(F.desc("head_usage"), "head")
    best = told.join(whole, ["doc_id", "name"]).withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("head_usage").over(w))
    best = best.filter((F.col("_r") == 1) & (F.col("head_usage") > factor * F.greatest(F.coalesce("_next", F.lit(0.0)), F.col("name_usage"))))
    gone = best.select("doc_id", "name")
    moved = best.select("doc_id", F.explode(F.array("head", "tail")).alias("name"), F.col("uses").alias("usage"))
    after = names.join(gone, ["doc_id", "name"], "left_anti").select("doc_id", "name", "usage").unionByName(moved).groupBy("doc_id", "name").agg(F.sum("usage").alias("usage"))
    return after, gone


def most_used(names: DataFrame, share: float = 0.6, least: float = 3.0, long_name: int = 5) -> DataFrame:
    """Names used ``least`` times; if the most used reach ``share`` of all uses, the rarer ones
    go, but for those of ``long_name`` words and more."""
    kept = names.filter(F.col("usage") >= least)
    by, whole = W.partitionBy("doc_id").orderBy(F.desc("usage")).rangeBetween(W.unboundedPreceding, 0), W.partitionBy("doc_id")
    told = kept.withColumn("_sum", F.sum("usage").over(by)).withColumn("_all", F.sum("usage").over(whole))
    cut = F.max(F.when(F.col("_sum") > share * F.col("_all"), F.col("usage"))).over(whole)
    return told.withColumn("_cut", F.coalesce(cut, F.lit(least))).filter((F.col("usage") >= F.col("_cut")) | (F.size(F.split("name", " ")) >= long_name)).drop("_sum", "_all", "_cut")


def best_title_match(title: Column, names: DataFrame) -> DataFrame:
    """(doc_id, name): the most used name whose words stand in the title, shorter ones before
    longer ones; single words only for titles of up to three."""
    words, whole = F.split("name", " "), F.split(title, " ")
    fits = names.filter(names_within(words, whole) & ((F.size(words) > 1) | (F.size(whole) <= 3)))
    return fits.groupBy("doc_id").agg(F.max_by("name", F.struct("usage", -F.size(words), "name")).alias("name"))


def longest_spans(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, pos, n, phrase, id): places in ``toks`` where a dictionary name stands, the longest at each."""
    return exclusive(matched(tokens, names))


def own_spans(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, pos, n, name): places in a document's ``toks`` where one of its own names (doc_id, name) stands, longer ones covering shorter.

    Names are found by their first words: a word leaves its document only as the first of one of
    that document's names, with as many words behind it as the longest name has."""
    parsed = names.select("doc_id", "name", T.lower_words(F.col("name")).alias("words")).filter(F.size("words") > 0).distinct()
    known = parsed.groupBy("doc_id", F.get("words", F.lit(0)).alias("key"), "words").agg(F.min("name").alias("name"))
    longest = known.agg(F.max(F.size("words"))).first()[0] or 0
    arr = F.col("toks")
    placed = F.transform(arr, lambda w, i: F.struct(i.alias("pos"), w.alias("key"), F.slice(arr, i + 1, F.lit(max(longest, 1))).alias("ahead")))
    firsts = tokens.select("doc_id", F.explode(placed).alias("_w")).select("doc_id", "_w.*").join(known, ["doc_id", "key"])
    n = F.size("words")
    return exclusive(firsts.filter(F.slice("ahead", F.lit(1), n) == F.col("words")).select("doc_id", "pos", n.alias("n"), "name"))


def merged_markup(items: DataFrame, tagged: DataFrame) -> DataFrame:
    """Tagged tokens put back at their items: (doc_id, seq, type, tokens) in item order."""
    per = tagged.groupBy("doc_id", "seq").agg(F.array_sort(F.collect_list(F.struct("pos", "cls", "value"))).alias("tokens"))
    return items.join(per, ["doc_id", "seq"], "left")
