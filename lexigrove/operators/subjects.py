"""Genders of names by the pronouns that follow them, as a fold over a document's sentences.

Each sentence becomes mentions: names (whole runs of proper nouns, subjects or not, with the
pronoun that a phrase behind them ties to them) and free pronouns. Past subjects keep a weight
for each gender, and one for none, that fade from sentence to sentence; a free pronoun spreads its
weight over all of them by their shares. What a sentence adds is divided by the root of its
number of additions, so sentences full of names tell less about each.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nlp import PRONOUNS, rule_tags
from .tagger import roles

#: Fading a sentence, the weight from which on it is kept, weights of pronouns (of subjects), of names with pronouns of persons and others, what subjects add.
FADE, KEPT, PRONOUN, SUBJECT_PRONOUN, PERSON, OTHER, SUBJECT = 0.8, 0.3, 0.7, 1.2, 1.0, 0.7, 1.7
RENEWED, AGAIN_SHARE, AGAIN = 1.0, 0.3, 0.2
#: A gender is sure if it has over so many times the next one's weight, and over so much.
TIMES, LEAST = 2.0, 2.0
VERBS = ("MD", "VBZ", "VBD", "VBG", "VBP", "VBN")
DESCRIBING = ("VBG", "JJ", "JJR", "JJS", "RB", "RBR", "RBS", "NN", "NNS", "NNP", "NNPS")


def _tied(words, tags, at: int) -> int:
    """The pronoun that a phrase after a name ties to it (``X left with his ...``); -1 for none."""
    n = len(words)
    while at < n and tags[at].startswith("RB"):
        at += 1
    while at < n and tags[at] in VERBS:
        at += 1
    if at + 1 >= n or tags[at] not in ("IN", "CC") or not tags[at + 1].startswith("PRP"):
        return -1
    at += 1
    if words[at] in ("it", "him") or words[at] == "her" and (at + 1 >= n or tags[at + 1] in DESCRIBING):
        return -1
    return at


def _impersonal(words, tags, at: int) -> int:
    """Where reading goes on after a pronoun that refers to nothing before (``it is said that``, ``his own``); -1 if it does refer."""
    low, n = words[at].lower(), len(words)
    if low in ("his", "her", "its") and at + 1 < n and words[at + 1].lower() == "own":
        return at + 2
    if low != "it" or at + 1 >= n or tags[at + 1] not in ("VBZ", "VBD") or words[at + 1] not in ("'s", "s", "is", "was"):
        return -1
    at += 2
    if at < n and tags[at] in ("RBR", "RBS", "RB", "JJ", "JJR", "JJS"):
        at += 1
    ends = at < n and (tags[at] == "IN" and words[at] in ("that", "to") or tags[at] in ("WP", "WP$", "WRB", "WDT"))
    return at + 1 if ends else -1


def mentions(words: list[str], tags: list[str], role: list[str]) -> list[tuple[str | None, str, bool]]:
    """(name, gender, subject) in order: a name with the gender tied to it ('' for none), or no name for a free pronoun."""
    out, at = [], 0
    while at < len(words):
        if tags[at].startswith("NNP"):
            end = at
            while end < len(words) and tags[end].startswith("NNP"):
                end += 1
            subject, tied = any(role[at:end]), _tied(words, tags, end)
            gender = PRONOUNS.get(words[tied].lower(), "") if tied >= 0 else ""
            if tied >= 0 or subject:
                out.append((" ".join(words[at:end]), gender, subject))
            at = tied + 1 if tied >= 0 else end
        elif tags[at].startswith("PRP"):
            onward = _impersonal(words, tags, at)
            if onward < 0 and (gender := PRONOUNS.get(words[at].lower())):
                out.append((None, gender, bool(role[at])))
            at = max(onward, at + 1)
        else:
            at += 1
    return out


def gender_weights(sentences: list[list[tuple[str | None, str, bool]]]) -> dict[str, dict[str, float]]:
    """Weights of genders by name, from each sentence's mentions."""
    found: dict[str, dict[str, float]] = {}
    past: dict[tuple[str, str], float] = {}
    for sentence in sentences:
        past = {k: w * FADE for k, w in past.items() if w >= KEPT}
        total, added = sum(past.values()), []
        for name, gender, subject in sentence:
            if name is None:
                weight = SUBJECT_PRONOUN if subject else PRONOUN
                # past subjects of its gender, and those of whom none is known, by their shares
                added += [(n, gender, weight * w / total) for (n, g), w in past.items() if g in (gender, "")]
            elif gender:
                added.append((name, gender, (PERSON if gender in "WM" else OTHER) * (SUBJECT if subject else 1.0)))
            else:
                own = [(g, w) for (n, g), w in past.items() if n == name]
                if all(g for g, _ in own):
                    added.append((name, "", RENEWED))
                added += [(name, g, w * AGAIN_SHARE + AGAIN) for g, w in own]
        for name, gender, weight in added:
            if gender:
                of = found.setdefault(name, {})
                of[gender] = of.get(gender, 0.0) + weight / math.sqrt(len(added))
        # only what weighs over half of the most becomes past
        most: dict[str, float] = {}
        for _, gender, weight in added:
            most[gender] = max(most.get(gender, 0.0), weight)
        for name, gender, weight in added:
            if not gender or weight > most[gender] / 2:
                past[name, gender] = past.get((name, gender), 0.0) + weight
    return found


def sure_gender(name: str, weights: dict[str, float]) -> str | None:
    """The gender of most weight, if it is sure; a name with a comma is a plural or nothing."""
    ranked = sorted(weights.items(), key=lambda x: -x[1])
    if not ranked or ranked[0][1] <= LEAST or len(ranked) > 1 and ranked[0][1] <= TIMES * ranked[1][1]:
        return None
    return None if "," in name and ranked[0][0] != "P" else ranked[0][0]


def genders(sentences: DataFrame) -> DataFrame:
    """(doc_id, name, gender, weight, sure) of documents (doc_id, words, tags), arrays by sentence; ``sure`` is the name's sure gender."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for doc_id, words, tags in zip(*(b.column(c).to_pylist() for c in ("doc_id", "words", "tags")), strict=True):
                told = [mentions(ws, ts, roles(ws, [_class(t) for t in ts])) for ws, ts in zip(words or (), tags or (), strict=True)]
                rows += [(doc_id, name, g, w, sure_gender(name, of)) for name, of in gender_weights(told).items() for g, w in of.items()]
            kinds = {"doc_id": pa.int64(), "name": pa.string(), "gender": pa.string(), "weight": pa.float64(), "sure": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))

    return sentences.select(F.col("doc_id").cast("long").alias("doc_id"), "words", "tags").mapInArrow(run, "doc_id long, name string, gender string, weight double, sure string")


def _class(tag: str) -> str:
    """The class that ``roles`` reads, of the tags that matter to it."""
    kinds = {"N": ("NN", "NNS", "FW"), "E": ("NNP", "NNPS"), "R": ("PRP", "PRP$"), "M": ("MD", "PDT"), "C": ("CD",), "T!": (".", ";"), "P!": (",", ":"), "W": ("WDT", "WP", "WP$", "WRB")}
    return next((k for k, tags in kinds.items() if tag in tags), "V" if tag.startswith("VB") else "A" if tag[:2] in ("JJ", "RB") else "")


def tagged_by_form(arrays: DataFrame) -> DataFrame:
    """``nlp.sentence_arrays`` with ``tags`` by form."""
    return arrays.withColumn("tags", F.transform("words", lambda ws: F.transform(ws, rule_tags)))
