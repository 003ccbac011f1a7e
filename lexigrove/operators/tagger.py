"""A trainable sequence tagger: a bigram hidden Markov model, counted by Spark, decoded in batches.

``train`` counts how often tags follow each other, how often words have them, and how often
words' endings do (for words that training has not seen). The model is bounded: some tens of
tags, the ``WORDS`` most frequent words and the ``ENDINGS`` most frequent endings; it goes to
the tasks as it is, so tagging moves no token. ``tagged`` decodes all sentences of a batch at
once (Viterbi over arrays, padded by length), and equal scores go to the lesser tag.

``roles`` finds subjects by chunk and verb: the chunk before a clause's first verb.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Entries of a model, at most, and the longest ending.
WORDS, ENDINGS, ENDING = 100_000, 20_000, 4
#: Sentences decoded at once.
BATCH = 2000
#: Words that begin a clause or tie its parts, and words before a noun that are no part of it.
LINKS = ("and", "or", "but", "that", "because", "if", ";")
DETERMINERS = ("the", "a", "an", "this", "these", "those", "my", "our", "your")


@dataclass
class Model:
    """Logarithms: of a tag at a sentence's start, of one after another, of a word or an ending under each tag."""

    tags: list[str]
    start: list[float]
    step: list[list[float]]
    words: dict[str, list[float]] = field(default_factory=dict)
    endings: dict[str, list[float]] = field(default_factory=dict)
    other: list[float] = field(default_factory=list)


def counts(tagged: DataFrame, key: str = "sent_id") -> tuple[DataFrame, DataFrame]:
    """(before, tag, n) and (word, tag, n) of tagged words (key, seq, word, tag); ``before`` is null at a start."""
    before = F.lag("tag").over(W.partitionBy(key).orderBy("seq"))
    steps = tagged.withColumn("before", before).groupBy("before", "tag").agg(F.count("*").alias("n"))
    return steps, tagged.groupBy("word", "tag").agg(F.count("*").alias("n"))


def train(tagged: DataFrame, key: str = "sent_id", words: int = WORDS, endings: int = ENDINGS) -> Model:
    """Learn from tagged words (key, seq, word, tag); counts of one are added to each step and a tenth to each word's tag."""
    steps, forms = counts(tagged, key)
    told = steps.collect()  # pairs of tags
    tags = sorted({r["tag"] for r in told})
    at = {t: k for k, t in enumerate(tags)}
    step, start, total = ([[1.0] * len(tags) for _ in tags], [1.0] * len(tags), [0.0] * len(tags))
    for r in told:
        total[at[r["tag"]]] += r["n"]
        if r["before"] is None:
            start[at[r["tag"]]] += r["n"]
        else:
            step[at[r["before"]]][at[r["tag"]]] += r["n"]
    logs = lambda row: [math.log(x / sum(row)) for x in row]

    def best(counted: DataFrame, k: int) -> dict[str, list[float]]:
        """log P(tag | word) - log P(tag), which ranks tags as P(word | tag) does, of the ``k`` most frequent words."""
        whole = counted.groupBy("word").agg(F.sum("n").alias("all"), F.collect_list(F.struct("tag", "n")).alias("ns"))
        out = {}
        for r in whole.orderBy(F.desc("all"), "word").limit(k).collect():
            held = {x["tag"]: x["n"] for x in r["ns"]}
            out[r["word"]] = [math.log((held.get(t, 0) + 0.1 * total[at[t]] / sum(total)) / (r["all"] + 0.1)) - math.log(total[at[t]] / sum(total)) for t in tags]
        return out

    # endings are learned from rarer words, which unseen ones resemble
    sizes = forms.groupBy("word").agg(F.sum("n").alias("all")).filter("all <= 10").select("word")
    rare = forms.join(sizes, "word", "left_semi")
    lengths = F.sequence(F.lit(1), F.least(F.length("word"), F.lit(ENDING)))
    cut = F.explode(F.transform(lengths, lambda n: F.substring("word", F.length("word") - n + 1, n)))
    short = rare.select(cut.alias("ending"), "tag", "n").groupBy("ending", "tag").agg(F.sum("n").alias("n")).withColumnRenamed("ending", "word")
    return Model(tags, logs(start), [logs(row) for row in step], best(forms, words), best(short, endings), [0.0] * len(tags))


def _scores(model: Model, word: str) -> list[float]:
    """A word's scores by tag, of its longest known ending if it is new."""
    if (found := model.words.get(word)) is not None:
        return found
    return next((model.endings[word[-n:]] for n in range(min(ENDING, len(word)), 0, -1) if word[-n:] in model.endings), model.other)


def decoded(model: Model, sentences: list[list[str]]) -> list[list[str]]:
    """The best tags of each sentence, those of one batch step by step at once."""
    import numpy as np

    out: list[list[str]] = [[] for _ in sentences]
    order = sorted((k for k, s in enumerate(sentences) if s), key=lambda k: len(sentences[k]))
    step, start, seen = np.array(model.step), np.array(model.start), {}

    def scores(word):
        if word not in seen:
            seen[word] = _scores(model, word)
        return seen[word]

    for first in range(0, len(order), BATCH):
        some = order[first : first + BATCH][::-1]  # longest first, so those still running are the first rows
        lengths = np.array([len(sentences[k]) for k in some])
        now, back = start + np.array([scores(sentences[k][0]) for k in some]), []
        for t in range(1, int(lengths[0])):
            n = int((lengths > t).sum())
            paths = now[:n, :, None] + step[None]
            back.append(paths.argmax(axis=1))
            now[:n] = paths.max(axis=1) + np.array([scores(sentences[k][t]) for k in some[:n]])
        for row, k in enumerate(some):
            at = int(now[row].argmax())
            tags = [at]
            for t in range(int(lengths[row]) - 2, -1, -1):
                at = int(back[t][row, at])
                tags.append(at)
            out[k] = [model.tags[x] for x in reversed(tags)]
    return out


def tagged(sentences: DataFrame, model: Model, column: str = "words") -> DataFrame:
    """Rows with ``tags`` for an array column of words; null arrays have none."""
    names = sentences.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sentences.schema) + ", tags array<string>"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = decoded(model, [s or [] for s in b.column(names.index(column)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], [*names, "tags"])

    return sentences.mapInArrow(run, schema)


def roles(words: list[str], classes: list[str]) -> list[str]:
    """``subj`` at the last word of each chunk (of classes N, E, R, with A, C and W before) that a clause's verb follows, '' elsewhere.

    A chunk after a preposition is none, nor is one after the clause's verb; adverbs, and what
    stands between two commas, may come before the verb; what ``and`` or ``or`` ties to a subject is one too."""
    out = [""] * len(words)
    chunks, k = [], 0
    while k < len(words):
        end = k
        while end < len(words) and classes[end] in ("N", "E", "R", "A", "C", "M") and (end == k or classes[end] != "R"):
            end += 1
        heads = [x for x in range(k, end) if classes[x] in ("N", "E", "R")]
        if heads:
            chunks.append((k, heads[-1]))
            k = heads[-1] + 1
        else:
            k = max(end, k + 1)
    low = [w.lower() for w in words]

    def led(start):
        """The word before a chunk's determiners."""
        start -= 1
        while start >= 0 and (low[start] in DETERMINERS or classes[start] == "R"):
            start -= 1
        return start

    def preposition(at):
        return classes[at] == "" and words[at].isalpha() and low[at] not in LINKS and low[at] not in DETERMINERS

    def verb_after(at):
        """The place of the verb that follows, phrases with prepositions, inserts between commas and adverbs left out; -1 for none."""
        at += 1
        while at < len(words):
            nearest = next((head for start, head in chunks if start > at), None)
            if preposition(at) and nearest is not None and led(next(start for start, head in chunks if head == nearest)) == at:
                at = nearest + 1
            elif words[at] == "," and "," in words[at + 1 :]:
                at = words.index(",", at + 1) + 1
            elif classes[at] == "A":
                at += 1
            else:
                return at if classes[at] in ("V", "M") else -1
        return -1

    taken = -1  # the verb that ends the clause of the last subject
    for n, (start, head) in enumerate(chunks):
        before = led(start)
        verb = verb_after(head)
        clause = taken < 0 or any(w in LINKS or classes[k] in ("T!", "P!", "W") for k, w in enumerate(low[:start]) if k > taken)
        if verb >= 0 and clause and not (before >= 0 and (preposition(before) or classes[before] in ("V", "M"))):
            out[head], taken = "subj", verb
            # what is tied to it before is a subject too
            j = n
            while j and low[led(chunks[j][0])] in ("and", "or", ",") and led(chunks[j][0]) == chunks[j - 1][1] + 1:
                j -= 1
                lead = led(chunks[j][0])
                if lead >= 0 and (classes[lead] in ("V", "M") or preposition(lead)):
                    break  # an object before the clause begins
                out[chunks[j][1]] = "subj"
    return out
