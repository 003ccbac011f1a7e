"""Named functions of an installation: normalizers, tokenizers, weightings, summaries."""

from __future__ import annotations

from collections.abc import Callable

from . import text

KINDS = ("normalizer", "tokenizer", "weighting", "summary")
_FOUND: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, function: Callable) -> None:
    """Add a function; a name already there is replaced."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    _FOUND[kind, name] = function


def get(kind: str, name: str) -> Callable:
    if (kind, name) not in _FOUND:
        raise KeyError(f"no {kind} named {name}")
    return _FOUND[kind, name]


def normalizer(names: list[str]) -> Callable:
    """A chain of registered normalizers, the first one first."""
    return text.chain(*(get("normalizer", n) for n in names))


for _name, _function in {"lc": text.lowered, "orig": text.same, "empty": text.emptied, "convdia": text.without_marks, "stem": text.stem, "wordjoin": text.joined_words(), "entityid": text.entity_id, "decode_xml": text.decode_xml, "decode_url": text.decode_url}.items():
    register("normalizer", _name, _function)
for _name, _function in {"content": text.content, "word": text.words, "split": text.fields, "punctuation": text.end_marks(), "ngram": text.ngrams(3)}.items():
    register("tokenizer", _name, _function)
