"""The suffix stripping algorithm of M. F. Porter (1980), from the paper's rules."""

from __future__ import annotations

import re

# The paper's suffix tables for steps 2, 3 and 4.
STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(w: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for k, ch in enumerate(w):
        out += "v" if ch in "aeiou" or ch == "y" and k and out[-1] == "c" else "c"
    return out


def measure(w: str) -> int:
    return len(re.findall("v+c+", shape(w)))


def _ends_cvc(w: str) -> bool:
    return shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _longest(w: str, suffixes) -> str | None:
    return next((s for s in sorted(suffixes, key=len, reverse=True) if w.endswith(s)), None)


def stem_word(w: str) -> str:
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    for a, b in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(a):
            w = w[: len(w) - len(a)] + b
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and "v" in shape(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and _ends_cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        s = _longest(w, rules)
        if s and measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + rules[s]
    s = _longest(w, STEP4)
    if s and measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not _ends_cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w
