"""The English stemmer of M. F. Porter (2001, "Porter2"), from its published description."""

from __future__ import annotations

import re

VOWELS = "aeiouy"
# Words that are stems as they are given here, and those that stop after step 1a.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STOPPED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# Beginnings after which the first region begins at once.
BEGINNINGS = ("gener", "commun", "arsen")
# The suffixes of steps 2, 3 and 4.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def _short_syllable(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS + "wxY"


def stem_word(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters are their own."""
    w = word.replace("’", "'")
    if len(w) <= 2:
        return word
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = w.removeprefix("'")
    # y is a consonant at the beginning and after a vowel
    letters = list(w)
    for k, c in enumerate(letters):
        if c == "y" and (k == 0 or letters[k - 1] in VOWELS):
            letters[k] = "Y"
    w = "".join(letters)
    first = next((b for b in BEGINNINGS if w.startswith(b)), None)
    r1 = len(first) if first else m.end() if (m := REGION.search(w)) else len(w)
    r2 = m.end() if (m := REGION.search(w, r1)) else len(w)

    # 0: apostrophes
    w = w.removesuffix("'")
    w = w.removesuffix("'s")
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in STOPPED:
        return w
    # 1b: past forms
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in VOWELS for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _short_syllable(w) and r1 >= len(w):
            w += "e"
    # 1c: y after a consonant that is not the first letter
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # 2
    s = _longest(w, STEP2)
    if s and len(w) - len(s) >= r1:
        before = w[-len(s) - 1] if len(w) > len(s) else ""
        if s == "ogi":
            w = w[:-1] if before == "l" else w
        elif s == "li":
            w = w[:-2] if before and before in "cdeghkmnrt" else w
        else:
            w = w[: -len(s)] + STEP2[s]
    # 3
    s = _longest(w, STEP3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + STEP3[s]
    # 4
    s = _longest(w, STEP4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
