"""Text functions over columns: normalizers, tokenizers, and small string tools.

Normalizers compose with ``chain``, which applies them left to right. All but ``stem`` and
``decode_entities`` are built-in expressions that stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .porter import stem_word as stem_word_1980
from .porter2 import stem_word

WORD_BREAK = r"[^\p{L}\p{N}]+"
Normalizer = Callable[[Column], Column]


def chain(*steps: Normalizer) -> Normalizer:
    """One normalizer that applies several, the first one first."""

    def run(c: Column) -> Column:
        for s in steps:
            c = s(c)
        return c

    return run


# --- normalizers -----------------------------------------------------------------------


def lowered(c: Column) -> Column:
    return F.lower(c)


def same(c: Column) -> Column:
    return c


def emptied(c: Column) -> Column:
    """The empty value of pure position markers; null stays null."""
    return F.when(c.isNotNull(), F.lit(""))


def constant(value: str) -> Normalizer:
    return lambda c: F.when(c.isNotNull(), F.lit(value))


def prefixed(prefix: str) -> Normalizer:
    return lambda c: F.concat(F.lit(prefix), c)


def joined_words(glue: str = "_") -> Normalizer:
    return lambda c: F.regexp_replace(c, r"\s+", glue)


def entity_id(c: Column) -> Column:
    """Trimmed, with runs of what is neither letter nor digit as one underscore."""
    return F.regexp_replace(F.trim(c), WORD_BREAK, "_")


def _marked_letters() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, and these letters; one for one."""
    import unicodedata

    found = []
    for k in (*range(0xC0, 0x600), *range(0x1E00, 0x2000)):
        base = [c for c in unicodedata.normalize("NFD", chr(k)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(k):
            found.append((chr(k), base[0]))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


ACCENTED, PLAIN = _marked_letters()


def without_marks(c: Column) -> Column:
    """Letters of the Latin, Greek and Cyrillic scripts without diacritics, those of decomposed texts as well; the sharp s and ligatures as two letters."""
    c = F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}+", "")
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def plain_token(c: Column) -> Column:
    """Lower case without quotes, brackets and end marks, for token statistics."""
    return F.translate(F.lower(c), "'\"()?!/;:\\’", "")


def rule_name(c: Column) -> Column:
    """Without backslash, dot and quotes; underscore runs as one."""
    return F.regexp_replace(F.translate(c, "\\.'\"", ""), "_+", "_")


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def decode_xml(c: Column) -> Column:
    """The five predefined entities, once."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def decode_url(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def decode_entities(c: Column) -> Column:
    """All named and numeric character references."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import html

        return s.map(lambda x: None if x is None else html.unescape(x))

    return run(c)


def mapped(words: dict[str, str]) -> Normalizer:
    """Irregular forms to their lemmas: a bounded user dictionary; others stay."""

    def run(c: Column) -> Column:
        if not words:
            return c
        pairs = F.create_map(*(F.lit(x) for kv in sorted(words.items()) for x in kv))
        return F.coalesce(F.try_element_at(pairs, c), c)

    return run


# Typographic signs and what they are cleaned to.
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
QUOTES = "\u00ab\u00bb\u201c\u201d\u201e\u201f\u2033\u2036"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
APOSTROPHES = "\u2018\u2019\u201a\u201b\u2032\u00b4"


# Signs that the clean-up for taggers turns into a space (ranges of code points), into a quotation mark, or else.
CLEANED_TO_SPACE = ((0x2010, 0x2017), (0x2020, 0x202F), (0x2032, 0x203F), (0x215B, 0x215B), (0x2192, 0x2192), (0x2194, 0x2194), (0x21C6, 0x21C6), (0x2212, 0x2212), (0x2264, 0x2264), (0x3003, 0x3003), (0x3008, 0x300B), (0xFF08, 0xFF09), (0x00A2, 0x00BE), (0x00D7, 0x00D7), (0x02BE, 0x02BE))
CLEANED_TO_QUOTE = (0x2018, 0x201F)
CLEANED_TO_MARK = {"\u00a1": "!", "\u00bf": "?"}


def cleaned_signs() -> tuple[str, str]:
    """The signs, and what each becomes."""
    spaces = "".join(chr(k) for low, high in CLEANED_TO_SPACE for k in range(low, high + 1))
    quotes = "".join(map(chr, range(CLEANED_TO_QUOTE[0], CLEANED_TO_QUOTE[1] + 1)))
    return spaces + quotes + "".join(CLEANED_TO_MARK), " " * len(spaces) + '"' * len(quotes) + "".join(CLEANED_TO_MARK.values())


def clean_typography(c: Column) -> Column:
    """Two apostrophes as a quotation mark, rests of entities and typographic signs as spaces, quotes as plain ones."""
    c = F.replace(c, F.lit("''"), F.lit('"'))
    c = F.regexp_replace(F.replace(c, F.lit("nbsp;"), F.lit(" ")), "&[a-z]*;", " ")
    return F.translate(c, *cleaned_signs())


def clean_for_tagging(c: Column) -> Column:
    """Typography, signs of markup as spaces, brackets as commas, spaces about punctuation."""
    c = F.regexp_replace(clean_typography(c), r"[~_=/#$%&'()*+-]", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"[<>()|\[\]{}]", " ,"), r",+\.", ".")
    return F.translate(F.regexp_replace(c, r"([;,!?:])", " $1 "), "\\", " ")


def class_runs(text: str) -> int:
    """Runs of capitals, small letters, digits and other signs in a string."""
    import re

    return len(re.findall("[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+", text))


# --- tokenizers ------------------------------------------------------------------------


def words(c: Column) -> Column:
    """Runs of letters and digits."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WORD_BREAK), lambda x: x != "")


def lower_words(c: Column) -> Column:
    return words(F.lower(c))


def fields(c: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def content(c: Column) -> Column:
    """The whole value as one token."""
    return F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))


def matches(pattern: str, group: int = 0) -> Normalizer:
    return lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def end_marks(extra: str = "") -> Normalizer:
    return matches("[.!?" + "".join("\\" + x for x in extra) + "]")


def ngrams(n: int = 3, mark: str = "_") -> Normalizer:
    """Character n-grams with start padding; the whole padded value if shorter."""

    def run(c: Column) -> Column:
        p = F.concat(F.lit(mark * (n - 1)), c)
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))

    return run


# --- titles, links, URLs ---------------------------------------------------------------

# Words that stay small in titles.
SMALL_WORDS = (
    "the a an aboard about above across after against along amid among anti around as at before behind below beneath beside besides between beyond but by "
    "concerning considering despite down during except excepting excluding following for from in inside into like minus near of off on onto opposite outside over "
    "past per plus regarding round save since than through to toward towards under underneath unlike until up upon versus via with within without"
).split()


def link_title(c: Column) -> Column:
    """Single spaces; words that begin with a to z get a capital, small words do not."""
    parts = F.split(F.trim(F.regexp_replace(c, r"[\x00-\x20]+", " ")), " ")
    up = lambda w: F.concat(F.translate(F.substring(w, 1, 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(w, 2, 1 << 20))
    return F.array_join(F.transform(parts, lambda w: F.when(w.isin(*SMALL_WORDS), w).otherwise(up(w))), " ")


def link_base(c: Column) -> Column:
    return F.substring_index(c, "#", 1)


def link_anchor(c: Column) -> Column:
    return F.regexp_extract(c, "#(.*)$", 1)


def link_domain(c: Column) -> Column:
    """Up to twelve letters before a colon, lowered; empty if there are none."""
    return F.lower(F.regexp_extract(c, "^([A-Za-z]{1,12}):", 1))


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "^[a-zA-Z]+://([^/:?#]+)", 1))


def middle_cut(c: Column, size: int = 60) -> Column:
    """At most ``size`` characters, the middle replaced by dots; control characters as spaces."""
    c = F.regexp_replace(c, r"[\x00-\x1F]", " ")
    half = (size - 3) // 2
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.substring(c, 1, half), F.lit("..."), F.substring(c, -half, half)))


def file_id(c: Column) -> Column:
    """A file name for a title: spaces as underscores, other signs as lower hex escapes."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import re

        def one(t):
            if t is None:
                return None
            raw = re.sub(rb"\s+", b"_", t.lstrip().encode())
            out = "".join(chr(b) if chr(b).isalnum() and b < 128 or b in b"-_" else f"\x00{b:02x}" if b >= 128 else f"%{b:02x}" for b in raw)
            out = re.sub(r"(?:\x00[0-9a-f]{2})+", lambda m: bytes.fromhex(m[0].replace("\x00", "")).decode("utf-8", "replace"), out)
            return out.removesuffix("_")

        return s.map(one)

    return run(c)


def file_title(c: Column) -> Column:
    """The title of a file path: last part without extension, underscores as spaces, escapes decoded."""
    stem = F.regexp_extract(c, r"([^/]*?)(?:\.[A-Za-z0-9]+)?$", 1)
    return F.url_decode(F.replace(F.translate(stem, "_", " "), F.lit("+"), F.lit("%2B")))


def short_id(c: Column, number: Column, limit: int = 120, keep: int = 110) -> Column:
    """Long ids as their beginning and a number, never cut inside an escape."""
    head = F.regexp_replace(F.substring(c, 1, keep), "%[0-9a-f]?$", "")
    return F.when(F.length(c) >= limit, F.concat(head, F.lit("__"), number.cast("string"))).otherwise(c)


def element(c: Column, name: str, attribute: str | None = None, value: str | None = None) -> Column:
    """Contents of the elements of a name in an XML or HTML string, of those with an attribute (of a value) if given."""
    has = "" if attribute is None else rf"(?=[^<>]*\b{attribute}=\"" + (r"" if value is None else rf"{value}\"") + ")"
    return F.regexp_extract_all(c, F.lit(rf"(?s)<{name}\b{has}[^<>]*>(.*?)</{name}>"), F.lit(1))


def element_attribute(c: Column, name: str, attribute: str) -> Column:
    """Values of an attribute of the elements of a name."""
    return F.regexp_extract_all(c, F.lit(rf'<{name}\b[^<>]*?\b{attribute}="([^"]*)"'), F.lit(1))


def dumped(*columns: str) -> Column:
    """A row's columns, nested ones included, as JSON with its keys in order."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def class_changes(c: Column) -> Column:
    """Runs of one kind of character (letters, digits, others) less one: high in code."""
    runs = F.regexp_extract_all(c, F.lit(r"[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    return F.greatest(F.size(runs) - 1, F.lit(0))


def is_code(c: Column) -> Column:
    return (F.length(c) > 12) & (class_changes(c) >= 4)


# Months as dates name them, and the token patterns of dates (N number, M month).
MONTHS = "January February March April May June July August September October November December Feb. Mar. Apr. Aug. Sept. Oct. Nov. Dec.".split()
DATE_SHAPES = ("N,MN", "NMN", "N,M,N", "MN,N", "MNN", "MN", "M,N", "NM", "N,M")


def token_shapes(tokens: Column) -> Column:
    """A letter for each token: N number, M month, comma for comma and semicolon, x other."""
    one = lambda t: F.when(t.isin(",", ";"), ",").when(t.isin(*MONTHS), "M").when(t.rlike("^[0-9]+(st|nd|rd|th)?$"), "N").otherwise("x")
    return F.array_join(F.transform(tokens, one), "")


def is_date(tokens: Column) -> Column:
    """Tokens that are a date, trailing commas aside."""
    return F.regexp_replace(token_shapes(tokens), ",+$", "").isin(*DATE_SHAPES)


# --- stemming --------------------------------------------------------------------------


def stem(c: Column, older: bool = False) -> Column:
    """English stems (Porter, 2001), or those of the older suffix stripping (Porter, 1980)."""
    step = stem_word_1980 if older else stem_word

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = {w: step(w) for w in s.unique() if w is not None}
        return pd.Series([known.get(w) for w in s], dtype=object)

    return run(c)
