"""Wiki markup to document items.

``lex`` cuts a page into lexemes with one master pattern; ``build`` folds them into items
(headings, lists, links, tables, citations, references), because structure closes by what
comes later. ``parsed`` runs both over a DataFrame of pages, one page at a time; what can
be said of the items afterwards (addressing of table cells, resolution of links, balance)
is said in columns.
"""

from __future__ import annotations

import html
import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Lexeme kinds in the order in which they are tried.
RULES = [
    ("comment", r"<!--.*?(?:-->|\Z)"),
    ("redirect", r"(?i:\#REDIRECT)\b"),
    ("nowiki", r"<(?P<raw>nowiki|code|var|tt|source|syntaxhighlight)\b[^<>]*>(?P<rawtext>.{0,255}?)</(?P=raw)>"),
    ("math", r"<(?P<formula>math|chem|sup|sub)\b[^<>]*>(?P<formulatext>.{0,255}?)</(?P=formula)>"),
    ("url", r"<(?P<angle>https?://[^<>\s]+)>"),
    ("refempty", r"<ref\b[^<>]*/>"),
    ("tag", r"<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9]*)\b(?P<attrs>[^<>]{0,256})>"),
    ("tableopen", r"(?m:^)[ :]*\{\|(?P<tattrs>[^\n]*)"),
    ("tableclose", r"(?m:^)\s*\|\}(?!\})"),
    ("caption", r"(?m:^)\s*\|\+[ ]*(?:(?P<cattrs>[^\n|\[\]{}]*)\|(?!\|))?"),
    ("row", r"(?m:^)\s*\|-+(?P<rattrs>[^\n]*)"),
    ("head", r"(?m:^)\s*!(?:(?P<hattrs>[^\n|!\[\]{}]*)\|(?!\|))?"),
    ("headmore", r"!!(?:(?P<hmattrs>[^\n|!\[\]{}]*)\|(?!\|))?"),
    ("cell", r"(?m:^)\s*\|(?![|}])(?:(?P<dattrs>[^\n|\[\]{}]*)\|(?!\|))?"),
    ("cellmore", r"\|\|(?:(?P<dmattrs>[^\n|\[\]{}]*)\|(?!\|))?"),
    ("heading", r"(?m:^)(?P<level>={2,6})[ \t]*(?P<title>[^\n=](?:[^\n]*?[^\n=])?)[ \t]*(?P=level)[ \t]*(?m:$)"),
    ("list", r"(?m:^)(?P<bullets>[*#:;]+)[ \t]*"),
    ("rule", r"(?m:^)-{4,}"),
    ("link", r"\[\[(?P<target>[^\[\]|\n]{1,300})(?:\|(?P<label>[^\[\]]*))?\]\](?P<tail>[a-z]*)"),
    ("mediaopen", r"\[\[(?P<media>(?i:file|image):[^\[\]|\n]{1,300})"),
    ("mediaclose", r"\]\]"),
    ("weblink", r"\[(?P<web>(?:\w{1,6}:)?//[^\s\]]+)(?:[ \t]+(?P<weblabel>[^\]\n]*))?\]"),
    ("citeopen", r"\{\{(?P<name>[^{}|\n]{1,300})"),
    ("citeclose", r"\}\}"),
    ("bar", r"\|(?:[ \t]*(?P<key>[\w .-]{1,60}?)[ \t]*=)?"),
    ("quotes", r"'{2,5}"),
    ("bareurl", r"\bhttps?://[^\s<>\[\]|{}\"]+"),
    ("timestamp", r"\b\d{8,}T\d{4,}Z\b"),
    ("book", r"\b(?:ISBN|ASIN)[:\s]*(?P<book>[0-9A-Za-z-]{10,})|\b\d{2}\.\d{4}/\S+"),
    ("nodata", r"(?:&[\w-]+=[^\s&]*){2,}|(?P<period>[^\s\w]{1,3}?)(?P=period){7,}"),
    ("entity", r"&(?:\#\d+|\#[xX][0-9A-Fa-f]+|\w+);"),
    ("break", r"\n[ \t]*\n\s*"),
    ("string", r"\"(?P<string>[^\"<>\[\]{}|\n]{1,300})\""),
    ("quotemark", r"\""),
    ("text", r"(?:[^<\[\]{}|!'&\n\"=*#:;h\d-]|h(?!ttps?://)|[=*#:;-](?![^\s\w])|\d(?!\d{7,}T|\d\.\d{4}/))+|."),
]
MASTER = re.compile("|".join(f"(?P<k_{k}>{p})" for k, p in RULES), re.S)
ATTRIBUTE = re.compile(r"([A-Za-z][\w-]*)\s*[=:]\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s|]+))")
# Attributes that only concern looks.
VISUAL = frozenset("colwidth width color display df style leftright fullwidth cols rows image_size image size".split())
#: Attributes that make no table of a citation.
PLAIN = frozenset("class link date url id _id".split())
FORMATS = frozenset("small big u s q pre ins i p b em strong span abbr center div poem font".split())
LINKS = frozenset(("pagelink", "weblink", "filelink", "imglink", "category"))
NAMESPACES = {"file": "filelink", "image": "imglink", "category": "category"}
#: Depth from which a page is reported.
DEPTH = 12


#: Words of a text that may be no text: numbers and groups in hex, long identifiers, repeated patterns, paths.
ODD = re.compile(r"(?P<period>\S{1,3}?)(?P=period){5,}|\b[0-9A-Fa-f]+(?:-[0-9A-Fa-f]+)+\b|\b0x[0-9A-Fa-f]{6,}\b|\b[A-Za-z0-9_]{12,}\b|(?<![\w/.])(?:/[\w.-]+){2,}\.\w{1,4}\b")
DATE = re.compile(r"\d{4}-\d{2}-\d{2}|\d{2}-\d{2}-\d{4}|\d{4}-\d{2,4}|\d{1,3}-\d{1,3}")


def odd_kind(word: str) -> str | None:
    """nodata, bibref, code or path for a word that is no text; else None."""
    if len(word) >= 16 and re.fullmatch(r"(.{1,3}?)\1{5,}.{0,2}", word):
        return "nodata"
    if word[0] == "/":
        return "path"
    if "-" in word:
        return "bibref" if len(word) >= 8 and any(c.isdigit() for c in word) and not DATE.fullmatch(word) else None
    if word.startswith("0x") or len(word) >= 12 and re.fullmatch("[0-9A-Fa-f]+", word) and any(c.isdigit() for c in word):
        return "code"
    changes = len(re.findall("[A-Z]+|[a-z]+|[0-9]+|_+", word)) - 1
    return "code" if len(word) > 12 and changes >= 4 else None


def _parts(text: str) -> list[tuple[str, int, str, dict[str, str]]]:
    out, at = [], 0
    for m in ODD.finditer(text):
        if kind := odd_kind(m[0]):
            if m.start() > at:
                out.append(("text", 0, text[at : m.start()], {}))
            out.append(("weblink", 0, "", {"target": "file:" + m[0]}) if kind == "path" else (kind, 0, m[0], {}))
            at = m.end()
    return [*out, ("text", 0, text[at:], {})] if at < len(text) else out


#: Typographic dashes, quotes, apostrophes and spaces, and the plain ones that text gets.
FOLDED = str.maketrans({c: plain for signs, plain in ((T.DASHES, "-"), (T.QUOTES, '"'), (T.APOSTROPHES, "'"), (T.SPACES, " ")) for c in signs})


def attributes(text: str | None) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text or "")}


def _span(value: str | None) -> int:
    return int(value) if value and value.strip().isdigit() and 0 < int(value) < 1 << 15 else 1


def lex(page: str | None) -> list[tuple[str, int, str, dict[str, str]]]:
    """(kind, idx, value, attributes) of each lexeme; adjacent text is one."""
    out: list = []
    for m in MASTER.finditer(page or ""):
        kind, g = m.lastgroup[2:], m  # the outermost group closes last
        if kind == "comment":
            continue
        if kind == "nowiki":
            out.append(("nowiki", 0, g["rawtext"], {}))
        elif kind == "math":
            out.append(("math", 0, g["formulatext"], {}))
        elif kind == "tag":
            out.append(("close" if g["close"] else "open", 0, g["tag"].lower(), attributes(g["attrs"])))
        elif kind in ("tableopen", "row"):
            out.append((kind, 0, "", attributes(g["tattrs"] if kind == "tableopen" else g["rattrs"])))
        elif kind in ("caption", "head", "headmore", "cell", "cellmore"):
            key = {"caption": "cattrs", "head": "hattrs", "headmore": "hmattrs", "cell": "dattrs", "cellmore": "dmattrs"}[kind]
            out.append((kind, 0, "", attributes(g[key])))
        elif kind == "heading":
            out.append(("heading", len(g["level"]) - 1, g["title"], {}))
        elif kind == "list":
            out.append(("list", len(g["bullets"]), g["bullets"], {}))
        elif kind == "link":
            target = g["target"].strip().lstrip(":")
            label = (g["label"] if g["label"] is not None else target) + (g["tail"] or "")
            out.append(("char", 0, target, {}) if len(target) == 1 and g["label"] is None else ("link", 0, label, {"target": target}))
        elif kind == "mediaopen":
            out.append(("link", 0, "", {"target": g["media"].strip()}))
        elif kind == "weblink":
            web = g["web"] if ":" in g["web"].split("//")[0] else "http:" + g["web"]
            out.append(("weblink", 0, g["weblabel"] or "", {"target": web}))
        elif kind == "citeopen":
            out.append(("citeopen", 0, g["name"].strip(), {}))
        elif kind == "bar":
            out.append(("bar", 0, (g["key"] or "").strip(), {}))
        elif kind in ("url", "bareurl"):
            out.append(("weblink", 0, "", {"target": g["angle"] or m[0]}))
        elif kind == "quotes":
            out.append(("quotes", len(m[0]), m[0], {}))
        elif kind == "entity":
            text = html.unescape(m[0])
            out.append(("text", 0, "-" if text == m[0] else text, {}))
        elif kind == "string":
            out.append(("code" if T.class_runs(m["string"]) >= 5 and not re.search(r"\s", m["string"]) else "string", 0, m["string"], {}))
        elif kind == "text":
            if out and out[-1][0] == "text":
                out[-1] = ("text", 0, out[-1][2] + m[0], {})
            else:
                out.append(("text", 0, m[0], {}))
        else:
            out.append((kind, 0, m[0] if kind in ("timestamp", "book", "nodata", "redirect") else "", {}))
    return [p for x in out for p in (_parts(x[2].translate(FOLDED)) if x[0] == "text" else [x])]


class Builder:
    """Folds lexemes into items, cells and errors."""

    def __init__(self):
        self.items: list[list] = []  # type, id, text, depth, section
        self.cells: list[list] = []  # table, kind, row, col, rowspan, colspan, text
        self.errors: list[str] = []
        self.section, self.later, self.keys, self.counts = 0, [], {}, {}
        self.tables: list[dict] = []
        self.cites: list[dict] = []
        self.ref: list | None = None
        self.quote = 0

    def add(self, kind: str, text: str, ident: str = "") -> None:
        text = re.sub(r"\s+", " ", text)
        target = self.ref if self.ref is not None else self.cites[-1]["values"] if self.cites else self.tables[-1]["text"] if self.tables else None
        if target is not None:
            target.append((kind, ident, text))
            if kind in LINKS:
                self.later.append([kind, ident, text, len(self.tables) + len(self.cites), self.section])
            return
        if kind == "text":
            if self.items and self.items[-1][0] == "text" and self.items[-1][4] == self.section:
                self.items[-1][2] += text
                return
            if not text.strip():
                return
        self.items.append([kind, ident, text.strip() if kind != "text" else text, len(self.tables) + len(self.cites), self.section])

    def number(self, kind: str, key) -> str:
        """A running id; equal content has one."""
        if (kind, key) not in self.keys:
            self.counts[kind] = self.counts.get(kind, 0) + 1
            self.keys[kind, key] = f"{kind}{self.counts[kind]}"
        return self.keys[kind, key]

    def end_cell(self) -> None:
        t = self.tables[-1]
        if t["cell"] is not None:
            kind, attrs = t["cell"]
            text = "".join(x[2] for x in t["text"]).strip()
            if kind == "caption":
                self.cells.append([t["id"], "title", -1, -1, 1, 1, text])
            else:
                row, col = t["row"], t["col"]
                while (row, col) in t["used"]:
                    col += 1
                height, width = _span(attrs.get("rowspan")), _span(attrs.get("colspan"))
                t["used"] |= {(row + r, col + c) for r in range(height) for c in range(width)}
                t["col"] = col + width
                self.cells.append([t["id"], kind, row, col, height, width, text])
        t["cell"], t["text"] = None, []

    def close_table(self) -> None:
        self.end_cell()
        t = self.tables.pop()
        self.later.append(["table", t["id"], "", len(self.tables), self.section])
        self.add("tablink", "", t["id"])

    def close_citation(self) -> None:
        c = self.cites.pop()
        flat = [(k, " ".join(x[2] for x in v).strip()) for k, v in [*c["done"], (c["key"], c["values"])][1:]]
        name = c["name"].lower()
        if name in ("reflist", "nowrap") or name.startswith("reflist"):
            return
        if name in ("coord", "date", "birth date", "start date"):
            self.add("text", " ".join(v for _, v in flat))
            return
        ident = self.number("cit", (name, tuple(flat)))
        self.later.append(["citation", ident, c["name"], len(self.cites), self.section])
        for k, (key, value) in enumerate(flat):
            key = re.sub(r"\s+", "_", key.strip().lower()) or str(k)
            if key not in VISUAL:
                self.later.append(["attr", f"{ident}:{'_id' if key == 'id' else key}", value, len(self.cites) + 1, self.section])
        self.add("citlink", "", ident)

    def end_section(self) -> None:
        """Tables, citations and references stand at the end of their section, once each."""
        seen = set()
        for x in self.later:
            if x[0] in LINKS or (x[0], x[1]) not in seen:
                seen.add((x[0], x[1]))
                self.items.append(x)
        self.later = []

    def feed(self, kind: str, idx: int, value: str, attrs: dict) -> None:
        if kind == "heading":
            while self.tables:
                self.errors.append("table not closed")
                self.close_table()
            while self.cites:
                self.errors.append("citation not closed")
                self.close_citation()
            self.end_section()
            self.section += 1
            self.items.append(["heading", f"h{idx}", value.strip(), 0, self.section])
        elif kind == "tableopen":
            table = {"id": self.number("table", len(self.keys)), "row": 0, "col": 0, "used": set(), "cell": None, "text": []}
            if len(self.tables) + len(self.cites) == DEPTH:
                self.errors.append("structure too deep")
            self.tables.append(table)
        elif kind in ("row", "caption", "head", "headmore", "cell", "cellmore", "tableclose") and self.tables and not (self.cites and kind != "tableclose"):
            t = self.tables[-1]
            if kind == "tableclose":
                self.close_table()
                return
            self.end_cell()
            if kind == "row":
                t["row"], t["col"] = t["row"] + 1, 0
            else:
                was_head = kind in ("head", "headmore") or kind == "cellmore" and t.get("last") == "head"
                t["cell"] = ("caption" if kind == "caption" else "head" if was_head else "cell", attrs)
                t["last"] = t["cell"][0]
        elif kind == "citeopen":
            if value.lower().startswith("not a typo"):
                self.cites.append({"name": "coord", "key": None, "values": [], "done": []})
            else:
                self.cites.append({"name": value, "key": None, "values": [], "done": []})
        elif kind == "citeclose":
            if self.cites:
                self.close_citation()
            else:
                self.errors.append("unexpected end of citation")
        elif kind in ("bar", "cell", "cellmore") and self.cites:
            c = self.cites[-1]
            c["done"].append((c["key"], c["values"]))
            c["key"], c["values"] = value, []
        elif kind == "open" and value in ("ref", "cite"):
            if self.ref is None:
                self.ref = []
        elif kind == "close" and value in ("ref", "cite"):
            if self.ref is not None:
                text, self.ref = " ".join(x[2] or x[1] for x in self.ref).strip(), None
                ident = self.number("ref", text)
                self.later.append(["ref", ident, text, 0, self.section])
                self.add("reflink", "", ident)
        elif kind == "link":
            base, _, anchor = attrs["target"].partition("#")
            space = base.split(":", 1)[0].lower() if ":" in base else ""
            name = base.split(":", 1)[1] if space in NAMESPACES or space == "wikipedia" else base
            self.add(NAMESPACES.get(space, "pagelink"), value, name.strip() or anchor)
        elif kind == "weblink":
            self.add("weblink", value, attrs["target"])
        elif kind == "list":
            self.add("list", "", f"l{idx}")
        elif kind == "quotes":
            self.quote = 0 if self.quote else idx
        elif kind in ("string", "quotemark"):
            self.add("text", f'"{value}"' if kind == "string" else '"')
        elif kind in ("nowiki", "math", "char", "timestamp", "book", "bibref", "code"):
            self.add({"timestamp": "time", "book": "bibref"}.get(kind, kind), value)
        elif kind in ("break", "rule") or kind in ("open", "close") and value in ("br", "hr", "ol", "ul", "li"):
            self.add("br", "")
        elif kind == "text" or kind in ("bar", "head", "headmore", "cell", "cellmore", "caption", "row"):
            self.add("text", value if kind == "text" else " ")
        elif kind == "nodata" or kind in ("open", "close") and value in FORMATS or kind in ("refempty", "redirect", "tableclose", "mediaclose"):
            pass
        elif kind in ("open", "close"):
            self.add("br", "")

    def finish(self) -> "Builder":
        while self.tables:
            self.errors.append("table not closed")
            self.close_table()
        while self.cites:
            self.errors.append("citation not closed")
            self.close_citation()
        if self.ref is not None:
            self.errors.append("reference not closed")
            self.feed("close", 0, "ref", {})
        self.end_section()
        return self


def build(page: str | None) -> Builder:
    b = Builder()
    for x in lex(page):
        b.feed(*x)
    return b.finish()


def dealt(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, text) dealt over tasks: a small file with many rows is one split of the reader, and lexing takes far longer than reading."""
    tasks = 4 * pages.sparkSession.sparkContext.defaultParallelism
    return pages.select("doc_id", "text").repartition(max(32, tasks), "doc_id")


PARSED = "doc_id long, items array<struct<type: string, id: string, text: string, depth: int, section: int>>, cells array<struct<table_id: string, kind: string, row: int, col: int, rowspan: int, colspan: int, text: string>>, errors array<string>"


def parsed(pages: DataFrame) -> DataFrame:
    """(doc_id, items, cells, errors) of pages (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        item = pa.struct([("type", pa.string()), ("id", pa.string()), ("text", pa.string()), ("depth", pa.int32()), ("section", pa.int32())])
        cell = pa.struct([("table_id", pa.string()), ("kind", pa.string()), *((n, pa.int32()) for n in ("row", "col", "rowspan", "colspan")), ("text", pa.string())])
        def rows(xs, t):
            flat = list(zip(*(x for one in xs for x in one), strict=True)) or [[]] * t.num_fields
            held = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, t, strict=True)], fields=list(t))
            return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, xs))], pa.int32()), held)

        for b in batches:
            built = [build(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), rows([x.items for x in built], item), rows([x.cells for x in built], cell), pa.array([x.errors for x in built], pa.list_(pa.string()))], ["doc_id", "items", "cells", "errors"])

    return dealt(pages).mapInArrow(run, PARSED)


LEXEMES = "doc_id long, seq int, kind string, idx int, value string, attrs map<string, string>"


def lexemes(pages: DataFrame) -> DataFrame:
    """One row for each lexeme of pages (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(d, k, *x) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for k, x in enumerate(lex(t))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())]
            cols = [[list(x.items()) for x in c] if k == 5 else c for k, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "seq", "kind", "idx", "value", "attrs"])

    return dealt(pages).mapInArrow(run, LEXEMES)


def items(done: DataFrame) -> DataFrame:
    return done.select("doc_id", F.posexplode("items").alias("seq", "i")).select("doc_id", "seq", "i.*")


def cells(done: DataFrame) -> DataFrame:
    return done.select("doc_id", F.posexplode("cells").alias("seq", "c")).select("doc_id", "seq", "c.*")


# --- over items and cells, in columns ----------------------------------------------------


def addressed(grid: DataFrame) -> DataFrame:
    """Cells with ``address``: heads of rows without data as C<col>, other heads as R<row>, data as both."""
    by_row = W.partitionBy("doc_id", "table_id", "row")
    data = F.max((F.col("kind") == "cell").cast("int")).over(by_row) == 1
    span = lambda letter, first, n: F.transform(F.sequence(F.col(first), F.col(first) + F.col(n) - 1), lambda i: F.concat(F.lit(letter), i.cast("string")))
    columns, rows = span("C", "col", "colspan"), span("R", "row", "rowspan")
    address = F.when(F.col("kind") == "title", F.array().cast("array<string>")).when((F.col("kind") == "head") & ~data, columns).when(F.col("kind") == "head", rows).otherwise(F.concat(columns, rows))
    return grid.withColumn("address", address)


def head_pairs(grid: DataFrame) -> DataFrame:
    """(doc_id, table_id, head, cell): data cells with the heads whose address they share."""
    told = addressed(grid).select("doc_id", "table_id", "kind", "row", "col", "text", F.explode("address").alias("at"))
    heads = told.filter("kind = 'head'").select("doc_id", "table_id", "at", F.col("text").alias("head"))
    return told.filter("kind = 'cell'").join(heads, ["doc_id", "table_id", "at"]).select("doc_id", "table_id", "row", "col", "head", F.col("text").alias("cell"))


def linked_tables(done: DataFrame) -> DataFrame:
    """Links to tables, citations and references with what they link to."""
    kinds = F.create_map(*map(F.lit, ("tablink", "table", "citlink", "citation", "reflink", "ref")))
    of_link, is_end = F.element_at(kinds, F.col("type")), F.col("type").isin("table", "citation", "ref")
    # one pass over the pages, both sides met by a shuffle: their size can't be told from that of the pages
    it = items(done).withColumn("kind", F.when(is_end, F.col("type")).otherwise(of_link)).filter("kind is not null")
    by_key = it.groupBy("doc_id", F.col("id").alias("ident"), "kind").agg(
        F.collect_list(F.when(~is_end, F.col("seq"))).alias("links"), F.collect_list(F.when(is_end, F.struct(F.col("seq").alias("item_seq"), "text"))).alias("ends")
    )
    links = by_key.select("doc_id", "ident", "kind", F.explode("links").alias("link_seq"), "ends")
    return links.select("doc_id", "ident", "kind", "link_seq", F.explode("ends").alias("e")).select("doc_id", "ident", "kind", "link_seq", "e.*")


def balance(marks: DataFrame) -> DataFrame:
    """(doc_id, balanced, max_depth) from opening (+1) and closing (-1) marks (doc_id, seq, step)."""
    depth = F.sum("step").over(W.partitionBy("doc_id").orderBy("seq"))
    run = marks.withColumn("_depth", depth).groupBy("doc_id").agg(F.min("_depth").alias("low"), F.sum("step").alias("rest"), F.max("_depth").alias("max_depth"))
    return run.select("doc_id", ((F.col("low") >= 0) & (F.col("rest") == 0)).alias("balanced"), "max_depth")


def deduplicated(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each content key, with the number of its copies."""
    keyed = rows.withColumn("_key", F.sha2(F.concat_ws("\x01", *keys), 256))
    # rows travel only if they are kept: the least of each key is found first
    least = keyed.groupBy("_key").agg(F.min(order).alias(order), F.count("*").alias("copies"))
    return keyed.join(least, ["_key", order]).dropDuplicates(["_key"]).select(*rows.columns, "copies")


def citation_class(name: Column) -> Column:
    n = F.lower(F.trim(name))
    return (
        F.when(n.startswith("infobox"), "infobox").when(n.startswith("cite "), "cite").when(n.contains("wikitable"), "table").when(n.isin("coord", "date", "birth date", "start date"), "text")
        .when(n.contains("isbn"), "isbn").when(n.startswith("aligned table"), "aligned").when(n.isin("ordered list", "unordered list"), "list").when(n.startswith("reflist") | (n == "nowrap"), "ignore").otherwise("text")
    )


def pivoted(attributes_: DataFrame) -> DataFrame:
    """Citation attributes (doc_id, cit, seq, key, value) as heads and cells C<i> in their order, visual ones left out.

    Only citations with an attribute beyond class, link, date, URL and id become tables."""
    kept = attributes_.filter(~F.lower("key").isin(*VISUAL))
    whole, w = W.partitionBy("doc_id", "cit"), W.partitionBy("doc_id", "cit").orderBy("seq")
    told = kept.withColumn("_more", F.max((~F.lower("key").isin(*PLAIN)).cast("int")).over(whole)).filter("_more = 1")
    return told.withColumn("at", F.concat(F.lit("C"), (F.row_number().over(w) - 1).cast("string"))).select("doc_id", "cit", "at", F.col("key").alias("head"), F.col("value").alias("cell"))


def folded(attributes_: DataFrame, longest: int = 80, longest_id: int = 200) -> DataFrame:
    """(doc_id, owner, key, value, inline): values of one attribute joined by commas in order; short ones without line breaks may stand in a tag."""
    rows = attributes_.groupBy("doc_id", "owner", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda r: r["value"]), ",").alias("value"))
    limit = F.when(F.col("key").isin("id", "_id"), longest_id).otherwise(longest)
    return rows.withColumn("inline", (F.length("value") <= limit) & ~F.col("value").contains("\n"))


def xml_of(items_: DataFrame, root: str = "doc") -> DataFrame:
    """(doc_id, xml): a document's items as elements in order, their ids as attributes."""
    ident = F.when(F.coalesce("id", F.lit("")) == "", "").otherwise(F.concat(F.lit(' id="'), T.escape_xml(F.col("id")), F.lit('"')))
    body = T.escape_xml(F.coalesce("text", F.lit("")))
    one = F.when(body == "", F.concat(F.lit("<"), F.col("type"), ident, F.lit("/>"))).otherwise(F.concat(F.lit("<"), F.col("type"), ident, F.lit(">"), body, F.lit("</"), F.col("type"), F.lit(">")))
    rows = items_.select("doc_id", F.struct("seq", one.alias("x")).alias("r")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), "").alias("x"))
    return rows.select("doc_id", F.concat(F.lit(f"<{root}>"), F.col("x"), F.lit(f"</{root}>")).alias("xml"))


def attribute_name(c: Column) -> Column:
    n = F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")
    return F.when(n == "id", "_id").otherwise(n)


def strange(items_: DataFrame) -> DataFrame:
    """Texts with remnants of layout, or long runs that change class often."""
    remnant = F.col("text").rlike(r"(?i)\b(bgcolor|align|width|style|class)\s*[=:]")
    runs = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))
    return items_.filter(remnant | F.exists(runs, lambda r: F.length(r) * T.class_changes(r) > 48))


# --- HTML pages --------------------------------------------------------------------------


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, target) of anchors in page order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "target"))


def html_outline(pages: DataFrame) -> DataFrame:
    """(page_id, pos, level, title) of headings."""
    found = F.regexp_extract_all("html", F.lit("<h([1-6])[^>]*>([^<]*)</h[1-6]>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "h"))
    return rows.select("page_id", "pos", F.regexp_extract("h", "<h([1-6])", 1).cast("int").alias("level"), T.decode_xml(F.regexp_extract("h", ">([^<]*)<", 1)).alias("title"))
