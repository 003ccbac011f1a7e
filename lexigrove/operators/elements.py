"""Elements of XML and HTML columns by interval labels, and selectors as structural joins.

A document's tags and texts are events, numbered in order. An element has the numbers of its
opening and closing tag (start, end), its depth and its parent's start; all come from windows
over a document's events, none from a nested loop over elements:

* Tags of one name are paired by their level within that name, so nested elements of equal
  names find their own ends. Elements that are never closed, void ones and ``<x/>`` are empty.
* A step to descendants keeps the elements during which some selected one is open (a running
  sum of starts and ends); a step to children joins on the parent.

Contents of comments, scripts and styles are no events.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENT = r"<[/]?[A-Za-z][^<>]*>|[^<]+"
SILENT = r"(?is)<!--.*?-->|<script\b.*?</script[^<>]*>|<style\b.*?</style[^<>]*>"
#: HTML's elements without content: fixed values.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
ATTRIBUTE = r"([A-Za-z_:][\w:.-]*)\s*=\s*\"([^\"]*)\""
#: A step of a selector: child or descendant, names, and attributes that must have a value.
STEP = re.compile(r"(//?)(\{[^{}]+\}|[\w:.-]+)((?:\[@[\w:.-]+='[^']*'\])*)")


def events(docs: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """(key, seq, raw, name, kind): tags (kind 1 opening, -1 closing, 0 empty) and texts (kind null)."""
    raws = F.regexp_extract_all(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), SILENT, ""), F.lit(EVENT), F.lit(0))
    told = docs.select(key, F.posexplode(raws).alias("seq", "raw"))
    name = F.lower(F.regexp_extract("raw", r"^<[/]?([A-Za-z][\w:.-]*)", 1))
    told = told.withColumn("name", F.when(F.col("raw").startswith("<"), name))
    kind = F.when(F.col("name").isNull(), F.lit(None)).when(F.col("raw").startswith("</"), -1).when(F.col("raw").endswith("/>") | F.col("name").isin(*VOID), 0).otherwise(1)
    return told.withColumn("kind", kind)


def elements(told: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end, depth, parent, name, keys, values) of every element of ``events``; a root's parent is null."""
    tags = told.filter("kind is not null")
    within = W.partitionBy(key, "name").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    level = F.sum("kind").over(within) + F.when(F.col("kind") == -1, 1).otherwise(0)
    leveled = tags.withColumn("level", level)
    after = W.partitionBy(key, "name", "level", F.col("kind") == 0).orderBy("seq")
    closed = F.when((F.col("kind") == 1) & (F.lead("kind").over(after) == -1), F.lead("seq").over(after)).otherwise(F.col("seq"))
    opened = leveled.withColumn("end", closed).filter("kind >= 0").select(key, F.col("seq").alias("start"), "end", "name", "raw")
    # depth: elements open at a start
    marks = opened.select(key, F.col("start").alias("seq"), (F.col("end") > F.col("start")).cast("int").alias("step"), "start", "end", "name", "raw")
    ends = opened.filter("end > start").select(key, F.col("end").alias("seq"), F.lit(-1).alias("step"))
    so_far = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    deep = marks.unionByName(ends, allowMissingColumns=True).withColumn("depth", F.sum("step").over(so_far) + (F.col("step") == 0).cast("int")).filter("start is not null")
    # parent: the last element one level up that began before
    level_up = W.partitionBy(key, "depth").orderBy("start", "above").rowsBetween(W.unboundedPreceding, 0)
    both = deep.select(key, "start", "end", "name", "raw", "depth", F.lit(1).alias("above")).unionByName(deep.select(key, "start", (F.col("depth") + 1).alias("depth"), F.lit(0).alias("above")), allowMissingColumns=True)
    found = both.withColumn("parent", F.last(F.when(F.col("above") == 0, F.col("start")), ignorenulls=True).over(level_up)).filter("above = 1")
    parts = [F.regexp_extract_all("raw", F.lit(ATTRIBUTE), F.lit(k)) for k in (1, 2)]
    return found.select(key, "start", "end", F.col("depth").cast("int").alias("depth"), "parent", "name", F.transform(parts[0], F.lower).alias("keys"), parts[1].alias("values"))


def value_of(attribute: str) -> Column:
    """An element's attribute, null without it."""
    return F.get("values", (F.array_position("keys", attribute.lower()) - 1).cast("int"))


def descendants(chosen: DataFrame, some: DataFrame, key: str = "doc_id") -> DataFrame:
    """The elements of ``some`` that lie within a chosen one."""
    spans = chosen.filter("end > start")
    steps = spans.select(key, F.col("start").alias("at"), F.lit(1).alias("step")).unionByName(spans.select(key, F.col("end").alias("at"), F.lit(-1).alias("step")))
    own = some.select("*", F.col("start").alias("at"), F.lit(0).alias("step"), F.lit(True).alias("here"))
    # an element's own row comes before the step at its start
    open_now = W.partitionBy(key).orderBy("at", F.col("here").isNull()).rowsBetween(W.unboundedPreceding, 0)
    return own.unionByName(steps, allowMissingColumns=True).withColumn("open", F.sum("step").over(open_now)).filter("here and open > 0").select(*some.columns)


def children(chosen: DataFrame, some: DataFrame, key: str = "doc_id") -> DataFrame:
    """The elements of ``some`` whose parent is a chosen one."""
    return some.join(chosen.select(key, F.col("start").alias("parent")), [key, "parent"], "left_semi").select(*some.columns)


def selected(every: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """The elements of a path: ``/a/b``, ``//a``, ``{a,b}`` for one of several names, ``[@k='v']`` for an attribute's value."""
    steps = STEP.findall(path)
    if "".join(map("".join, steps)) != path or not steps:
        raise ValueError(f"no selector: {path}")
    chosen = None
    for axis, names, having in steps:
        some = every.filter(F.col("name").isin(*(n.strip().lower() for n in names.strip("{}").split(","))))
        for k, v in re.findall(r"\[@([\w:.-]+)='([^']*)'\]", having):
            some = some.filter(value_of(k) == v)
        if chosen is None:
            chosen = some.filter("depth = 1") if axis == "/" else some
        else:
            chosen = (children if axis == "/" else descendants)(chosen, some, key)
    return chosen


def contents(chosen: DataFrame, told: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end, text): all text within each chosen element, white space as one space.

    Texts meet the elements of their document that are open there; so do elements within others."""
    texts = told.filter("name is null").select(key, F.col("seq").alias("at"), F.col("raw"))
    inside = chosen.select(key, "start", "end").join(texts, key).filter((F.col("at") > F.col("start")) & (F.col("at") < F.col("end")))
    joined = inside.groupBy(key, "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda t: t["raw"]), "").alias("text"))
    every = chosen.select(key, "start", "end").join(joined, [key, "start", "end"], "left")
    return every.select(key, "start", "end", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\r\n\f]+", " ")).alias("text"))
