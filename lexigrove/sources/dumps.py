"""Sources: page dumps, redirect files, multi-document text streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T

PAGE = T_.StructType([
    T_.StructField("title", T_.StringType()), T_.StructField("ns", T_.IntegerType()),
    T_.StructField("redirect", T_.StructType([T_.StructField("_title", T_.StringType())])),
    T_.StructField("revision", T_.StructType([T_.StructField("text", T_.StringType())])),
])
#: Redirect pages are shorter than this many bytes.
REDIRECT_BYTES = 1000


def pages(spark: SparkSession, path: str, namespaces: list[int] | None = None, title_contains: list[str] | None = None) -> DataFrame:
    """(ns, title, redirect_title, text) of a page dump in XML, filtered at the scan."""
    df = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    df = df.select("ns", F.col("title"), F.coalesce("redirect._title", F.lit("")).alias("redirect_title"), F.coalesce("revision.text", F.lit("")).alias("text"))
    if namespaces:
        df = df.filter(F.col("ns").isin(*namespaces))
    if title_contains:
        hit = F.lit(False)
        for part in title_contains:
            hit = hit | F.col("title").contains(part)
        df = df.filter(hit)
    return df


def classified(df: DataFrame) -> DataFrame:
    """With ``kind``: redirect, document, empty or invalid."""
    title, text = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    kind = F.when((F.coalesce("redirect_title", F.lit("")) != "") & (F.octet_length(text) < REDIRECT_BYTES), "redirect").when((title != "") & (text != ""), "document").when(title != "", "empty").otherwise("invalid")
    return df.withColumn("kind", kind)


def redirects(spark: SparkSession, path: str) -> DataFrame:
    """(key, target) of a tab-separated file; a line without a tab fails the job."""
    lines = spark.read.text(path).filter("value <> ''")
    parts = F.split("value", "\t", 2)
    told = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("no tab in redirect: "), F.col("value"))))
    return lines.select(told.alias("p")).select(F.col("p")[0].alias("key"), F.col("p")[1].alias("target"))


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """(file, entities array<struct<name, alias>>, content) of ``#FILE#`` streams, split at the scan."""
    parts = spark.read.option("lineSep", "#FILE#").text(path).filter("trim(value) <> ''")
    lines = F.split("value", "\r?\n")
    heads = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.startswith("##"))
    entity = lambda x: F.struct(F.split(F.substring(x, 3, 1 << 20), "##")[0].alias("name"), F.get(F.split(F.substring(x, 3, 1 << 20), "##"), F.lit(1)).alias("alias"))
    body = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~x.startswith("##"))
    return parts.select(F.trim(lines[0]).alias("file"), F.transform(heads, entity).alias("entities"), F.regexp_replace(F.array_join(body, "\n"), r"^\s+|\s+$", "").alias("content"))


def malformed(spark: SparkSession, path: str, row_tag: str = "page") -> DataFrame:
    """Records of a dump that are not well formed."""
    schema = T_.StructType([*PAGE.fields, T_.StructField("_corrupt_record", T_.StringType())])
    df = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").schema(schema).load(path)
    return df.filter("_corrupt_record is not null").select("_corrupt_record")


def metadata_added(docs: DataFrame, name: str, kind: str, default=0) -> DataFrame:
    """Documents with a new metadata column of a type; a name that is there fails."""
    if name in docs.columns:
        raise ValueError(f"metadata column is there: {name}")
    return docs.withColumn(name, F.lit(default).cast(kind))


def metadata_joined(docs: DataFrame, values: DataFrame, key: str, name: str, default=0.0) -> DataFrame:
    """Documents with a metadata column from a keyed table."""
    one = values.select(F.col(key), F.col(name).alias("_new")).dropDuplicates([key])
    return docs.drop(name).join(one, key, "left").withColumn(name, F.coalesce("_new", F.lit(default))).drop("_new")


#: Fixed value: the form of dates with a time in content statistics.
DATE_TIME = r"[0-9]{1,2}[\-][A-Z]+[\-][0-9]{2,4}\s{0,2}[0-9\.\:]+"


@dataclass(frozen=True)
class Element:
    """A class of values: a pattern of the whole value, and how many tokens it has. Of several that fit, the one of greatest priority counts, then the first."""

    name: str
    pattern: str = ".*"
    priority: int = 0
    least: int = 1
    most: int | None = None
    tokenizer: Callable[[Column], Column] = T.words


def path_classes(rows: DataFrame, elements: list[Element]) -> DataFrame:
    """(path, class, n, n_distinct): the values of each tag path by class; those that fit no class are ``other``."""
    value, kind = F.col("value"), F.lit("other")
    # what counts more is tried later and takes over
    for _, _, e in sorted((e.priority, -k, e) for k, e in enumerate(elements)):
        n = F.size(e.tokenizer(value))
        kind = F.when(value.rlike(rf"(?s)\A(?:{e.pattern})\z") & (n >= e.least) & (n <= (1 << 30 if e.most is None else e.most)), e.name).otherwise(kind)
    return rows.groupBy("path", kind.alias("class")).agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_distinct"))


def path_statistics(rows: DataFrame, classes: list[tuple[str, str]], least: int = 0, most: int = 1 << 30) -> DataFrame:
    """(path, class, n, n_distinct): values of each tag path by the first pattern they match."""
    kind = F.lit("other")
    for name, pattern in reversed(classes):
        kind = F.when(F.col("value").rlike(pattern), name).otherwise(kind)
    sized = rows.filter(F.length("value").between(least, most))
    return sized.groupBy("path", kind.alias("class")).agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_distinct"))


def tagged_stream(spark: SparkSession, path: str) -> DataFrame:
    """(file, cls, value, ref) of a tagged stream: a header ``#FILE#name`` for each document, then a line of tab-separated fields for each token.

    A document is a record of the reader, which cuts files at headers, so streams are read in many tasks."""
    records = spark.read.option("lineSep", "#FILE#").text(path).filter("value <> ''")
    lines = F.split("value", "\n")
    told = records.select(lines[0].alias("file"), F.explode(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: x != "")).alias("l"))
    part = F.split("l", "\t", -1)
    return told.select("file", part[0].alias("cls"), part[1].alias("value"), part[2].alias("ref"))


def _fragments(dim: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            raws = b.column("raw").to_pylist()
            whole = [(at := r.find(b" ")) > 0 and len(r) == at + 1 + 4 * dim for r in raws]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("file", "block", "row")), pa.array(whole), b.column("raw")], ["file", "block", "row", "whole", "raw"])

    return run


def _vectors(dim: int):
    def rows(raw: bytes):
        """Names and vectors of records that stand one after another, a line feed behind each."""
        at = 0
        while at < len(raw):
            end = raw.index(b" ", at)
            yield raw[at:end].decode("utf-8", "replace"), raw[end + 1 : end + 1 + 4 * dim]
            at = end + 2 + 4 * dim

    def table(parts):
        import numpy as np
        import pyarrow as pa

        found = [r for raw in parts for r in rows(raw)]
        flat = np.frombuffer(b"".join(v for _, v in found), "<f4")
        return pa.table({"name": pa.array([n for n, _ in found], pa.string()), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * dim, pa.int32()), pa.array(flat, pa.float32()))})

    def whole(batches):
        for b in batches:
            yield from table(b.column("raw").to_pylist()).to_batches()

    def broken(run):
        return table([b"\n".join(run.sort_by([("block", "ascending"), ("row", "ascending")]).column("raw").to_pylist())])

    return whole, broken


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(name, embedding) of vector files in the binary form of word2vec: a header line of count and
    dimension, then for each word its name, a space, little-endian floats, and a line feed.

    Files are read in lines, so by many tasks however long they are. A line that holds a name, a
    space and all floats is a record; no other line is as long as these, for floats that hold a
    line feed cut their record into shorter ones. Such lines between two whole records are put
    together again, over the ends of the reader's blocks as well. All files have one dimension."""
    lines = spark.read.option("lineSep", "\n").text(path)
    first = lines.first()
    dim = int(first["value"].split()[1]) if first else 1
    raw = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("raw"))
    told = raw.mapInArrow(_fragments(dim), "file string, block long, row long, whole boolean, raw binary")
    whole, broken = _vectors(dim)
    schema = "name string, embedding array<float>"
    # how many whole records stand before a line numbers the run of broken ones that it is in
    narrow = told.select("file", "block", "row", "whole", F.when(~F.col("whole"), F.col("raw")).alias("raw"))
    in_block = W.partitionBy("file", "block").orderBy("row")
    counted = narrow.withColumns({"_own": F.sum(F.col("whole").cast("long")).over(in_block), "_n": F.row_number().over(in_block)})
    blocks = told.groupBy("file", "block").agg(F.sum(F.col("whole").cast("long")).alias("_all"))
    before = blocks.select("file", "block", (F.sum("_all").over(W.partitionBy("file").orderBy("block")) - F.col("_all")).alias("_before"))  # a row for each block
    left = counted.filter(~F.col("whole") & ~((F.col("block") == 0) & (F.col("_n") == 1))).join(before, ["file", "block"])
    runs = left.select("file", (F.col("_before") + F.col("_own")).alias("run"), "block", "row", "raw").groupBy("file", "run").applyInArrow(broken, schema)
    return told.filter("whole").select("raw").mapInArrow(whole, schema).unionByName(runs)


def write_word_vectors(vectors: DataFrame, path: str, dim: int) -> None:
    """Files of (name, embedding) as ``word_vectors`` reads them, each with its header; names hold no white space."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        records = [name.encode() + b" " + np.array(v, "<f4").tobytes() for b in batches for name, v in zip(b.column("name").to_pylist(), b.column("embedding").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([f"{len(records)} {dim}".encode(), *records], pa.binary())], ["raw"])

    vectors.select("name", "embedding").mapInArrow(run, "raw binary").select(F.col("raw").cast("string").alias("value")).write.text(path)


def statistics_changes(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """(value, change): all df (+) of a new state, all (-) of one withdrawn, or what changed between two."""
    if before is None:
        return after.select("value", F.col("df").alias("change"))
    if after is None:
        return before.select("value", (-F.col("df")).alias("change"))
    both = after.select("value", F.col("df").alias("change")).unionByName(before.select("value", (-F.col("df")).alias("change")))
    return both.groupBy("value").agg(F.sum("change").alias("change")).filter("change <> 0")
