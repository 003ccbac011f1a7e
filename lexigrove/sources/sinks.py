"""Sinks: postings tables, tab-separated dumps, training text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_redirects(redirects: DataFrame, path: str) -> None:
    redirects.select(F.concat_ws("\t", "key", "target").alias("value")).write.mode("overwrite").text(path)


def write_kinds(done: DataFrame, path: str, kinds: dict[str, Column], per_folder: int = 1000, counter: str = "doc_id") -> None:
    """One Parquet dataset a kind, in folders of so many documents by their counter, named by four digits."""
    for name, column in kinds.items():
        done.select("doc_id", column.alias("content"), F.lpad(F.floor(F.col(counter) / per_folder).cast("string"), 4, "0").alias("folder")).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/{name}")


def write_tagged(tagged: DataFrame, path: str, complete: bool = False) -> None:
    """Tab-separated rows: tag, value, reference; with roles if complete."""
    columns = (["role", "cls"] if complete else ["cls"]) + ["value", "ref"]
    tagged.select("doc_id", "sent", "seq", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns)).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "sent", "seq").write.mode("overwrite").csv(path, sep="\t", quote="")


def write_tagged_stream(tagged: DataFrame, names: DataFrame, path: str) -> None:
    """Documents in order, each with a header line ``#FILE#name`` (doc_id, file), then tag, value and reference of its tokens, tab-separated."""
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("cls", "value", "ref")))
    rows = tagged.select("doc_id", "sent", "seq", line.alias("line"))
    heads = names.select("doc_id", F.lit(-1).alias("sent"), F.lit(-1).cast("long").alias("seq"), F.concat(F.lit("#FILE#"), "file").alias("line"))
    whole = rows.unionByName(heads).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "sent", "seq")
    whole.select("line").write.mode("overwrite").text(path)


def write_stream(texts: DataFrame, path: str) -> None:
    """Texts (file, content) as a stream: a header line ``#FILE#name``, then the content."""
    texts.select(F.concat(F.lit("#FILE#"), F.col("file"), F.lit("\n"), F.col("content")).alias("value")).write.mode("overwrite").text(path)


def write_postings(postings: DataFrame, table: str, buckets: int) -> None:
    """A table partitioned by feature type and bucketed by value, so lookups and joins on value shuffle nothing."""
    postings.write.mode("overwrite").partitionBy("type").bucketBy(buckets, "value").sortBy("value", "doc_id", "pos").saveAsTable(table)


def training_lines(tagged: DataFrame, end: str = " .", last: str = "........") -> DataFrame:
    """(doc_id, line): typed tokens of a document, part marks as commas, sentence ends as points, and the mark of its end."""
    token = F.when(F.col("cls") == "P!", ",").when(F.col("cls") == "T!", end).when(F.col("cls") == "", F.col("value")).otherwise(F.concat(F.col("cls"), F.lit("#"), F.regexp_replace("value", r"\s+", "_")))
    rows = tagged.select("doc_id", F.struct("sent", "seq", token.alias("t")).alias("r"))
    return rows.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), " "), F.lit(f" {last}")).alias("line"))


def link_dump(links: DataFrame) -> DataFrame:
    """(title, line): ``*title = a;b;`` of linked titles in order."""
    rows = links.groupBy("title").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "link"))), lambda r: r["link"]).alias("ls"))
    return rows.select("title", F.concat(F.lit("*"), F.col("title"), F.lit(" = "), F.array_join("ls", ";"), F.lit(";")).alias("line"))
