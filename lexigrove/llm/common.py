"""What the operators share: table access, shared folders, word hashes."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contract, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; on one machine without a name, one under the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def stored(df: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, column: str, size: int = 16_000_000, rows: int = 500):
    """Record batches in slices of a few rows and bytes of a column (one row at least), so that what is built for each stays small."""
    import pyarrow.compute as pc

    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        at = 0
        while at < b.num_rows:
            end, held = at, 0
            while end < b.num_rows and end - at < rows and (end == at or held + lengths[end] <= size):
                held += lengths[end]
                end += 1
            yield b.slice(at, end - at)
            at = end


#: Rows that a join sends to every executor, at most.
SENT_ROWS = 10_000
#: A key of more than one in so many rows is a heavy one.
HEAVY = 2000


def joined(rows: DataFrame, found: DataFrame, keys: list[str], size: str, total: int, how: str = "inner", n_found: int | None = None) -> DataFrame:
    """Rows with the one row of ``found`` for each key, without ``size``, the number of rows that have it.

    A table of up to SENT_ROWS rows (counted, unless ``n_found`` is given) goes to all executors. Of a longer one, the rows
    of heavy keys do, and there are fewer than HEAVY of them; all others meet their rows by
    a shuffle, where no key has more than 1 / HEAVY of the ``total`` rows."""
    if (found.count() if n_found is None else n_found) <= SENT_ROWS:
        return rows.join(F.broadcast(found.drop(size)), keys, how)
    heavy = found.filter(F.col(size) > F.lit(total / HEAVY)).drop(size)
    light = found.filter(F.col(size) <= F.lit(total / HEAVY)).drop(size)
    hot = rows.join(F.broadcast(heavy), keys)
    cold = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return hot.unionByName(cold)
