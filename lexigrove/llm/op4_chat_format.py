"""Chat formatting with a grammar round trip, in DataFrame functions alone.

The template, for each turn in order::

    ### Assistant: text</turn>\\n

where the marker is ``### User: ``, ``### Assistant: `` or ``### System: `` for those roles
and ``### role(name): `` for any other. The parser splits a conversation at ``</turn>\\n``,
then each part at its first ``: ``, takes no text that holds ``###`` or ``</turn>``, and
reads the escape level off the marker's end:

* level 0, ``### User: ``: the text stands as it is;
* level 1, ``### User^: ``: backslash, ``##`` and ``</turn>`` in the text are escaped by a
  backslash inside (``\\\\``, ``#\\#``, ``<\\/turn>``).

Each conversation is rendered at level 0 and reparsed; if the turns differ from the source,
every turn that holds a backslash or a control string goes to level 1 and the whole is
rendered and reparsed again; if they differ still, all its turns go to level 1. A
conversation that never comes back identical fails the job.

Defined cases: null text counts as empty; null role as the role ``""``; a null turn sorts
first and turns of equal number by role and text; repeated rows are turns of their own; a
null conv_id is one conversation; a very long text is one string of its turn; an empty table
gives only what ``extra`` adds; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

END = "</turn>\n"
#: Roles with markers of their own, as the markers name them.
NAMED = {"user": "User", "assistant": "Assistant", "system": "System"}
LOSS_ROLE = "assistant"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("##"), F.lit("#\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def _unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("<\\/turn>"), F.lit("</turn>")), F.lit("#\\#"), F.lit("##"))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def _controls(text: Column) -> Column:
    return text.contains("###") | text.contains("</turn>")


def _marker(role: Column) -> Column:
    out = F.concat(F.lit("role("), F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")), F.lit("<"), F.lit("%3C")), F.lit(")"))
    for name, shown in NAMED.items():
        out = F.when(role == name, F.lit(shown)).otherwise(out)
    return out


def _role(marker: Column) -> Column:
    inner = marker.substr(F.lit(6), F.length(marker) - 6)
    out = F.replace(F.replace(F.replace(inner, F.lit("%3C"), F.lit("<")), F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))
    for name, shown in NAMED.items():
        out = F.when(marker == shown, F.lit(name)).otherwise(out)
    return out


def _render(turns: Column, level) -> Column:
    """``level``: turn -> boolean Column, whether its text is escaped."""

    def one(t: Column) -> Column:
        up = level(t)
        return F.concat(F.lit("### "), _marker(t["role"]), F.when(up, F.lit("^: ")).otherwise(F.lit(": ")), F.when(up, _escaped(t["text"])).otherwise(t["text"]), F.lit(END))

    return F.concat_ws("", F.transform(turns, one))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> of the turns; a null role where the grammar takes no text."""
    parts = F.split(formatted, "</turn>\\n", -1)
    whole = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def one(p: Column) -> Column:
        at = F.locate(": ", p)
        mark = p.substr(F.lit(5), at - 5)
        text = p.substr(at + 2, F.length(p))
        up = mark.endswith("^")
        return F.struct(
            F.when(~_controls(text), _role(F.when(up, mark.substr(F.lit(1), F.length(mark) - 1)).otherwise(mark))).alias("role"),
            F.when(up, _unescaped(text)).otherwise(text).alias("text"),
        )

    return F.transform(whole, one)


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): each conversation rendered so that it reparses to its source."""
    clean = rows.select(
        "conv_id",
        F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    told = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    told = told.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    tried = told.withColumn("formatted", _render(F.col("source"), lambda t: F.lit(False)))
    tried = tried.withColumn("turns", parse(F.col("formatted")))
    for level in (lambda t: t["text"].contains("\\") | _controls(t["text"]), lambda t: F.lit(True)):
        same = F.col("turns") == F.col("source")
        tried = tried.select("conv_id", "source", F.when(same, F.col("formatted")).otherwise(_render(F.col("source"), level)).alias("formatted"))
        tried = tried.withColumn("turns", parse(F.col("formatted")))
    same = F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("conversation does not come back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return tried.select("conv_id", "formatted", same.alias("turns"))


def digests(chats: DataFrame) -> DataFrame:
    """Digest columns, from what was read back."""
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: t["text"]))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and -7 whose texts hold control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(odd).alias("text")) for k, r in enumerate(("user", "assistant"))))).alias("t"),
    )
    return digests(format_chats(rows.unionByName(extra.select("conv_id", "t.*"))))


#: ``formatted_chars`` counts, for each turn, marker, text and end; a conversation goes to
#: level 1 as soon as one text holds ``###`` or ``</turn>``.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), told AS (
  SELECT *, CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System'
    ELSE 'role(' || replace(replace(replace(role, '%', '%25'), ':', '%3A'), '<', '%3C') || ')' END AS marker,
    bool_or(contains(text, '###') OR contains(text, '</turn>')) OVER (PARTITION BY conv_id) AS raised
  FROM rows
), levels AS (
  SELECT *, raised AND (contains(text, '\') OR contains(text, '###') OR contains(text, '</turn>')) AS up FROM told
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(marker) + 2 + up::INT + length(CASE WHEN up THEN replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') ELSE text END) + 8)::BIGINT AS formatted_chars
FROM levels GROUP BY conv_id
"""
