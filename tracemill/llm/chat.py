"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted by (turn, role, text). An array aggregation
merges neighbours of one role into a message that keeps the texts of its turns apart by a mark, and the
messages are concatenated. Control strings inside roles and texts are escaped reversibly, so that the
formatted string can be parsed back without loss.

Defined results: a null role or text counts as empty; repeated rows stay repeated turns; equal turn
numbers are ordered by role, then text, null turns first; rows with a null conversation id form one
conversation; an empty table gives an empty result. Columns beside the four are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, SAYS, NEXT, DONE = "<|turn|>", "<|says|>", "<|next|>", "<|done|>"
#: Strings that no role or text may carry unescaped: the marks above and those of other common templates.
CONTROLS = (OPEN, SAYS, NEXT, DONE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"


def escape(col: Column) -> Column:
    """Double each backslash, then break each control string by a backslash after its first character."""
    col = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROLS:
        col = F.replace(col, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return col


def unescape(col: Column) -> Column:
    """A backslash stands for the character after it, read from left to right."""
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def _pieces(message: Column) -> Column:
    """A merged message as pieces with a flag for the loss mask."""
    off = F.lit(False)
    loss = message["role"] == LOSS_ROLE
    head = F.struct(F.concat(F.lit(OPEN), escape(message["role"]), F.lit(SAYS)).alias("s"), off.alias("loss"))
    texts = F.transform(
        message["texts"],
        lambda t, i: F.array(
            F.struct(F.when(i == 0, "").otherwise(NEXT).alias("s"), off.alias("loss")),
            F.struct(escape(t).alias("s"), loss.alias("loss")),
        ),
    )
    return F.concat(F.array(head), F.flatten(texts), F.array(F.struct(F.lit(DONE).alias("s"), off.alias("loss"))))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted (string), loss_spans (array of start and length in code points of the formatted string)."""
    empty = F.lit("")
    rows = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"),
    )
    message = "array<struct<role:string,texts:array<string>>>"

    def merge(acc: Column, t: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        alone = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        return F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["role"] == t["role"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)),
        ).otherwise(F.concat(acc, F.array(alone)))

    merged = F.aggregate("turns", F.array().cast(message), merge)

    def span(acc: Column, p: Column) -> Column:
        n = F.char_length(p["s"])
        here = F.array(F.struct(acc["at"].alias("start"), n.alias("length")))
        spans = F.when(p["loss"], F.concat(acc["spans"], here)).otherwise(acc["spans"])
        return F.struct((acc["at"] + n).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return (
        rows.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
        .select("conv_id", merged.alias("messages"))
        .select("conv_id", F.flatten(F.transform("messages", _pieces)).alias("pieces"))
        .select(
            "conv_id",
            F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
            F.aggregate("pieces", start, span)["spans"].alias("loss_spans"),
        )
    )


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text), loss_text, read back from formatted strings and their spans."""

    def parts(message: Column) -> Column:
        cut = F.split(F.split(message, re.escape(DONE), -1)[0], re.escape(SAYS), -1)
        return F.transform(
            F.split(cut[1], re.escape(NEXT), -1),
            lambda t: F.struct(unescape(cut[0]).alias("role"), unescape(t).alias("text")),
        )

    messages = F.split("formatted", re.escape(OPEN), -1)
    loss = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"])))
    return formatted.select(
        "conv_id",
        F.flatten(F.transform(F.slice(messages, F.lit(2), F.size(messages)), parts)).alias("turns"),
        F.array_join(loss, "").alias("loss_text"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_digests(turns: DataFrame) -> DataFrame:
    back = parse_conversations(format_conversations(turns))
    nl = F.lit("\n")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl)), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The conversation that the query adds: control strings as ordinary text.
PLANTED = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(f"SELECT -7L conv_id, 0L turn, 'user' role, '{PLANTED}' text UNION ALL SELECT -7L, 1L, 'assistant', '{PLANTED}'")
    return chat_digests(rows.unionByName(planted))


def _sql() -> str:
    esc = "replace({0}, '\\', '\\\\')"
    for mark in CONTROLS:
        esc = f"replace({esc}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
t AS (
  SELECT *, coalesce(role = lag(role) OVER w, false) AS joined
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  CAST(sum(length({esc.format("text")}) + CASE WHEN joined THEN {len(NEXT)}
       ELSE {len(OPEN) + len(SAYS) + len(DONE)} + length({esc.format("role")}) END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


SQL = _sql()
