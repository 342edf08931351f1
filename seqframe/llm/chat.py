"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes its own example: all turns before it are context and
only that reply is trainable.  Turns after the last reply (or a conversation with
no reply) come as one more example whose target is null, so nothing is lost.

Template.  A turn is ``<marker><text></s>``; the marker is ``[INST]`` for a user,
``[SYS]`` for a system prompt, ``[/INST]`` for an assistant, ``[ROLE:<role>]`` for
any other role (a null role reads as the empty one).  Inside texts and role names
a backslash is doubled and a control string gets a backslash after its first
character, so no control string can appear there and dropping each escaping
backslash restores the text exactly.

Cases: null text is empty; null conv_id is a conversation of its own; equal turn
numbers are ordered by role, then text; no rows give no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

END = "</s>"
MARKERS = {"user": "[INST]", "system": "[SYS]", "assistant": "[/INST]"}
#: Where an escaping backslash goes: after a backslash, and inside each control string.
_ESCAPE = r"\\|<(?=/?s>)|\[(?=/?INST\]|SYS\]|ROLE:)"
_ROLE_HEAD = "[ROLE:"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role_name(role: Column) -> Column:
    # a role name must not end its own marker early
    return F.replace(escape(role), F.lit("]"), F.lit("\\]"))


def format_turn(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    head = F.concat(F.lit(_ROLE_HEAD), _role_name(role), F.lit("]"))
    for name, marker in MARKERS.items():
        head = F.when(role == name, F.lit(marker)).otherwise(head)
    return F.concat(head, escape(text), F.lit(END))


def expand(conversations: DataFrame) -> DataFrame:
    """Examples: conv_id, example (0, 1, ...), context, target (null: no reply follows),
    n_context turns.  ``context || target`` is what a model sees; loss covers target only.

    One shuffle, by conv_id; the example rows keep that partitioning.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    made = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).select(
        "conv_id",
        F.transform("ts", lambda t: format_turn(t["role"], t["text"])).alias("parts"),
        F.transform("ts", lambda t: t["role"] == "assistant").alias("reply"),
        F.size("ts").alias("n"),
    )
    at = F.filter(
        F.sequence(F.lit(1), F.col("n") + 1),
        lambda i: F.when(i <= F.col("n"), F.get("reply", i - 1)).otherwise(~F.get("reply", i - 2)),
    )
    ends = made.select("conv_id", "parts", "n", F.posexplode(at).alias("example", "i"))
    is_reply = F.col("i") <= F.col("n")
    return ends.select(
        "conv_id",
        "example",
        F.array_join(F.slice("parts", F.lit(1), F.col("i") - 1), "").alias("context"),
        F.when(is_reply, F.get("parts", F.col("i") - 1)).alias("target"),
        (F.col("i") - 1).alias("n_context"),
    )


def read_turns(formatted: Column) -> Column:
    """Back from formatted text to an array of (role, text) structs."""
    pieces = F.split(formatted, END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def one(p: Column) -> Column:
        name = F.regexp_extract(p, r"(?s)^\[ROLE:((?:\\.|[^\\\]])*)\]", 1)
        role, end = unescape(name), F.length(name) + len(_ROLE_HEAD) + 1
        end = F.when(F.startswith(p, F.lit(_ROLE_HEAD)), end).otherwise(F.locate("]", p))
        for known, marker in MARKERS.items():
            role = F.when(F.startswith(p, F.lit(marker)), F.lit(known)).otherwise(role)
        return F.struct(role.alias("role"), unescape(F.substring(p, end + 1, F.length(p))).alias("text"))

    return F.transform(pieces, one)


def digest(examples: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its examples' text and loss masks."""
    whole = F.concat(F.col("context"), F.coalesce(F.col("target"), F.lit("")))
    last = F.max(F.struct(F.col("example"), whole.alias("text")))["text"]
    masked = F.array_sort(
        F.collect_list(F.when(F.col("target").isNotNull(), F.struct(F.col("example"), F.col("target"))))
    )
    got = examples.groupBy("conv_id").agg(last.alias("text"), masked.alias("masked"))
    got = got.select(
        "conv_id",
        F.length("text").cast("long").alias("formatted_chars"),
        read_turns(F.col("text")).alias("turns"),
        F.array_join(
            F.transform("masked", lambda m: F.get(read_turns(m["target"]), F.lit(0))["text"]), ""
        ).alias("loss"),
    )
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op2_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose two turns hold control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return digest(expand(rows.unionByName(own)))


#: DuckDB's regular expressions have no look-ahead; whole control strings are counted,
#: each of which gets one backslash.
ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|\[SYS\]|\[ROLE:'))
    + CASE role WHEN 'user' THEN 6 WHEN 'system' THEN 5 WHEN 'assistant' THEN 7 ELSE 7 + length(role) END + 4 AS n
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
