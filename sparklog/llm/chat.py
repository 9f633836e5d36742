"""Chat formatting from reply trees (operator 2), in DataFrame functions only.

A message row is (conv_id, msg_id, parent_id, role, text, score).  Root-to-leaf paths are enumerated by
iterative self-joins that double the distance: round k joins every message with its ancestor at distance
2 ** k, so a chain of n messages takes log2(n) self-joins, each on the unique key (conv_id, msg_id).  The
paths are then unrolled from the leaves through the same tables, largest distance first.  Branches of a
conversation are ranked by their mean score (ties: smaller leaf id first), and each chosen path becomes
one text.

Template: ``### role: text</turn>\\n`` per turn.  Inside roles and texts ``\\`` becomes ``\\b``, ``#`` becomes
``\\h``, ``<`` becomes ``\\l`` and (in roles) ``:`` becomes ``\\c``; so no control string can occur in them, and
replacing the codes back in the order c, l, h, b restores them exactly.  ``loss_spans`` are (start, length)
code-point ranges of the assistant texts inside the formatted text.

Defined cases: a null text or role is empty; a null score counts 0; rows repeating a (conv_id, msg_id)
count once (the smallest role, text, score); a null or unknown parent starts a path; messages on a cycle
reach no root and take part in no path; rows without conv_id or msg_id are left out; other columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

_KEY = ["conv_id", "msg_id"]
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"


def escape(c: Column, role: bool = False) -> Column:
    for char, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), *(((":", "\\c"),) if role else ())):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for code, char in (("\\c", ":"), ("\\l", "<"), ("\\h", "#"), ("\\b", "\\")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def turns_as_tree(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each turn answers the one before."""
    from pyspark.sql import Window
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")
    numbered = rows.withColumn("msg_id", F.row_number().over(w).cast("long"))
    return numbered.select(*_KEY, F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text",
                           F.lit(0.0).alias("score"))


def _messages(messages: DataFrame) -> DataFrame:
    rows = (messages.where("conv_id is not null and msg_id is not null")
            .select(*_KEY, F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                                    F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), "parent_id").alias("m"))
            .groupBy(*_KEY).agg(F.min("m").alias("m")).select(*_KEY, "m.*"))
    known = rows.select("conv_id", F.col("msg_id").alias("parent_id"), F.lit(True).alias("known"))
    return written(rows.join(known, ["conv_id", "parent_id"], "left").select(
        *_KEY, F.when(F.col("known"), F.col("parent_id")).alias("parent_id"), "role", "text", "score"), "chat-messages")


def paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf_id, msg_id, dist): every message on every root-to-leaf path, dist 0 at the leaf."""
    jumps = [messages.select(*_KEY, F.col("parent_id").alias("up")).where("up is not null")]
    size = messages.count()
    while True:
        far = jumps[-1]
        step = written(far.join(far.select("conv_id", F.col("msg_id").alias("up"), F.col("up").alias("up2")), ["conv_id", "up"])
                       .select(*_KEY, F.col("up2").alias("up")), "chat-jumps")
        # on a cycle every distance has an ancestor: past the number of messages only those are left
        if step.isEmpty() or 1 << len(jumps) > size:
            break
        jumps.append(step)
    leaves = messages.select(*_KEY).join(
        messages.select("conv_id", F.col("parent_id").alias("msg_id")).where("msg_id is not null"), _KEY, "left_anti")
    out = leaves.select("conv_id", F.col("msg_id").alias("leaf_id"), "msg_id", F.lit(0).cast("long").alias("dist"))
    for k in range(len(jumps) - 1, -1, -1):
        further = out.join(jumps[k], _KEY).select(
            "conv_id", "leaf_id", F.col("up").alias("msg_id"), (F.col("dist") + (1 << k)).alias("dist"))
        out = out.unionByName(further)
        if k % 3 == 0 and k:
            out = written(out, "chat-paths")
    return out


def format_chats(messages: DataFrame, per_conversation: int | None = 1) -> DataFrame:
    """One row per chosen path: conv_id, leaf_id, rank, score, formatted, loss_spans.

    ``per_conversation`` is the number of best branches to format (None: every branch).
    """
    from pyspark.sql import Window
    rows = _messages(messages)
    on_path = written(paths(rows).join(rows, _KEY), "chat-turns")
    ranked = on_path.groupBy("conv_id", "leaf_id").agg(F.avg("score").alias("score"))
    w = Window.partitionBy("conv_id").orderBy(F.col("score").desc(), "leaf_id")
    ranked = ranked.withColumn("rank", F.row_number().over(w))
    if per_conversation is not None:
        ranked = ranked.where(F.col("rank") <= per_conversation)
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(MIDDLE))
    body = escape(F.col("text"))
    turn = F.struct((-F.col("dist")).alias("at"), F.concat(head, body, F.lit(CLOSE)).alias("turn"),
                    (F.col("role") == "assistant").alias("loss"), F.char_length(head).alias("head"),
                    F.char_length(body).alias("body"))
    grouped = (on_path.join(ranked.select("conv_id", "leaf_id", "rank", F.col("score").alias("path_score")), ["conv_id", "leaf_id"])
               .groupBy("conv_id", "leaf_id", "rank", "path_score").agg(F.sort_array(F.collect_list(turn)).alias("t")))
    spans = F.aggregate(
        "t", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("s")),
        lambda a, x: F.struct(
            (a["at"] + x["head"] + x["body"] + len(CLOSE)).cast("long").alias("at"),
            F.when(x["loss"], F.concat(a["s"], F.array(F.struct((a["at"] + x["head"]).cast("long").alias("start"),
                                                               x["body"].cast("long").alias("length")))))
            .otherwise(a["s"]).alias("s")),
        lambda a: a["s"])
    return grouped.select("conv_id", "leaf_id", "rank", F.col("path_score").alias("score"),
                          F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    turns = F.slice(F.split(formatted, CLOSE), 1, F.greatest(F.size(F.split(formatted, CLOSE)) - 1, F.lit(0)))
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring_index(F.substring(t, len(OPEN) + 1, 1 << 30), MIDDLE, 1)).alias("role"),
        unescape(F.substr(t, F.position(F.lit(MIDDLE), t) + len(MIDDLE))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    """Contract query: all conversations plus conversation -7, digested from the formatted output."""
    hard = "\\### Assistant: </turn> ok"
    extra = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                              F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text")))
    out = written(format_chats(turns_as_tree(extra)), "chat")
    back = out.select("conv_id", "formatted", parse_chat(F.col("formatted")).alias("turns"),
                      loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), "UTF-8"), 256)
        .alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) AS text_len,
    length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) AS role_len
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(4 + role_len + 2 + text_len + 8) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
