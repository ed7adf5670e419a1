"""Chat formatting by prefix-target expansion (DataFrame only).

Every assistant turn becomes one example: all turns before it are the
context and only that reply is under the loss mask.  A turn is written

    <|turn|>ROLE newline TEXT <|end|> newline

Texts and roles are escaped, so no control string can occur inside them:
every backslash is doubled, then a backslash is put inside each control
string (``<|`` becomes ``<\\|`` and so on); reading drops the first
backslash of every pair, which undoes both.

An example holds positions instead of a copied prefix: the formatted
conversation is stored once and ``context_end``, ``target_start`` and
``target_end`` (code points) point into it, so n replies cost n small rows and
not n * n / 2 turns of text; ``render`` cuts the strings of an example.

Turns behind the last reply (or a conversation without one) belong to no
reply's prefix; one example without target keeps them, so the format loses
nothing.

Defined cases: null text and null role are empty; turns are ordered by turn
(null first), then role and text, and equal rows all stay; a null conv_id is
one conversation; an empty table gives no rows.  A conversation is one row, as
its digest and its training string are; nothing larger is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of this and other common chat templates.
CONTROLS = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = "<|turn|>", "<|end|>\n"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (per turn: is it
    a reply, start and end of its text, end of the turn; code points)."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"),
                 F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    parts = F.transform("ts", lambda t: F.struct(
        (t["role"] == "assistant").alias("reply"),
        F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("head"),
        escape(t["text"]).alias("body")))
    conv = conv.select("conv_id", parts.alias("ps"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"),
                    F.array().cast("array<struct<reply:boolean,a:bigint,b:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["head"])
        b = a + F.length(p["body"])
        end = b + F.lit(len(CLOSE))
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["spans"], F.array(F.struct(
            p["reply"].alias("reply"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"),
            end.cast("bigint").alias("end")))).alias("spans"))
    return conv.select(
        "conv_id",
        F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("ps", zero, step, lambda acc: acc["spans"]).alias("spans"))


def expand(conv: DataFrame) -> DataFrame:
    """The examples: conv_id, example (from 0), context_end (start of the
    reply's turn text: everything before is context), target_start,
    target_end (null without target), example_end."""
    replies = F.filter(F.transform("spans", lambda s, k: F.struct(
        s["reply"].alias("reply"), s["a"].alias("a"), s["b"].alias("b"), s["end"].alias("end"))),
        lambda s: s["reply"])
    last = F.element_at("spans", -1)
    tail = F.when(last["reply"], F.array().cast("array<struct<reply:boolean,a:bigint,b:bigint,end:bigint>>")
                  ).otherwise(F.array(F.struct(
                      F.lit(False).alias("reply"), F.lit(None).cast("bigint").alias("a"),
                      F.lit(None).cast("bigint").alias("b"), last["end"].alias("end"))))
    return (conv.select("conv_id", F.posexplode(F.concat(replies, tail)).alias("example", "s"))
            .select("conv_id", "example", F.coalesce("s.a", "s.end").alias("context_end"),
                    F.col("s.a").alias("target_start"), F.col("s.b").alias("target_end"),
                    F.col("s.end").alias("example_end")))


def render(conv: DataFrame, examples: DataFrame) -> DataFrame:
    """Examples with their strings: conv_id, example, context, target (still
    escaped; the model trains on target only)."""
    return (examples.join(conv.select("conv_id", "formatted").withColumnRenamed("conv_id", "_x_c"),
                          F.col("conv_id").eqNullSafe(F.col("_x_c")))
            .select("conv_id", "example",
                    F.substring("formatted", F.lit(1), F.col("context_end")).alias("context"),
                    F.substring("formatted", F.col("target_start") + 1,
                                F.col("target_end") - F.col("target_start")).alias("target")))


def read_turns(formatted: Column) -> Column:
    """Formatted string back to an array of (role, text)."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: F.length(x) > 0)

    def parse(t: Column) -> Column:
        head = F.regexp_extract(t, r"(?s)\A((?:[^\\\n]|\\.)*+)\n", 1)
        body = F.substring(t, F.length(head) + 2, F.length(t) - F.length(head) - 1 - len(CLOSE))
        return F.struct(unescape(head).alias("role"), unescape(body).alias("text"))
    return F.transform(turns, parse)


def turn_bounds(formatted: Column) -> Column:
    """The spans of ``conversations`` as the formatted string itself shows them."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: F.length(x) > 0)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"),
                    F.array().cast("array<struct<reply:boolean,a:bigint,b:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = F.regexp_extract(t, r"(?s)\A((?:[^\\\n]|\\.)*+)\n", 1)
        end = acc["at"] + F.lit(len(OPEN)) + F.length(t)
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["spans"], F.array(F.struct(
            (head == "assistant").alias("reply"),
            (acc["at"] + F.lit(len(OPEN) + 1) + F.length(head)).cast("bigint").alias("a"),
            (end - F.lit(len(CLOSE))).cast("bigint").alias("b"), end.cast("bigint").alias("end")))).alias("spans"))
    return F.aggregate(pieces, zero, step, lambda acc: acc["spans"])


def examples_hold(examples: Column, bounds: Column) -> Column:
    """Do the examples of a conversation (structs in order) have the context,
    target and end that the bounds of its turns ask for?"""
    def row(a: Column, start: Column, b: Column, end: Column) -> Column:
        return F.struct(a.alias("context_end"), start.alias("target_start"), b.alias("target_end"),
                        end.alias("example_end"))
    none, last = F.lit(-1).cast("bigint"), F.element_at(bounds, -1)
    replies = F.transform(F.filter(bounds, lambda s: s["reply"]), lambda s: row(s["a"], s["a"], s["b"], s["end"]))
    tail = F.filter(F.array(row(last["end"], none, none, last["end"])), lambda x: ~last["reply"])
    got = F.transform(examples, lambda x: row(x["context_end"], F.coalesce(x["target_start"], none),
                                              F.coalesce(x["target_end"], none), x["example_end"]))
    return F.coalesce(got == F.concat(replies, tail), F.lit(False))
