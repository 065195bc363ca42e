"""Chat formatting: reply trees to training conversations.

Each message points to the one it replies to. A table of such steps is joined to itself: a step is put behind the one
that ends where it begins, so steps double and a tree takes as many joins as the logarithm of its depth; depth and score
add up on the way. Messages without replies end paths, which are ranked by score in each tree. A chosen path is
written out backwards: the steps of each length, the longest first, are taken from all messages found so far. No row ever
holds a path. The messages of each chosen path are formatted in order as one conversation.

Each turn is ``<|role|>`` + text + ``<|end|>``. Inside texts and roles a backslash and a letter stand for every
backslash, ``<``, ``[`` and ``|``, so no control string of this template or of others of that shape can come from a
text, and each stands for one character again when read back. ``loss_spans`` are the [start, end) code points of the formatted text that a model
is trained on: each assistant text, escaped, without its marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docengine.llm.spill import Scratch, table, written

# The template's marks.
OPEN, SHUT, END = "<|", "|>", "<|end|>"
# What stands for each character; the backslash goes first when escaping and last when reading back.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p"))


def escape(text: Column) -> Column:
    for raw, coded in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for raw, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def reply_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """The messages of the ``best`` root-to-leaf paths of each tree of ``messages`` (tree, id, parent, score): tree, leaf,
    rank (1 is the best of its tree; ties by leaf), score (the sum along the path), id and depth (1 at the root).

    A message whose parent is null or missing from its tree is a root. Of rows that repeat an id in a tree the one with
    the smallest parent and score counts. Messages on or below a cycle have no root and no path. A null score is 0; rows
    without a tree or id are left out.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    own = messages.where("tree is not null and id is not null").groupBy("tree", "id").agg(F.min(F.struct("parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("m"))
    own = scratch.write(own.select("tree", "id", F.col("m.parent").alias("parent"), F.col("m.score").alias("score")), "nodes")
    above = own.select(F.col("tree").alias("t"), F.col("id").alias("up"))
    sizes = own.groupBy("tree").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("tree", "t2")
    state = own.join(above, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("up")), "left").join(sizes, F.col("tree") == F.col("t2"))
    state = scratch.write(state.select("tree", "id", "up", "score", F.lit(1).cast("long").alias("depth"), "size"), "steps0")
    steps, done = [], [state.where("up is null")]
    open_ = state.where("up is not null")
    while not open_.isEmpty():
        steps.append(open_.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("back")))
        known = open_
        for part in done:
            known = known.unionByName(part)
        on = known.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("depth").alias("d2"))
        # Only steps that do not end at a root yet are joined again; what they need may be whole already.
        longer = open_.join(on, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("i"))).select(
            "tree", "id", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"), (F.col("depth") + F.col("d2")).alias("depth"), "size"
        )
        # A step over as many messages as the tree has, and still no root: a cycle.
        longer = scratch.write(longer.where("up is null or depth < size"), f"steps{len(steps)}")
        open_ = longer.where("up is not null")
        done.append(longer.where("up is null"))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    inner = own.where("parent is not null").select("tree", F.col("parent").alias("id")).distinct()
    order = W.partitionBy("tree").orderBy(F.desc("score"), "id")
    leaves = whole.join(inner, ["tree", "id"], "left_anti").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    found = leaves.select("tree", F.col("id").alias("leaf"), "rank", "score", "id")
    for step in reversed(steps):
        found = found.join(step, (F.col("tree") == F.col("t")) & (F.col("id") == F.col("i")), "left")
        found = found.select("tree", "leaf", "rank", "score", F.explode(F.array_compact(F.array("id", "back"))).alias("id"))
    return found.join(whole.select("tree", "id", "depth"), ["tree", "id"]).select("tree", "leaf", "rank", "score", "id", "depth")


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv, turn, role, text): conv, n_turns, formatted, loss_spans.

    Turns go in order of turn, then role and text, nulls first; repeated rows are turns of their own. A null text or
    role is empty. A conversation is one string by its nature: its turns meet in one row, nothing else does.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    piece = F.struct(
        F.col("turn"),
        role.alias("role"),
        text.alias("text"),
        F.concat(F.lit(OPEN), escape(role), F.lit(SHUT)).alias("head"),
        escape(text).alias("body"),
    )
    held = turns.withColumn("piece", piece).groupBy("conv").agg(F.array_sort(F.collect_list("piece")).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    long, n = "array<struct<start:long,end:long>>", F.length
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(long).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        lo = acc["at"] + n(x["head"])
        hi = lo + n(x["body"])
        span = F.when(x["role"] == "assistant", F.array(F.struct(lo.cast("long").alias("start"), hi.cast("long").alias("end")))).otherwise(F.array().cast(long))
        return F.struct((hi + len(END)).cast("long").alias("at"), F.concat(acc["s"], span).alias("s"))

    spans = F.aggregate("t", start, step, lambda acc: acc["s"])
    return held.select("conv", F.size("t").cast("long").alias("n_turns"), whole.alias("formatted"), spans.alias("loss_spans"))


def parsed(conversation: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role,text>>, from its string alone."""
    turns = F.split(conversation, r"<\|end\|>")
    parts = F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda x: F.split(F.substring(x, 3, 2**31 - 1), r"\|>", 2))
    return F.transform(parts, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations`` and the probe, formatted and read back from the output."""
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) as conv_id", "cast(turn as long) as turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    probe = spark.range(2).selectExpr("-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{odd}' as text")
    return read_back(conversations_formatted(rows.unionByName(probe)))


def conversations_formatted(rows: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) as reply trees: each turn replies to the one before it. Rows without
    a conv_id are one conversation, whose conv is null; an empty table gives no rows; other columns are ignored."""
    # Keys of joins are not null.
    tree = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("id"))
    keyed = rows.select(tree.alias("tree"), "turn", "role", "text")
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    msgs = written(keyed.withColumn("id", F.row_number().over(order)), "chat-messages")
    nodes = msgs.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"))
    chosen = reply_paths(nodes).join(msgs, ["tree", "id"]).select("tree", F.col("depth").alias("turn"), "role", "text")
    done = formatted(chosen.withColumnRenamed("tree", "conv"))
    return done.withColumn("conv", F.when(~F.col("conv.none"), F.col("conv.id")))


def read_back(done: DataFrame) -> DataFrame:
    turns = F.array_join(F.transform(parsed(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    masked = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )
    return done.select(
        F.col("conv").alias("conv_id"),
        F.size(parsed(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle() -> str:
    esc = r"regexp_replace({}, '([\\<\[|])', '\\\1', 'g')"
    return f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select *, row_number() over (partition by conv_id order by turn, role, text) as k from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length({esc.format("role")}) + length({esc.format("text")}) + {len(OPEN + SHUT + END)}) as bigint) as formatted_chars
from o group by 1"""


QUERIES = {"op8_chat_format": op8_chat_format}
ORACLE_SQL = {"op8_chat_format": oracle()}
