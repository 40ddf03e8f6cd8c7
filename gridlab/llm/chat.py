r"""Chat formatting over reply trees, DataFrame functions only.

Messages form trees by parent. The ancestors of every leaf are enumerated by self-joins that double the
distance they span (log2 of the depth many), so rows grow with the paths' total length. Branches are ranked by
score within their root, and each chosen path becomes one string:

    <|im_start|>role\ntext<|im_end|>\n ...

Control strings inside texts and roles are escaped by one backslash in every `<\...\|`, which drops off again on
reading, so the format is reversible whatever a text holds; in roles, a newline or backslash is escaped too.
`loss_spans` gives, in code points of the formatted string, where the assistant texts stand.

Defined cases: a null text or role counts as empty; rows of a conversation with the same turn are ordered by
role, then text, repeated rows each counting as a turn; a null conv_id is one conversation; texts of any length are
formatted whole; nodes on several rows and cycles of parents are errors; an empty table gives an empty result. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def paths(messages: DataFrame) -> DataFrame:
    """messages(node, parent, score) -> (root, leaf, node, step, branch): every root-to-leaf path.

    step counts from the root, 0 first; branch ranks the leaves of a root by the sum of scores along the path,
    highest first, ties by the smaller leaf. A node whose parent is null or missing is a root. Rows that repeat a node
    are an error, as a reply has one parent; so is a cycle of parents, a node that is its own parent included.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    once = F.when(F.count(F.lit(1)) == 1, F.first(F.struct("parent", "score"))).otherwise(F.raise_error(F.lit("a node occurs on several rows")))
    nodes = scratch.save(messages.groupBy("node").agg(once.alias("own")).select("node", "own.*"), "nodes")
    known = nodes.select(F.col("node").alias("parent")).distinct()
    up = nodes.select("node", "parent").join(known, "parent").select("node", F.col("parent").alias("up"))
    parents = up.select(F.col("up").alias("node")).distinct()
    # (leaf, node, d): node is d steps above leaf, for all d below the span reached so far
    reached = nodes.join(parents, "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).alias("d"))
    jumps, total = [scratch.save(up, "up")], nodes.count()
    while not jumps[-1].isEmpty():
        if 1 << len(jumps) > 2 * total:  # no path is longer than there are nodes
            raise ValueError("the parents of some node form a cycle")
        twice = jumps[-1].alias("a").join(jumps[-1].alias("b"), F.col("a.up") == F.col("b.node"))
        jumps.append(scratch.save(twice.select(F.col("a.node").alias("node"), F.col("b.up").alias("up")), "jump"))
    for k, jump in enumerate(jumps[:-1]):
        further = reached.join(jump, "node").select("leaf", F.col("up").alias("node"), (F.col("d") + (1 << k)).alias("d"))
        reached = scratch.save(reached.unionByName(further), "reached")
    full = reached.join(nodes.select("node", "score"), "node")
    tops = full.groupBy("leaf").agg(F.max("d").alias("top"), F.sum("score").alias("total"), F.max(F.struct("d", "node"))["node"].alias("root"))
    ranked = tops.withColumn("branch", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("total"), "leaf")))
    return full.join(ranked, "leaf").select("root", "leaf", "node", (F.col("top") - F.col("d")).alias("step"), "branch")


def render(turns: Column) -> Column:
    """Turns (array of struct(role, text), in order) as one formatted string."""
    each = F.transform(
        turns,
        lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n")),
    )
    return F.array_join(each, "")


def loss_spans(turns: Column) -> Column:
    """(start, length) in code points of each assistant text within render(turns)."""
    sized = F.transform(
        turns,
        lambda t: F.struct(
            (t["role"] == "assistant").alias("on"),
            (F.length(escape_role(t["role"])) + len(START) + 1).alias("head"),
            F.length(escape(t["text"])).alias("body"),
        ),
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    # concatenating to the growing array costs little: a conversation's turns, not its characters, bound it
    walked = F.aggregate(
        sized,
        empty,
        lambda a, t: F.struct(
            (a["at"] + t["head"] + t["body"] + len(END) + 1).alias("at"),
            F.when(
                t["on"],
                F.concat(a["spans"], F.array(F.struct((a["at"] + t["head"]).alias("start"), t["body"].alias("length")))),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )
    return walked["spans"]


def format_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """messages(node, parent, score, role, text) -> (root, leaf, branch, formatted, loss_spans).

    branches: keep this many best-ranked paths of each root; None keeps all.
    """
    chosen = paths(messages)
    if branches is not None:
        chosen = chosen.filter(F.col("branch") <= branches)
    said = messages.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = (
        chosen.join(said, "node")
        .groupBy("root", "leaf", "branch")
        .agg(F.sort_array(F.collect_list(F.struct("step", "role", "text"))).alias("turns"))
    )
    return grouped.select("root", "leaf", "branch", render(F.col("turns")).alias("formatted"), loss_spans(F.col("turns")).alias("loss_spans"))


def conversation_tree(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) as a reply tree: each turn answers the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    step = F.row_number().over(w)
    node = lambda k: F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("conv"), k.alias("step"))
    return (
        rows.select("conv_id", "turn", "role", "text")
        .withColumn("step", step)
        .select(
            node(F.col("step")).alias("node"),
            F.when(F.col("step") > 1, node(F.col("step") - 1)).alias("parent"),
            F.lit(0).alias("score"),
            "role",
            "text",
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: array of struct(role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(
                F.regexp_extract(p, r"(?s)\A[^\n]*\n(.*)<\|im_end\|>\n\z", 1)
            ).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
