"""Chat formatting of reply trees with DataFrame functions only.

A node has a tree, an id, a parent and a score. Branches are ranked by the sum of
their nodes' scores, which iterative self-joins double: each round every node
adds the sum of the stretch above its own and looks twice as far up, so a tree of
depth d takes log2 d rounds over as many rows as there are nodes. Only the chosen
branches are then enumerated, node by node, by doubling self-joins too, and each
is formatted as one conversation.

Template: `<|im_start|>` role, a line feed, the text, `<|im_end|>`, a line feed.
Inside roles and texts each `<|` is written `<||`, and a line feed in a role
`<|nl|>`, so no control string can come from a text, and all is read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def branch_scores(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, score): the sum of scores on the way from each leaf to its root; null scores count as zero.

    `nodes` has tree, node, parent (null at a root) and score; (tree, node) is
    unique. A node whose parent isn't there is a root. Parents that form a ring
    are an error, found after as many rounds as the largest tree could need.
    """
    base = written(nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "chat-nodes")
    up = base.join(base.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi")
    leaves = base.select("tree", "node").join(up.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    ahead = up.select("tree", "node", F.col("parent").alias("to"))
    sums = base.select("tree", "node", "score").join(ahead, ["tree", "node"], "left")
    largest = base.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    last = None
    for _ in range(largest.bit_length() + 1):
        sums = last = written(sums, "chat-sums", instead_of=last)
        open_ = sums.where("to is not null")
        if open_.isEmpty():
            return sums.join(leaves, ["tree", "node"]).select("tree", F.col("node").alias("leaf"), "score")
        above = sums.select("tree", F.col("node").alias("to"), F.col("score").alias("more"), F.col("to").alias("next"))
        moved = open_.join(above, ["tree", "to"]).select("tree", "node", (F.col("score") + F.col("more")).alias("score"), F.col("next").alias("to"))
        sums = sums.where("to is null").select("tree", "node", "score", "to").unionByName(moved)
    raise ValueError("replies form a ring")


def paths_of(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node on the way from each of the leaves (up = 0) to its root. Needs (tree, leaf) of branches without rings."""
    base = written(nodes.select("tree", "node", "parent"), "chat-nodes")
    jump = base.join(base.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("to"))
    paths, step, last = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")), 1, None
    while True:
        jump = last = written(jump, "chat-jump", instead_of=last)
        if jump.isEmpty():
            return paths
        further = paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        paths = written(paths.unionByName(further), "chat-paths", instead_of=paths)
        ahead = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("next"))
        jump = jump.join(ahead, ["tree", "to"]).select("tree", "node", F.col("next").alias("to"))
        step *= 2


def root_to_leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node on the way from every leaf (up = 0) to its root. Rings are an error."""
    return paths_of(nodes, branch_scores(nodes.select("tree", "node", "parent", F.lit(0.0).alias("score"))).select("tree", "leaf"))


def best_branches(nodes: DataFrame, keep: int | None = 1) -> DataFrame:
    """(tree, leaf, rank): each tree's branches by the sum of their nodes' scores, highest first, ties to the smaller leaf. keep: how many, None for all."""
    ranked = branch_scores(nodes).withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    return (ranked if keep is None else ranked.where(F.col("rank") <= keep)).select("tree", "leaf", "rank")


def formatted(nodes: DataFrame, keep: int | None = 1) -> DataFrame:
    """(tree, leaf, formatted, loss): one conversation a chosen branch, and the loss mask: (start, length) in code points of each assistant text.

    `nodes` has tree, node, parent, role, text and score; null roles and texts count as empty.
    """
    best = written(best_branches(nodes, keep), "chat-best")
    chosen = paths_of(nodes, best).join(best, ["tree", "leaf"])
    turns = chosen.join(
        nodes.select("tree", "node", escape_role(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"), (F.coalesce("role", F.lit("")) == "assistant").alias("loss")), ["tree", "node"]
    )
    grouped = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text", "loss"))).alias("turns"))
    head = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"))
    tail = F.lit(END + "\n")
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
    mask = F.aggregate(
        "turns",
        state,
        lambda acc, t: F.struct(
            (acc["at"] + F.length(head(t)) + F.length(t["text"]) + len(END) + 1).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(head(t))).alias("start"), F.length(t["text"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return grouped.select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], tail)), "").alias("formatted"), mask.alias("loss"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds `turns`, an array of (role, text), and `loss_text`, both read from the formatted string and its mask."""
    blocks = F.slice(F.split("formatted", F.lit("\\Q" + END + "\n\\E"), -1), 1, F.size(F.split("formatted", F.lit("\\Q" + END + "\n\\E"), -1)) - 1)

    def turn(block: Column) -> Column:
        body = F.substring(block, F.lit(len(START) + 1), F.length(block))
        cut = F.instr(body, F.lit("\n"))
        return F.struct(unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(body, cut + 1, F.length(body))).alias("text"))

    loss = F.array_join(F.transform("loss", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))), "")
    return conversations.withColumn("turns", F.transform(blocks, turn)).withColumn("loss_text", loss)


def as_tree(conversations: DataFrame) -> DataFrame:
    """A table of turns as reply trees: each turn answers the one before it. Equal turns are ordered by role, then text.

    A null conv_id is a conversation of its own kind; scores are the assistant texts' lengths.
    """
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    numbered = numbered.withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))).withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.when(F.col("role") == "assistant", F.length("text")).otherwise(F.lit(0)).alias("score"))


def report(conversations: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output.

    Null and empty texts are empty turns; repeated rows are turns of their own,
    and turns of one number are ordered by role, then text; an empty table gives
    none; other columns are left out, whatever their names. A text of any length
    is formatted whole; one conversation's turns are put together in one task.
    """
    nodes = written(as_tree(conversations), "chat-turns")
    out = read_back(formatted(nodes))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.when(F.col("tree") != "none", F.col("tree").cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
