"""Chat formatting of reply trees.

Messages form trees by (tree, node, parent).  Iterative self-joins climb them:
round k joins each node with its 2^k-th ancestor and adds up the scores between,
so a path of n turns takes log2(n) rounds of one row for each node.  Branches are
ranked by the mean score of their nodes (null and NaN count as 0; ties: the smaller
leaf).  Only the chosen paths are then enumerated, by the same ancestors: the rows
made are the turns of those paths.  Each becomes one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Inside a text
each ``<``, any backslashes, ``|`` gets one more backslash, so no text can hold
a control string; taking one away restores it.  Roles also have % and line ends
written as %25 and %0A.  Loss spans are character ranges of the formatted
string that cover the texts of assistants, no control string.

Defined cases: null texts and roles are empty; a parent that is not in its tree
makes its child a root; nodes in a parent cycle have no root and are left out;
a tree id may be null; extra columns are ignored.  Of rows with one (tree, node)
the first in the order (parent, role, text, score), nulls first, counts; rows
without a node are left out.  Rows repeated in a linear conversation are turns of
their own, in the order (turn, role, text).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import stored

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def linear_trees(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """A conversation of ordered turns as a tree of one branch."""
    order = W.partitionBy(conv_col).orderBy(turn_col, "role", "text")
    node = F.row_number().over(order).cast("long")
    return turns.select(F.col(conv_col).alias("tree"), node.alias("node"), "role", "text").select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def _single(messages: DataFrame) -> DataFrame:
    """One row for each (tree, node)."""
    first = messages.filter("node IS NOT NULL").groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
    return first.select("tree", "node", "m.*")


def climbs(messages: DataFrame) -> list[DataFrame]:
    """Per round k (tree, node, up, total, n): the 2^k-th ancestor (null above the
    root), and the sum of scores and count of nodes from the node to below it."""
    score = F.nanvl(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0))
    nodes = messages.select("tree", "node", "parent", score.alias("total"), F.lit(1).cast("long").alias("n"))
    parents = messages.select(F.col("tree").alias("pt"), F.col("node").alias("pn"))
    linked = nodes.join(parents, F.col("tree").eqNullSafe(F.col("pt")) & (F.col("parent") == F.col("pn")), "left")
    states = [stored(linked.select("tree", "node", F.col("pn").alias("up"), "total", "n"))]
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(largest)) + 1 if largest > 1 else 0):
        last = states[-1]
        going, done = last.filter("up IS NOT NULL"), last.filter("up IS NULL")
        if going.isEmpty():
            break
        above = last.select(F.col("tree").alias("jt"), F.col("node").alias("jn"), F.col("up").alias("far"), F.col("total").alias("more"), F.col("n").alias("m"))
        further = going.join(above, F.col("tree").eqNullSafe(F.col("jt")) & (F.col("up") == F.col("jn")))
        further = further.select("tree", "node", F.col("far").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("n") + F.col("m")).alias("n"))
        states.append(stored(further.unionByName(done)))
    return states


def best_leaves(states: list[DataFrame], branches: int) -> DataFrame:
    """(tree, leaf, rank, path_score) of the best branches; in a cycle nothing ends."""
    is_parent = states[0].filter("up IS NOT NULL").select(F.col("tree").alias("pt"), F.col("up").alias("pn")).distinct()
    ended = states[-1].filter("up IS NULL")
    leaves = ended.join(is_parent, F.col("tree").eqNullSafe(F.col("pt")) & (F.col("node") == F.col("pn")), "left_anti")
    scored = leaves.select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("n")).alias("path_score"))
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("path_score"), "leaf"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= branches)


def paths(states: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """leaves with node and up: each node of each path to the root with its distance
    from the leaf."""
    front = leaves.select("*", F.col("leaf").alias("node"), F.lit(0).alias("up"))
    for k, state in enumerate(states[:-1] if len(states) > 1 else []):
        hop = state.filter("up IS NOT NULL").select(F.col("tree").alias("jt"), F.col("node").alias("jn"), F.col("up").alias("far"))
        further = front.join(hop, F.col("tree").eqNullSafe(F.col("jt")) & (F.col("node") == F.col("jn")))
        further = further.select(*leaves.columns, F.col("far").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        front = stored(front.unionByName(further))
    return front


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss_spans) of the ``branches`` best
    paths of each tree."""
    messages = stored(_single(messages))
    states = climbs(messages)
    chosen = paths(states, stored(best_leaves(states, branches)))
    said = messages.select(F.col("tree").alias("mt"), F.col("node").alias("mn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = chosen.join(said, F.col("tree").eqNullSafe(F.col("mt")) & (F.col("node") == F.col("mn")))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turns = chosen.select("tree", "leaf", "rank", "path_score", "up", "role", head.alias("head"), body.alias("body"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END + "\n"))).withColumn("chars", F.char_length("turn"))
    upto = W.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(W.unboundedPreceding, W.currentRow)
    turns = turns.withColumn("start", F.sum("chars").over(upto) - F.col("chars") + F.char_length("head")).withColumn("end", F.col("start") + F.char_length("body"))
    made = turns.groupBy("tree", "leaf", "rank", "path_score").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("o"), "turn"))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("start", "end")))).alias("loss_spans"),
    )
    return made.select("tree", "leaf", "rank", F.col("path_score").alias("score"), F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (role, text) and loss_texts, taken from the string."""
    parts = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    role = lambda p: F.substring_index(p, "\n", 1)
    turns = F.transform(
        parts, lambda p: F.struct(unescape_role(F.substr(role(p), F.lit(len(START) + 1))).alias("role"), unescape(F.substr(p, F.char_length(role(p)) + 2)).alias("text"))
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_texts", loss)
