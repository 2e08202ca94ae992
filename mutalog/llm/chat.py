"""Chat formatting of reply trees, with native expressions only.

Messages form trees by parent. Root-to-leaf paths come from iterative
self-joins: round k joins the table of ancestors at distance 2**(k-1) with
itself, so a path of depth d takes log2(d) rounds, and each leaf's path doubles
in every round. Branches are ranked in their tree by score, and each chosen
path becomes one conversation of the template

    <|turn|>role\\n text <|end|>\\n

in which control strings inside roles and texts are escaped, so that parsing
gives back exactly what went in. The loss mask holds the code point spans of
assistant texts.

Defined results: null texts and null roles are empty; a null tree id is a tree
of its own; a message whose parent isn't there is a root; messages on a cycle
have no root and are in no path; of rows that repeat a (tree, message) id the
least by (parent, role, text, score) stands for all, nulls first; rows without a
message id are in no path; of the caller's columns only those named are read; an
empty table gives no rows. A conversation is one value, so its length is bounded
by what a row can hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutalog.llm.shared import written

TURN, END = "<|turn|>", "<|end|>\n"
MARK = "~"
#: Control strings of common templates and what stands for them inside a text. Fixed values.
CONTROL = {"<|": "~1", "</s>": "~2", "<s>": "~3", "[INST]": "~4", "[/INST]": "~5", "<<SYS>>": "~6", "<</SYS>>": "~7"}
NEWLINE = "~8"


def escaped(text: Column) -> Column:
    """No control string is left, and no MARK but in front of a digit."""
    out = F.replace(text, F.lit(MARK), F.lit(MARK + "0"))
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), CONTROL.items(), out)


def unescaped(text: Column) -> Column:
    """escaped() undone. What is put in has no MARK, so no new code comes up on the way."""
    out = reduce(lambda c, kv: F.replace(c, F.lit(kv[1]), F.lit(kv[0])), CONTROL.items(), text)
    return F.replace(out, F.lit(MARK + "0"), F.lit(MARK))


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(NEWLINE))


def as_messages(turns: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Plain conversations as trees: the parent of a row is the row before it by turn (ties by role and text)."""
    i = F.row_number().over(Window.partitionBy(tree).orderBy(turn, "role", "text")).cast("long")
    rows = turns.select(F.col(tree).alias("tree_id"), i.alias("message_id"), "role", "text")
    return rows.withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1)).withColumn("score", F.lit(0.0))


def one_of_each(messages: DataFrame) -> DataFrame:
    """One row per (tree_id, message_id), so that no self-join multiplies repeats."""
    rest = F.struct("parent_id", "role", "text", "score")
    least = messages.where(F.col("message_id").isNotNull()).groupBy("tree_id", "message_id").agg(F.min(rest).alias("least"))
    return least.select("tree_id", "message_id", "least.*")


def reply_paths(messages: DataFrame) -> DataFrame:
    """tree_id, leaf_id, message_id, distance: every message of every root-to-leaf path, by distance from the leaf.

    messages: tree_id, message_id, parent_id; each (tree_id, message_id) once, see one_of_each().
    """
    at = messages.select(F.struct(F.coalesce(F.col("tree_id").cast("string"), F.lit("")).alias("t"), F.col("tree_id").isNull().alias("n"), F.col("message_id").alias("m")).alias("node"), F.col("parent_id"))
    at = at.withColumn("up", F.when(F.col("parent_id").isNotNull(), F.col("node").withField("m", F.col("parent_id")))).select("node", "up")
    there = at.select(F.col("node").alias("up"))
    links = written(at.join(there, "up", "left_semi").select("node", "up"))  # without parents that aren't there
    leaves = at.join(links.select(F.col("up").alias("node")), "node", "left_anti").select("node")
    paths = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance"))
    lift, reach, most = links, 1, messages.count()
    while reach <= most and not lift.isEmpty():
        further = paths.join(lift, "node").select("leaf", F.col("up").alias("node"), (F.col("distance") + reach).alias("distance"))
        paths = written(paths.unionByName(further))
        lift = written(lift.alias("a").join(lift.alias("b"), F.col("a.up") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.up").alias("up")))
        reach *= 2
    # only paths that end in a root; a leaf below a cycle has none
    rooted = paths.join(links.select("node").distinct(), "node", "left_anti").select("leaf").distinct()
    return paths.join(rooted, "leaf", "left_semi").select(
        F.col("leaf.t").alias("tree_key"), F.col("leaf.n").alias("tree_null"), F.col("leaf.m").alias("leaf_id"), F.col("node.m").alias("message_id"), "distance"
    )


def conversations(messages: DataFrame, branches: int | None = None, unique: bool = False) -> DataFrame:
    """One row per chosen path: tree_id, leaf_id, branch (rank by mean score, ties to the smaller leaf), formatted, spans of the loss mask.

    messages: tree_id, message_id, parent_id, role, text, score. branches: paths
    taken from each tree, best first; None takes all. unique: the caller knows
    that no (tree_id, message_id) repeats, as as_messages() does.
    """
    messages = messages if unique else written(one_of_each(messages))
    paths = reply_paths(messages)
    body = messages.select(F.coalesce(F.col("tree_id").cast("string"), F.lit("")).alias("tree_key"), F.col("tree_id").isNull().alias("tree_null"), "tree_id", "message_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    rows = paths.join(body, ["tree_key", "tree_null", "message_id"])
    path = ["tree_key", "tree_null", "leaf_id"]
    if branches is not None:
        ranked = rows.groupBy(*path).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("path_score"))
        best = F.row_number().over(Window.partitionBy("tree_key", "tree_null").orderBy(F.desc("path_score"), "leaf_id"))
        rows = rows.join(ranked.withColumn("branch", best).where(F.col("branch") <= branches), path)
    else:
        rows = rows.withColumn("branch", F.lit(None).cast("int"))
    head = F.concat(F.lit(TURN), _role(F.col("role")), F.lit("\n"))
    turns = rows.select(*path, "tree_id", "branch", "distance", "role", head.alias("head"), escaped(F.col("text")).alias("said"))
    turns = turns.withColumn("piece", F.concat("head", "said", F.lit(END)))
    before = F.coalesce(F.sum(F.char_length("piece")).over(Window.partitionBy(*path).orderBy(F.desc("distance")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("start", before + F.char_length("head"))
    loss = F.when(F.col("role") == "assistant", F.struct(F.col("start"), (F.col("start") + F.char_length("said")).alias("end")))
    listed = turns.select(*path, "tree_id", "branch", F.struct((-F.col("distance")).alias("at"), "piece", loss.alias("loss")).alias("turn"))
    made = listed.groupBy(*path).agg(F.first("tree_id").alias("tree_id"), F.first("branch").alias("branch"), F.sort_array(F.collect_list("turn")).alias("turns"))
    return made.select(
        "tree_id",
        "leaf_id",
        "branch",
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.loss"), lambda x: x.isNotNull()).alias("loss_spans"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text)."""
    pieces = F.split(formatted, r"<\|end\|>\n")
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        role = unescaped(F.replace(F.substring(head, len(TURN) + 1, 1 << 30), F.lit(NEWLINE), F.lit("\n")))
        return F.struct(role.alias("role"), unescaped(p.substr(F.char_length(head) + 2, F.char_length(p))).alias("text"))

    return F.transform(turns, turn)


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
