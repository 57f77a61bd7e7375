"""Training texts from reply trees, in DataFrame functions only.

Messages point to the message that they answer.  A leaf's path is found by doubling: one self-join of the jump table gives every message its 2nd, 4th, 8th ... ancestor, and one join of the leaves'
paths with each jump doubles what is known of a path, so a chain of n messages takes about log2(n) rounds.  The best-scored branches of each tree are kept, and every kept path becomes one text.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn.  Control strings inside roles and texts get a backslash behind their first character (and what looks like one so changed gets one more), so a
control string in the output always is the template's, and taking one backslash away restores any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.llm.shared import saved

START, PAST = "<|im_start|>", "<|im_end|>\n"
#: Control strings by first character and rest; those of other common templates are kept out as well.
ESCAPE = (r"(<)(\\*(?:\|im_start\|>|\|im_end\|>|/?s>))|(\[)(\\*/?INST\])", r"$1$3\\$2$4")
UNESCAPE = (r"(<)\\(\\*(?:\|im_start\|>|\|im_end\|>|/?s>))|(\[)\\(\\*/?INST\])", r"$1$3$2$4")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def escape_role(role: Column) -> Column:
    """As escape, and without line ends."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    lines = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(F.replace(lines, F.lit("\\\\"), F.lit("\\")))


def chains(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of conversations without branches: tree, id, parent (the turn before), role, text, score 0. Equal turns follow each other by role and text; a null turn comes first."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    named = rows.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    numbered = named.withColumn("id", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """tree, leaf, rank (1: best), id, back (0: the leaf): every message of every path from a root to a leaf.

    messages: tree, id, parent (null: a root; unknown in the tree: a root too), score, unique by tree and id. A path's score is the sum of its messages'; equal scores rank by the leaf's id. Messages on a
    circle of answers lead to no root and have no path. branches: paths kept of each tree; None: all.
    """
    m = messages.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    same = lambda a, b: F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    known = m.alias("m").join(m.select("tree", F.col("id").alias("up")).alias("p"), same("m", "p") & (F.col("m.parent") == F.col("p.up")), "left")
    jump = saved(known.select("m.tree", "m.id", F.col("p.up").alias("to"), "m.score"))
    answered = jump.where("to is not null").select("tree", F.col("to").alias("id")).distinct()
    leaves = jump.alias("j").join(answered.alias("a"), same("j", "a") & (F.col("j.id") == F.col("a.id")), "left_anti")
    walked = saved(leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("back")))
    # jumps by 2**k, from the shortest to the longest; each message of a path is then reached by the one sum of powers that its distance is
    steps, far = [jump.select("tree", "id", "to").where("to is not null")], 1
    size = jump.count()
    while far < size and not steps[-1].isEmpty():
        s = steps[-1]
        longer = s.alias("a").join(s.alias("b"), same("a", "b") & (F.col("a.to") == F.col("b.id")))
        steps.append(saved(longer.select("a.tree", "a.id", "b.to")))
        far *= 2
    for k, s in reversed(list(enumerate(steps))):
        reached = walked.alias("w").join(s.alias("s"), same("w", "s") & (F.col("w.id") == F.col("s.id")))
        walked = walked.union(reached.select("w.tree", "w.leaf", F.col("s.to").alias("id"), (F.col("w.back") + (1 << k)).alias("back")))
        walked = saved(walked)
    if branches is None:
        return walked.withColumn("rank", F.lit(None).cast("int")).select("tree", "leaf", "rank", "id", "back")
    totals = walked.alias("w").join(jump.alias("j"), same("w", "j") & (F.col("w.id") == F.col("j.id"))).groupBy("w.tree", "w.leaf").agg(F.sum("j.score").alias("total"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))).where(F.col("rank") <= branches)
    return walked.alias("w").join(ranked.alias("r"), same("w", "r") & (F.col("w.leaf") == F.col("r.leaf"))).select("w.tree", "w.leaf", "r.rank", "w.id", "w.back")


def format_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """tree, leaf, rank, formatted (the text), segments (array of text, loss: consecutive parts of it; loss is true for what assistants say, markup left out).

    messages: as for paths, with role and text; null ones count as empty. A path is one row by nature, so it is put together in one task.
    """
    walked = paths(messages, branches)
    told = walked.alias("w").join(messages.alias("m"), F.col("w.tree").eqNullSafe(F.col("m.tree")) & (F.col("w.id") == F.col("m.id")))
    role, text = F.coalesce(F.col("m.role"), F.lit("")), F.coalesce(F.col("m.text"), F.lit(""))
    turn = F.struct((-F.col("w.back")).alias("order"), escape_role(role).alias("role"), escape(text).alias("text"), (role == "assistant").alias("loss"))
    grouped = told.groupBy("w.tree", "w.leaf", "w.rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(F.transform("turns", lambda t: F.array(part(F.concat(F.lit(START), t.role, F.lit("\n")), no), part(t.text, t.loss), part(F.lit(PAST), no))))
    return grouped.select("tree", "leaf", "rank", segments.alias("segments")).withColumn("formatted", F.array_join("segments.text", ""))


def turns_of(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted text."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    bodies = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substr(p, F.lit(len(START) + 1)))

    def turn(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(bodies, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")
