"""Chat formatting of reply trees.

Messages (id, parent, role, text, score) form a forest. Self-joins that double their reach give each message its root,
depth and branch score; the branches (leaves) of each tree are ranked by it, and each chosen path, root to leaf,
becomes one formatted conversation.

Template: a turn is "<|role|>\\n" + escaped text + "\\n<|end|>\\n". Inside texts and roles "&" becomes "&amp;", "<" becomes "&lt;", "[" becomes
"&lsqb;", so that no control string of this template or of others ("</s>", "[INST]", "<|...|>") survives in a text;
reading back undoes it exactly. The loss mask is a list of spans (start, length in code points) of the formatted
string: the texts of assistant turns.

Scale: the joins of ids take log2(depth) rounds and carry no texts; paths are enumerated for the chosen leaves only, and texts are joined
once, to those. A chosen path is one string in the result, so its texts meet in one array; a whole tree never does. A path's texts, like any
string, have to stay below 2 GB.

Defined results: null text or role counts as empty, a null score as 0. A parent that doesn't exist makes a root. Repeated ids: the
first row by (parent, role, text) counts. Messages on a cycle reach no root and are left out. Ties of branch score go to the smaller
leaf. Columns besides those named, whatever their names, are ignored. Very long texts stay whole. Rows with a null conversation id form one conversation whose id is null; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Fixed values of the template.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def head(role: Column) -> Column:
    """The string before a turn's text. In a role "|" is escaped as well: it ends there."""
    return F.concat(F.lit("<|"), F.replace(escape(role), F.lit("|"), F.lit("&vert;")), F.lit("|>\n"))


TAIL = "\n<|end|>\n"


def from_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as trees: each row's parent is the row before it (ties of turn: by role, then text). Ids are (conv, position)."""
    own = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = own.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    return numbered.select(
        F.concat_ws("/", name, "pos").alias("id"), F.when(F.col("pos") > 1, F.concat_ws("/", name, F.col("pos") - 1)).alias("parent"), "conv_id", "role", "text", F.lit(1.0).alias("score")
    )


def first_of(messages: DataFrame) -> DataFrame:
    """One row for each id: the first by (parent, role, text), those without a parent before the others."""
    row = F.struct(
        F.col("parent").isNotNull().alias("has"), "parent", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    return messages.groupBy("id").agg(F.min(row).alias("m")).select("id", "m.parent", "m.role", "m.text", "m.score")


def branches(messages: DataFrame, best: int | None = 1, unique: bool = False) -> DataFrame:
    """The best paths of each tree (all where best is None): root, leaf, branch_rank, branch_score, depth, and position and id of each message on the path.

    Each round joins the pointer table with itself: a message that points 2^k up learns whom its target points at, and the root once it is
    passed. Leaves are ranked by root; paths are enumerated, by the same pointers, for the chosen leaves alone.
    unique: no two rows share an id, so texts need not be compared to find the first.
    """
    known = (messages if unique else first_of(messages)).select("id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    kept = known.select(F.col("id").alias("p")).filter(F.col("p").isNotNull())
    # roots have no parent to look up, and would all meet at one key
    there = known.filter("id IS NOT NULL")
    below = there.filter("parent IS NOT NULL").join(kept, F.col("parent") == F.col("p"), "left").select("id", F.col("p").alias("up"), "score")
    above = there.filter("parent IS NULL").select("id", F.lit(None).cast("string").alias("up"), "score")
    root = F.when(F.col("up").isNull(), F.col("id")).alias("root")
    links = cut(below.unionByName(above).select("id", "up", root, F.lit(1).alias("steps"), "score"), "chat-links")
    # jumps[k]: each message's ancestor 2^k up, while there is one
    jumps, at, total = [links.filter("up IS NOT NULL").select("id", "up")], links, links.count()
    while True:
        # "up" is null once the root is passed: root, steps and score are then final, and only the others go on
        target = at.select(F.col("id").alias("t"), F.col("up").alias("next"), "root", F.col("steps").alias("more"), F.col("score").alias("sum"))
        moved = at.filter("up IS NOT NULL").drop("root").join(target, F.col("up") == F.col("t"))
        moved = moved.select("id", F.col("next").alias("up"), "root", (F.col("steps") + F.col("more")).alias("steps"), (F.col("score") + F.col("sum")).alias("score"))
        at = cut(at.filter("up IS NULL").unionByName(moved), "chat-jump")
        open_ = at.filter("up IS NOT NULL")
        if open_.isEmpty() or (1 << len(jumps)) > total:
            break
        jumps.append(open_.select("id", "up"))
    # messages on a cycle, or below one, still point somewhere
    done = at.filter("up IS NULL").select(F.col("id").alias("leaf"), "root", F.col("steps").alias("depth"), (F.col("score") / F.col("steps")).alias("branch_score"))
    leaves = done.join(links.filter("up IS NOT NULL").select(F.col("up").alias("leaf")).distinct(), "leaf", "left_anti")
    ranked = leaves.withColumn("branch_rank", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("branch_score"), "leaf")))
    if best is not None:
        ranked = ranked.filter(F.col("branch_rank") <= best)
    chosen = cut(ranked, "chat-leaves")
    paths = chosen.select("leaf", F.col("leaf").alias("id"), F.lit(0).alias("back"))
    for k, jump in enumerate(jumps):
        # each round reads a written table, so the plan stays as small however deep the trees are
        further = paths.join(jump.withColumnRenamed("id", "from"), F.col("id") == F.col("from")).select("leaf", F.col("up").alias("id"), (F.col("back") + (1 << k)).alias("back"))
        paths = cut(paths.unionByName(further), "chat-paths")
    return paths.join(chosen, "leaf").withColumn("position", F.col("depth") - F.col("back"))


def format_paths(messages: DataFrame, paths: DataFrame, unique: bool = False) -> DataFrame:
    """One row for each path: leaf, root, branch_rank, formatted text, and the spans of the loss mask as code point offsets in that text.

    unique: as in branches.
    """
    own = messages.select("id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")) if unique else first_of(messages).select("id", "role", "text")
    told = paths.select("leaf", "root", "branch_rank", "position", "id").join(own, "id")
    turn = F.struct("position", head(F.col("role")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss"))
    grouped = told.groupBy("leaf", "root", "branch_rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TAIL))), "")
    return grouped.select("leaf", "root", "branch_rank", formatted.alias("formatted"), spans().alias("loss_spans"))


def spans() -> Column:
    """(start, length) of each assistant text in the formatted string of column turns."""
    seen = F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"]) + len(TAIL)).alias("at"),
            F.when(t["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return seen["spans"]


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted string and its mask say: leaf, turns (role, text) and the text under the mask, unescaped."""
    pieces = F.filter(F.split("formatted", r"\n<\|end\|>\n"), lambda x: x != "")
    parsed = F.transform(pieces, lambda x: F.struct(unescape(F.replace(F.regexp_extract(x, r"(?s)^<\|(.*?)\|>\n", 1), F.lit("&vert;"), F.lit("|"))).alias("role"), unescape(F.regexp_extract(x, r"(?s)^<\|.*?\|>\n(.*)$", 1)).alias("text")))
    under = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.select("leaf", "root", "branch_rank", "formatted", parsed.alias("turns"), under.alias("under_mask"))
