"""Operator 6, chat formatting of reply trees.

Messages point to the message they reply to.  Paths from each leaf to its root
are enumerated by iterative self-joins over jump pointers: round r joins with
the ancestor 2^r steps up, so a path of d messages takes log2(d) rounds, and a
path's rows are made once each.  Branches are ranked by score within their tree;
each chosen one becomes a conversation in this form:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

In texts and roles ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|`` (in roles
also a line break ``&#10;``), so control strings only come from the template and
everything can be read back.  Spans of assistant texts in the formatted string
are the loss mask.

Native: DataFrame functions only.

Defined results: null texts and roles are empty; a message whose parent is
absent is a root; messages on or under a cycle have no root and are in no
path; equal scores rank by leaf id; messages of trees named null are one tree;
messages without a name of their own (null node) are left out; a message given
more than once counts once, with its least parent, its largest score and its
least turn; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, materialise, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Trees of more messages are joined node by node; most such trees that are broadcast by name.
SMALL_TREE, BROADCAST_TREES = 1_000, 100_000


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&#10;"), F.lit("\n")))


def linked_of(nodes: DataFrame) -> DataFrame:
    """(tree, node, jump, s): the present parent of each message, and its score."""
    n = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("s"))
    p = n.select(F.col("tree").alias("t"), F.col("node").alias("at"))
    return materialise(n.join(p, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("at")), "left").select("tree", "node", F.col("at").alias("jump"), "s"))


def leaves_of(linked: DataFrame) -> DataFrame:
    inner = linked.where("jump is not null").select(F.col("tree").alias("t"), F.col("jump").alias("j")).distinct()
    return linked.join(inner, linked["tree"].eqNullSafe(inner["t"]) & (linked["node"] == inner["j"]), "left_anti").select("tree", F.col("node").alias("leaf"))


def totals(linked: DataFrame) -> DataFrame:
    """(tree, node, total): the sum of scores from each message up to its root, by pointers that jump twice as far each round; one row a message throughout."""
    largest = linked.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    now, step = linked, 1
    while step <= largest and not now.where("jump is not null").isEmpty():
        up = now.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("jump").alias("further"), F.col("s").alias("more"))
        before, both = now, now.join(up, now["tree"].eqNullSafe(up["t"]) & (now["jump"] == up["n"]), "left")
        now = materialise(both.select("tree", "node", F.col("further").alias("jump"), (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("s")))
        if before is not linked:
            discard(before)
        step *= 2
    return now.where("jump is null").select("tree", "node", F.col("s").alias("total"))  # the rest hangs on cycles


def paths(linked: DataFrame, leaves: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): for each of the leaves its ancestors, itself with up = 0."""
    found = materialise(leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")))
    jump, held = linked.where("jump is not null").select("tree", "node", "jump"), None
    largest = linked.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    step = 1
    while step <= largest and not jump.isEmpty():
        j = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "jump")
        more = found.join(j, found["tree"].eqNullSafe(j["t"]) & (found["node"] == j["n"])).select("tree", "leaf", F.col("jump").alias("node"), (F.col("up") + step).alias("up"))
        a, b = jump.alias("a"), jump.alias("b")
        further = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.jump") == F.col("b.node"))).select("a.tree", "a.node", "b.jump")
        found, jump = found.unionByName(materialise(more)), materialise(further)  # each path row is written once
        if held is not None:
            discard(held)
        held = jump
        step *= 2
    if not jump.isEmpty():  # only a cycle still has pointers now: drop leaves that hang on one
        bad = jump.select(F.col("tree").alias("t"), F.col("node").alias("n")).distinct()
        found = found.join(bad, found["tree"].eqNullSafe(bad["t"]) & (found["leaf"] == bad["n"]), "left_anti")
    return found


def branches(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """Paths of the ``top`` branches (all if None) of each tree by the sum of their scores: adds score and rank.

    With ``top`` sums come first, one row a message, and only chosen branches are enumerated.
    """
    linked = linked_of(nodes)
    leaves = leaves_of(linked)
    ranking = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))
    if top is not None:
        up = totals(linked).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("total").alias("branch_score"))
        ranked = leaves.join(up, leaves["tree"].eqNullSafe(up["t"]) & (leaves["leaf"] == up["n"])).select("tree", "leaf", "branch_score")
        ranked = materialise(ranked.withColumn("rank", ranking).where(F.col("rank") <= top))
        p = paths(linked, ranked)
    else:
        score = linked.select(F.col("tree").alias("t"), F.col("node").alias("n"), "s")
        p = paths(linked, leaves)
        p = p.join(score, p["tree"].eqNullSafe(score["t"]) & (p["node"] == score["n"])).select("tree", "leaf", "node", "up", "s")
        ranked = p.groupBy("tree", "leaf").agg(F.sum("s").alias("branch_score")).withColumn("rank", ranking)
    r = ranked.select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "branch_score", "rank")
    return p.join(r, p["tree"].eqNullSafe(r["t"]) & (p["leaf"] == r["l"])).select("tree", "leaf", "node", "up", "branch_score", "rank")


def chat_format(nodes: DataFrame, top: int | None = None, trained_role: str = "assistant", links: DataFrame | None = None) -> DataFrame:
    """(tree, leaf, rank, branch_score, n_turns, formatted, loss_spans): one row per chosen branch.

    nodes: (tree, node, parent, role, text, score).  Spans are (start, length) in code points.
    links: the first three columns and the score of nodes, where a cheaper plan gives them; its messages are given once each.
    """
    once = links is not None
    if not once:
        nodes = nodes.where(F.col("node").isNotNull())
        links = nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    slim = materialise(links.select("tree", "node", "parent", "score"))
    p = branches(slim, top)
    spoken = F.struct(F.concat(F.lit(OPEN), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n")).alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"), F.coalesce(F.col("role") == trained_role, F.lit(False)).alias("loss"))
    text = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), spoken.alias("turn"))
    # Trees of bounded size: their texts meet by tree, in one shuffle, and each path looks its turns up there.
    # Larger ones (and those without a name) join node by node, so no task holds such a tree.
    large = materialise(slim.groupBy("tree").count().where((F.col("count") > SMALL_TREE) | F.col("tree").isNull()).select(F.col("tree").alias("big")))
    n_large = large.count()
    near, said = p.where("tree is not null"), text.where("t is not null")
    if n_large:
        large = F.broadcast(large) if n_large <= BROADCAST_TREES else large
        near = near.join(large, F.col("tree") == F.col("big"), "left_anti")
        said = said.join(large, F.col("t") == F.col("big"), "left_anti")
    near = near.groupBy("tree", "leaf", "rank", "branch_score").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "node"))).alias("path"))
    each = F.collect_list(F.struct("n", "turn"))
    said = said.groupBy("t").agg((each if once else F.array_sort(each)).alias("each"))
    if not once:  # of a message given more than once, the least turn
        said = said.withColumn("each", F.filter("each", lambda x, i: (i == 0) | (F.get(F.col("each"), i - 1)["n"] != x["n"])))
    said = said.select("t", F.map_from_entries("each").alias("said"))
    conv = near.join(said, F.col("tree") == F.col("t")).select("tree", "leaf", "rank", "branch_score", F.transform("path", lambda x: F.col("said")[x["node"]]).alias("turns"))
    if n_large:
        if not once:
            text = text.groupBy("t", "n").agg(F.min("turn").alias("turn"))
        far, said = p.join(large, F.col("tree").eqNullSafe(F.col("big")), "left_semi"), text.join(large, F.col("t").eqNullSafe(F.col("big")), "left_semi")
        rows = far.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        rows = rows.groupBy("tree", "leaf", "rank", "branch_score").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "turn"))).alias("turns"))
        conv = conv.unionByName(rows.withColumn("turns", F.transform("turns", lambda x: x["turn"])))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    spans = F.aggregate(
        "turns", F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).cast("bigint").alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).cast("bigint").alias("start"), F.length(t["body"]).cast("bigint").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return conv.select("tree", "leaf", "rank", "branch_score", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted conversation."""
    turns = F.filter(F.split(formatted, r"\Q<|im_start|>\E"), lambda x, i: i > 0)
    return F.transform(turns, lambda x: F.struct(
        unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
        unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x) - F.length(F.substring_index(x, "\n", 1)) - 1 - len(CLOSE))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations as trees in which each turn answers the one before it (rows by turn; equal turns by role and text)."""
    w = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    n = conversations.select("conv_id", "role", "text", F.row_number().over(w).cast("long").alias("node"))
    return n.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def linear_links(conversations: DataFrame) -> DataFrame:
    """(tree, node, parent, score) of ``linear``, the same rows whichever order the turns have, without shuffling texts for it."""
    w = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first())
    n = conversations.select("conv_id", F.row_number().over(w).cast("long").alias("node"))
    return n.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings, formatted, and read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    rows = rows.unionByName(extra)
    out = chat_format(linear(rows), links=linear_links(rows))
    turns = read_back(F.col("formatted"))
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
