"""Chat formatting of reply trees.

Messages form trees by their parent. Iterative self-joins double the reach of every message: after round
k a message knows its ancestor 2^k replies up, its depth and the sum of scores on the way, so a thread of a
million replies takes twenty rounds. Leaves are ranked by the mean score of their branch; the chosen ones
collect their path with the same tables of ancestors, each message of a path once. Only ids and scores
take part in these joins; texts join at the end.

A conversation is written as

    <|start|>role<|text|>text<|end|> ...

with ``&``, ``<``, ``[`` and ``|`` of roles and texts replaced by character references, so no control
string of this or another chat template can stand inside a text, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlake.llm.common import pick
from churnlake.session import staged

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: The reference of a character begins with ``&``, so ``&`` is replaced first and restored last.
REFERENCES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))


def escaped(value: str) -> str:
    for plain, reference in REFERENCES:
        value = f"replace({value}, '{plain}', '{reference}')"
    return value


def unescaped(value: str) -> str:
    for plain, reference in reversed(REFERENCES):
        value = f"replace({value}, '{reference}', '{plain}')"
    return value


def _reach(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (conv, node, jump) of ancestors 1, 2, 4, ... replies up, and all messages that reach a root,
    with depth and total score. A message that has reached its root takes part in later rounds only as
    others meet it, so a long thread costs rounds for its own messages alone. Messages on or below a cycle
    of parents never reach a root."""
    ids = messages.select("conv", F.col("msg").alias("node"), "parent", "score")
    known = ids.select(F.col("conv").alias("up_conv"), F.col("node").alias("up"))
    link = ids.join(known, F.expr("conv <=> up_conv AND parent = up"), "left")
    now = staged(link.selectExpr("conv", "node", "up AS jump", "1L AS depth", "score AS total"), "replies")
    tables, settled = [], now.where("jump IS NULL")
    below, open_rows = now.where("jump IS NOT NULL"), now.where("jump IS NOT NULL").count()
    while open_rows:
        tables.append(below.select("conv", "node", "jump"))
        met = below.alias("a").join(settled.unionByName(below).alias("b"), F.expr("a.conv <=> b.conv AND a.jump = b.node"))
        now = staged(
            met.selectExpr("a.conv", "a.node", "b.jump", "a.depth + b.depth AS depth", "a.total + b.total AS total"),
            "replies",
        )
        settled = settled.unionByName(now.where("jump IS NULL"))
        below, before = now.where("jump IS NOT NULL"), open_rows
        open_rows = below.count()
        if open_rows == before:  # only cycles are left
            break
    return tables, settled


def choose_branches(messages: DataFrame, branches: int = 1) -> DataFrame:
    """conv, leaf, node, place (from 0 at the root) of the ``branches`` best root-to-leaf paths of each
    conversation; equal means go to the longer path, then to the smaller leaf id.

    messages: conv, msg, parent, score (a double).
    """
    tables, reach = _reach(messages)
    parents = messages.select(F.col("conv").alias("p_conv"), F.col("parent").alias("p")).where("p IS NOT NULL")
    leaves = reach.join(parents, F.expr("conv <=> p_conv AND node = p"), "left_anti")
    best = Window.partitionBy("conv").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    paths = chosen.selectExpr("conv", "node AS leaf", "node", "depth - 1 AS place")
    for power in reversed(range(len(tables))):
        up = tables[power].alias("up")
        higher = paths.alias("x").join(up, F.expr("x.conv <=> up.conv AND x.node = up.node"))
        paths = staged(paths.unionByName(higher.selectExpr("x.conv", "x.leaf", "up.jump AS node", f"x.place - {2**power}L AS place")), "paths")
    return paths


def format_trees(
    messages: DataFrame,
    branches: int = 1,
    conv_col: str = "conv_id",
    msg_col: str = "msg_id",
    parent_col: str = "parent_id",
    role_col: str = "role",
    text_col: str = "text",
    score_col: str = "score",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """conv_id, leaf, formatted, loss array<struct<start, end>>: one conversation for each chosen path.

    loss: the character ranges of ``formatted`` that hold texts of ``loss_roles``, in order.

    A message without parent, or whose parent is missing, is a root. Null texts and roles are empty, a
    null score counts 0, and a null conversation id is a conversation of its own. Rows that repeat an id
    within a conversation are one message (the first by role and text); rows without id are left out, as
    nothing can refer to them, and so are messages on a cycle of parents. An empty table gives no rows.
    Other columns are ignored.
    """
    rows = pick(messages, conv=conv_col, msg=msg_col, parent=parent_col, role=role_col, text=text_col, score=score_col)
    rows = rows.where("msg IS NOT NULL").selectExpr(
        "conv",
        "msg",
        "parent",
        "coalesce(role, '') AS role",
        "coalesce(text, '') AS text",
        "coalesce(cast(score AS double), 0D) AS score",
    )
    one = rows.groupBy("conv", "msg").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m"))
    held = staged(one.selectExpr("conv", "msg", "m.role", "m.text", "m.parent", "m.score"), "messages")
    paths = choose_branches(held, branches).alias("p")
    turns = (
        paths.join(held.alias("m"), F.expr("p.conv <=> m.conv AND p.node = m.msg"))
        .selectExpr("p.conv", "p.leaf", "p.place", "m.role", "m.text")
        .selectExpr(
            "conv", "leaf", "place", "role", f"concat('{START}', {escaped('role')}, '{TEXT}') AS head", f"{escaped('text')} AS body"
        )
    )
    within = Window.partitionBy("conv", "leaf").orderBy("place")
    turns = turns.withColumn(
        "before", F.sum(F.expr(f"length(head) + length(body) + {len(END)}")).over(within) - F.expr(f"length(body) + {len(END)}")
    )
    in_loss = ", ".join(f"'{r}'" for r in loss_roles)
    return (
        turns.selectExpr(
            "conv",
            "leaf",
            f"struct(place, concat(head, body, '{END}') AS turn) AS piece",
            f"CASE WHEN role IN ({in_loss}) THEN struct(before AS start, before + length(body) AS end) END AS span",
        )
        .groupBy("conv", "leaf")
        .agg(F.expr("array_sort(collect_list(piece)) AS pieces"), F.expr("array_sort(collect_list(span)) AS loss"))
        .selectExpr("conv AS conv_id", "leaf", "array_join(transform(pieces, x -> x.turn), '') AS formatted", "loss")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, leaf, turns array<struct<role, text>>, loss_text, formatted of formatted conversations."""
    turn = f"split(substr(x, {len(START) + 1}), '<\\\\|text\\\\|>')"
    turns = f"""transform(
        slice(split(formatted, '<\\\\|end\\\\|>'), 1, size(split(formatted, '<\\\\|end\\\\|>')) - 1),
        x -> struct({unescaped(turn + "[0]")} AS role, {unescaped(turn + "[1]")} AS text))"""
    masked = f"transform(loss, s -> {unescaped('substr(formatted, int(s.start) + 1, int(s.end - s.start))')})"
    return formatted.selectExpr(
        "conv_id", "leaf", f"{turns} AS turns", f"array_join({masked}, '') AS loss_text", "formatted"
    )
