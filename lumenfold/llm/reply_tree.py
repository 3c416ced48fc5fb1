"""Reply trees: root-to-leaf paths by self-joins, branches ranked by score, each chosen path one formatted conversation.

Replies point to their parents. Each self-join doubles how far a table of ancestors reaches (1, 2, 4 ... replies up), so a
path of n replies takes log2(n) joins; the same tables in reverse order list every ancestor of a leaf once. Only ids and
scores take part; texts join the chosen paths at the end. A path becomes one row, as a conversation is one text.

The template is ``<|turn ROLE|>TEXT<|end|>`` and a line break per turn. In roles and texts ``\\`` becomes ``\\\\`` and ``<``
becomes ``\\l``, so no text holds a control string, and :func:`parse` gives back what was formatted. The loss mask is the
list of spans of formatted text that hold the texts of one role.

Defined results: null text and role are empty; a reply whose parent is null or missing starts a tree of its own; replies
of equal score rank by the smaller leaf; replies of the null tree are a tree, replies without an id take no part; repeated (tree, node) ids are one reply, that of the least role and text;
replies in a circle have no root, and a circle that never ends is an error; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.plans.tables import cut

TURN = re.compile(r"<\|turn ([^<]*?)\|>([^<]*)<\|end\|>\n")


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<", "\\l")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "<" if m[1] == "l" else m[1], s)


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of it under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|turn {escape(role).replace('|', chr(92) + 'p')}|>", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}<|end|>\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; raises on anything else."""
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        turns.append((re.sub(r"\\(.)", lambda x: {"l": "<", "p": "|"}.get(x[1], x[1]), m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def paths(replies: DataFrame, *, best: int | None = 1, most_doublings: int = 40) -> DataFrame:
    """``tree, leaf, place, node`` of each tree's ``best`` branches (None: all) from ``tree, node, parent, score``.

    A branch's score is the sum over its replies. ``place`` counts from 0 at the root.
    """
    ids = replies.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    ids = cut(ids, "replies")
    same = ids.alias("c").join(ids.select("tree", F.col("node").alias("parent")).alias("p"), ["tree", "parent"])
    up = [cut(same.select("tree", "node", F.col("parent").alias("to")), "up0")]
    while not up[-1].isEmpty():
        if len(up) > most_doublings:
            raise ValueError("replies go round in a circle")
        a, b = up[-1].alias("a"), up[-1].select("tree", F.col("node").alias("to"), F.col("to").alias("far")).alias("b")
        up.append(cut(a.join(b, ["tree", "to"]).select("tree", "node", F.col("far").alias("to")), f"up{len(up)}"))
    leaves = ids.join(ids.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    line = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height"))
    for k in reversed(range(len(up) - 1)):
        higher = line.join(up[k], ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("height") + (1 << k)).alias("height"))
        line = cut(line.unionByName(higher), f"line{k}")
    scored = line.join(ids.select("tree", "node", "score"), ["tree", "node"])
    branches = scored.groupBy("tree", "leaf").agg(F.sum("score").alias("total"), F.max("height").alias("top"))
    if best is not None:
        order = Window.partitionBy("tree").orderBy(F.col("total").desc_nulls_last(), "leaf")
        branches = branches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return line.join(branches, ["tree", "leaf"]).select("tree", "leaf", "node", (F.col("top") - F.col("height")).alias("place"))


def conversations(replies: DataFrame, *, best: int | None = 1, learn: str = "assistant") -> DataFrame:
    """``tree, leaf, formatted, spans`` from ``tree, node, parent, score, role, text``."""
    # a null tree is a tree, too: as text it can be a key of joins
    replies = replies.withColumn("tree", F.coalesce(F.col("tree").cast("string"), F.lit("")))
    chosen = paths(replies.select("tree", "node", "parent", "score"), best=best)
    said = replies.groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("said"))
    full = chosen.join(said, ["tree", "node"]).groupBy("tree", "leaf")
    rows = full.agg(F.sort_array(F.collect_list(F.struct("place", F.col("said.role").alias("role"), F.col("said.text").alias("text")))).alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                done = [format_turns([(t["role"], t["text"]) for t in turns], learn) for turns in part["turns"]]
                yield pd.DataFrame({"tree": part["tree"], "leaf": part["leaf"], "formatted": [d[0] for d in done], "spans": [[list(s) for s in d[1]] for d in done]})

    done = rows.mapInPandas(run, "tree string, leaf long, formatted string, spans array<array<int>>")
    return done.withColumn("tree", F.expr("cast(nullif(tree, '') as long)"))


def chain(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Replies from plain conversations: every turn answers the one before it; repeated turns are turns of their own."""
    order = Window.partitionBy("tree").orderBy(F.col("_turn").asc_nulls_last(), "role", "text")
    rows = turns.select(
        F.col(conv_id).cast("long").alias("tree"), F.col(turn).alias("_turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: their turns, and all text under the loss mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tree, text, spans in zip(b["tree"], b["formatted"], b["spans"], strict=True):
                turns = parse(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                learned = unescape("".join(text[s[0] : s[1]] for s in spans))
                rows.append((tree, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    named = formatted.withColumn("tree", F.col("tree").cast("string"))
    done = named.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return done.withColumn("conv_id", F.col("conv_id").cast("long"))
