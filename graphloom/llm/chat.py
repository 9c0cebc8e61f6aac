"""Conversations from reply trees.

Messages name their parent. Root-to-leaf paths are enumerated by self-joins with doubling steps: a
table of 2^k-th ancestors is joined with itself and with the members found so far, so a tree of
depth n takes about log2 n rounds. Branches are ranked by the sum of their scores, and the
best path of each tree is formatted as one conversation with a loss mask over assistant texts.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<ROLE>>", "<</ROLE>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"\[INST\](?P<user>.*?)\[/INST\]|<<ROLE>>(?P<role>.*?)<</ROLE>>(?P<other>.*?)</s>|<s>(?P<assistant>.*?)</s>", re.S)


def escape(text: str) -> str:
    """No control string is left in the result; a backslash marks what was changed."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans under the loss mask (each assistant text, escaped)."""
    out, at, spans = [], 0, []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            parts = ("[INST]", body, "[/INST]")
        elif role == "assistant":
            parts = ("<s>", body, "</s>")
            spans.append((at + 3, at + 3 + len(body)))
        else:
            parts = ("<<ROLE>>" + escape(role) + "<</ROLE>>", body, "</s>")
        out.extend(parts)
        at += sum(map(len, parts))
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for m in _TURN.finditer(text):
        if m["user"] is not None:
            turns.append(("user", unescape(m["user"])))
        elif m["role"] is not None:
            turns.append((unescape(m["role"]), unescape(m["other"])))
        else:
            turns.append(("assistant", unescape(m["assistant"])))
    return turns


def paths(messages: DataFrame, max_rounds: int = 40) -> DataFrame:
    """tree, leaf, node, depth: every member of every root-to-leaf path (depth counts up from the leaf).

    ``messages`` holds tree, node, parent (null or unknown: a root). Parents are looked up in the
    same tree. A cycle has no leaf and gives no path.
    """
    base = messages.select("tree", "node", "parent")
    known = base.select("tree", F.col("node").alias("parent"))
    jump = cut(base.join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("up")))
    leaves = base.join(jump.select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti")
    members = cut(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("depth")))
    for k in range(max_rounds):
        if jump.isEmpty():
            break
        more = members.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("depth") + (1 << k)).alias("depth"))
        members = cut(members.unionByName(more))
        twice = jump.join(jump.select("tree", F.col("node").alias("up"), F.col("up").alias("top")), ["tree", "up"])
        jump = cut(twice.select("tree", "node", F.col("top").alias("up")))
    return members


def best_paths(messages: DataFrame, members: DataFrame) -> DataFrame:
    """tree, leaf of the highest-ranked of the ``members`` paths: the largest score sum, the smallest leaf on ties."""
    scored = members.join(messages.select("tree", "node", "score"), ["tree", "node"])
    totals = scored.groupBy("tree", "leaf").agg(F.round(F.sum(F.coalesce("score", F.lit(0.0))), 9).alias("total"))
    best = totals.groupBy("tree").agg(F.min(F.struct((-F.col("total")).alias("rank"), "leaf")).alias("best"))
    return best.select("tree", F.col("best.leaf").alias("leaf"))


def conversations(messages: DataFrame) -> DataFrame:
    """One formatted conversation for each tree: tree, formatted, loss_spans (start, end in code points).

    ``messages``: tree, node, parent, role, text, score. Null role and null text are empty; null
    score is 0. Other columns are ignored. An empty table gives an empty table.
    """
    members = paths(messages)
    on_path = members.join(best_paths(messages, members), ["tree", "leaf"])
    turns = on_path.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    whole = turns.groupBy("tree").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns")
    )

    def run(batches):
        for batch in batches:
            done = [render([(t["role"], t["text"]) for t in ts]) for ts in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in done]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(spans, kind)],
                names=["tree", "formatted", "loss_spans"],
            )

    return whole.mapInArrow(run, "tree long, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def threads(rows: DataFrame) -> DataFrame:
    """Messages of plain conversations (conv_id, turn, role, text): each replies to the one before.

    Equal turns are ordered by role and text. A null conv_id is one conversation of its own, and
    the table may hold several rows that are equal; all are kept.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return rows.select("conv_id", "turn", "role", "text").select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(-(1 << 63))).alias("tree"),
        n.alias("node"), (n - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                body = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(run, kinds).withColumn("conv_id", F.when(F.col("conv_id") != -(1 << 63), F.col("conv_id")))
