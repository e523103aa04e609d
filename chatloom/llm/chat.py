"""Chat formatting from reply trees.

Messages with parents form trees.  Iterative self-joins with pointer doubling go up from every message: step k joins the
table of ancestors 2**k up with itself and adds up scores and lengths on the way, so a thread of a thousand replies
takes ten joins.  Branches are ranked by the mean score of their messages, and only the paths of the chosen leaves are
listed, by the same tables from the highest step down; each is formatted as one conversation.

Only narrow identifiers go through the joins; texts join the chosen paths at the end.

A turn is ``<|turn|>role\\ntext<|/turn|>``.  Inside roles and texts a backslash is doubled and every control string
is broken by a backslash after its first character, so none occurs there; taking each backslash-escaped character
for itself gives the text back.  The loss mask lists the spans (code points) of assistant texts.

Defined results: null roles and texts are empty; a message whose parent is missing is a root; messages of a cycle and
replies to them are on no path; repeated rows of a message count once, the least by role and text; null scores are 0; ties of branches
go to the smallest leaf; a null tree is a tree of its own; a very long text is a part of its one conversation; an empty table
gives no conversations; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.llm.batches import as_arrow, column
from chatloom.session import written

CONTROL = ("<|turn|>", "<|/turn|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = CONTROL[:2]
_FIND = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))


def escape(text: str) -> str:
    return _FIND.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the (start, length) spans of its loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        if not part.startswith(OPEN):
            raise ValueError("a turn doesn't begin with its mark")
        role, body = part[len(OPEN) :].split("\n", 1)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)
        turns.append((role, unescape(body)))
    return turns


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables (node, above) of ancestors 2**k up, and (node, total, length) of every node that reaches a root.

    ``nodes``: node, parent (null at roots), score.  While roots are reached, each table of ancestors is smaller than the
    last; nodes that are left when it stays as large lead into a cycle.
    """
    here = nodes.select(F.col("node").alias("above"), F.lit(True).alias("known"))
    rows = nodes.select("node", F.col("parent").alias("above"), F.col("score").alias("total"), F.lit(1).cast("long").alias("length"))
    rows = rows.join(here, "above", "left").select("node", F.when(F.col("known"), F.col("above")).alias("above"), "total", "length")
    rows = written(rows, "chat-up-0")
    done, open_rows = rows.filter("above IS NULL"), rows.filter("above IS NOT NULL")
    jumps, left = [open_rows.select("node", "above")], [open_rows.count()]
    while left[-1] and (len(left) == 1 or left[-1] < left[-2]):
        higher = done.unionByName(open_rows).select(F.col("node").alias("above"), F.col("above").alias("next"), F.col("total").alias("more"), F.col("length").alias("longer"))
        rows = open_rows.join(higher, "above").select("node", F.col("next").alias("above"), (F.col("total") + F.col("more")).alias("total"), (F.col("length") + F.col("longer")).alias("length"))
        rows = written(rows, f"chat-up-{len(jumps)}")
        done, open_rows = done.unionByName(rows.filter("above IS NULL")), rows.filter("above IS NOT NULL")
        jumps.append(open_rows.select("node", "above"))
        left.append(open_rows.count())
    return jumps, done.drop("above")


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` paths of every tree: (tree, leaf, branch, turn, role, text).

    ``messages``: tree, node, parent, role, text, score; nodes are unique within their tree, and parents are of the same tree.
    """
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    one = F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent", score)).alias("m")
    nodes = messages.select("tree", "node", "parent", "role", "text", "score").groupBy("tree", "node").agg(one)
    place = F.struct("tree", F.col("m.parent").alias("node"))
    nodes = nodes.select(F.struct("tree", "node").alias("node"), F.when(F.col("m.parent").isNotNull(), place).alias("parent"), "m.role", "m.text", "m.score")
    nodes = written(nodes, "chat-nodes")
    jumps, scored = ancestors(nodes.select("node", "parent", "score"))
    leaves = scored.join(jumps[0].select(F.col("above").alias("node")).distinct(), "node", "left_anti")
    order = W.partitionBy("node.tree").orderBy(F.desc(F.col("total") / F.col("length")), F.desc("length"), "node.node")
    best = leaves.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= branches)
    paths = written(best.select(F.col("node").alias("leaf"), "branch", "node", (F.col("length") - 1).alias("turn")), "chat-leaves")
    for k in reversed(range(len(jumps) - 1)):
        higher = paths.join(jumps[k], "node").select("leaf", "branch", F.col("above").alias("node"), (F.col("turn") - (1 << k)).alias("turn"))
        paths = paths.unionByName(written(higher, f"chat-higher-{k}"))
    turns = paths.join(nodes.select("node", "role", "text"), "node")
    return turns.select("leaf.tree", F.col("leaf.node").alias("leaf"), "branch", "turn", "role", "text")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    schema = pa.schema([("tree", pa.int64()), ("leaf", pa.int64()), ("branch", pa.int32()), ("formatted", pa.string()), ("loss_spans", span)])
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            formatted, spans = format_turns([(t["role"], t["text"]) for t in row["turns"]])
            rows.append({"tree": row["tree"], "leaf": row["leaf"], "branch": row["branch"], "formatted": formatted, "loss_spans": [{"start": a, "length": n} for a, n in spans]})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def format_chats(messages: DataFrame, branches: int = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, branch, formatted, loss_spans.  A conversation is one value, as its output is."""
    turns = reply_paths(messages, branches).groupBy("tree", "leaf", "branch").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.mapInArrow(_format, "tree long, leaf long, branch int, formatted string, loss_spans array<struct<start:long,length:long>>")


_READ = "tree long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = as_arrow(_READ)
    for batch in batches:
        rows = []
        for tree, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("tree", "formatted", "loss_spans")), strict=True):
            turns = parse_turns(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["start"] + s["length"]]) for s in spans)
            every = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((tree, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_chats(chats: DataFrame) -> DataFrame:
    """What the formatted conversations and their loss masks hold: counts and digests."""
    return chats.select("tree", "formatted", "loss_spans").mapInArrow(_read_back, _READ)


def threads(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plain conversations as reply trees of one branch: each turn replies to the one before it (by turn, role and text)."""
    rows = rows.select(column(conversation).cast("long").alias("tree"), column(turn).alias("turn"), column(role).alias("role"), column(text).alias("text"))
    nth = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    rows = rows.withColumn("node", nth)
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
