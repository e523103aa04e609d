"""Tolerant reading of recognition output.

In order: the whole text as JSON, a fenced block, the outermost braces, the balanced "messages" array of a text cut short,
and nothing.  Built-in JSON functions take text after the value, so the strict steps run as one Arrow function.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The room's default name, the fields, and the patterns that find JSON in prose.
UNKNOWN_ROOM = "未知群聊"
RECOGNIZED = "struct<roomName:string,messages:array<struct<index:int,sender:string,content:string,time:string,type:string,bounds:struct<x:int,y:int,w:int,h:int>>>>"
EMPTY = json.dumps({"roomName": UNKNOWN_ROOM, "messages": []}, ensure_ascii=False, separators=(",", ":"))
_FENCED = re.compile(r"```json?\s*([\s\S]*?)\s*```")
_BRACES = re.compile(r"\{[\s\S]*\}")
_ARRAY = re.compile(r'"messages"\s*:\s*(\[[\s\S]*)$')


def _balanced(text: str) -> str | None:
    """The bracketed text at the start, counting brackets wherever they stand."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "[") - (c == "]")
        if not depth:
            return text[: i + 1]
    return None


def _no_number(name: str) -> object:
    raise ValueError(f"{name} is no JSON")


def _is_json(text: str | None) -> bool:
    """``null`` is JSON like any other value."""
    try:
        json.loads(text or "", parse_constant=_no_number)
    except ValueError:
        return False
    return True


def recover(text: str | None) -> tuple[int, str]:
    """(step, JSON) of one output."""
    if not text:
        return 5, EMPTY
    if _is_json(text):
        return 1, text
    for step, pattern, group in ((2, _FENCED, 1), (3, _BRACES, 0)):
        found = pattern.search(text)
        if found and _is_json(found[group]):
            return step, found[group]
    found = _ARRAY.search(text)
    array = _balanced(found[1]) if found else None
    if array and _is_json(array):
        return 4, f'{{"roomName":"{UNKNOWN_ROOM}","messages":{array}}}'
    return 5, EMPTY


@F.arrow_udf(T.StructType([T.StructField("step", T.IntegerType()), T.StructField("json", T.StringType())]))
def _recover(texts: pa.Array) -> pa.Array:
    rows = [recover(t) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], ["step", "json"])


def recognized(outputs: DataFrame, text: str = "response") -> DataFrame:
    """``outputs`` with step and recognized: struct<roomName, messages>."""
    rows = outputs.withColumn("_r", _recover(F.col(text)))
    parsed = F.from_json(F.col("_r.json"), RECOGNIZED)
    return rows.select(*outputs.columns, F.col("_r.step").alias("step"), parsed.alias("recognized"))


def message_rows(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per recognised message, in order; outputs without messages give none."""
    rows = parsed.select(*keys, F.coalesce("recognized.roomName", F.lit(UNKNOWN_ROOM)).alias("room_name"), F.posexplode("recognized.messages").alias("pos", "m"))
    return rows.select(*keys, "room_name", "pos", F.coalesce("m.index", F.lit(0)).alias("msg_index"), "m.sender", "m.content", "m.time")


def raw_data(message: Column, as_of_ms: int, provider: str) -> Column:
    """JSON of a message with when and by what it was recognised."""
    return F.to_json(F.struct(message["index"].alias("index"), message["sender"].alias("sender"), message["content"].alias("content"), message["time"].alias("time"), F.lit(as_of_ms).alias("recognizedAt"), F.lit(provider).alias("provider")))
