"""Queries over the time grammar, on time strings made from row numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.functions import timeparse as P
from chatloom.plans.registry import query
from chatloom.sources.messages import AS_OF_MS

# as_of is Thursday, 2024-02-01, 12:00 UTC; days are counted from 1970-01-01.
TODAY = "DATE '2024-02-01'"
FORMS = ("{h}:{mm}", "昨天 {h}:{mm}", "昨日{h}：{mm}", "周{w} {h}:{mm}", "星期{w} {h}:{mm}", "是期{w} {h}:{mm}", "{mo}月{d}日 {h}:{mm}", "{mo}/{d} {h}:{mm}", "2023/{mo}/{d} {h}:{mm}", "现在", "今天{h}:{mm}", "{mo}月{d}号{h}:{mm}0", "on {h}:{mm} we met you know")
WEEK = "一二三四五六日天"


def _sql_form(form: str) -> str:
    parts = {"h": "h", "mm": "mm", "w": "w", "mo": "mo", "d": "d"}
    out, rest = [], form
    while rest:
        if rest[0] == "{":
            name, rest = rest[1:].split("}", 1)
            out.append(parts[name])
        else:
            text, sep, tail = rest.partition("{")
            out.append("'" + text + "'")
            rest = sep + tail
    return " || ".join(out)


_FIELD_LIST = ("CAST(event_id % 26 AS STRING) AS h", "lpad(CAST(event_id % 60 AS STRING), 2, '0') AS mm", "CAST(event_id % 14 AS STRING) AS mo", "CAST(event_id % 33 AS STRING) AS d")
_FIELDS = ", ".join(_FIELD_LIST)
TIMES_SQL = f"""(SELECT id, CASE id % {len(FORMS)} {" ".join(f"WHEN {i} THEN {_sql_form(f)}" for i, f in enumerate(FORMS))} END AS time_str
  FROM (SELECT event_id AS id, {_FIELDS}, substring('{WEEK}', CAST((event_id // 13) % 8 + 1 AS INT), 1) AS w FROM events))"""


def times(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.selectExpr("event_id AS id", *_FIELD_LIST, f"substring('{WEEK}', CAST((event_id div 13) % 8 + 1 AS INT), 1) AS w")
    case = " ".join(f"WHEN {i} THEN {_sql_form(f)}" for i, f in enumerate(FORMS))
    return rows.select("id", F.expr(f"CASE id % {len(FORMS)} {case} END").alias("time_str"))


_NUMBER = " ".join(f"WHEN contains({{c}}, '{char}') THEN {n}" for char, n in P.WEEKDAYS)


def _weekday_sql(c: str) -> str:
    return f"CAST({TODAY} - CAST(((4 - (CASE {_NUMBER.format(c=c)} END) - 1) % 7 + 7) % 7 + 1 AS INT) AS DATE)"


@query(f"SELECT id, CASE {_NUMBER.format(c='time_str')} END AS number, {_weekday_sql('time_str')} AS day FROM {TIMES_SQL} WHERE regexp_matches(time_str, '周|期')")
def q_weekday_resolve(spark, sf_dir):
    t = times(spark, sf_dir).filter(F.col("time_str").rlike("周|期"))
    n = P.weekday_number(F.col("time_str"))
    return t.select("id", n.alias("number"), P.weekday_date(n, AS_OF_MS).alias("day"))


def checkpoint_sql(weekday_words: str, now_rule: str) -> str:
    return f"""WITH t AS (SELECT id, time_str, trim(time_str) AS c FROM {TIMES_SQL}),
k AS (SELECT *, coalesce(TRY_CAST(regexp_extract(c, '([0-9]{{1,2}}):([0-9]{{2}})', 1) AS INT), 0) AS hour, coalesce(TRY_CAST(regexp_extract(c, '([0-9]{{1,2}}):([0-9]{{2}})', 2) AS INT), 0) AS minute,
  CASE WHEN contains(c, '昨天') OR contains(c, '昨日') THEN 'y' WHEN regexp_matches(c, '{weekday_words}') THEN 'w'
    WHEN regexp_matches(c, '[0-9]{{4}}[/-][0-9]{{1,2}}[/-][0-9]{{1,2}}') THEN 'f' WHEN regexp_matches(c, '[0-9]{{1,2}}[/月][0-9]{{1,2}}') THEN 'm' ELSE 't' END AS kind FROM t),
p AS (SELECT *, CASE kind WHEN 'y' THEN {TODAY} - 1 WHEN 'w' THEN {_weekday_sql('c')} END AS day0,
  CASE kind WHEN 'f' THEN CAST(regexp_extract(c, '([0-9]{{4}})[/-]([0-9]{{1,2}})[/-]([0-9]{{1,2}})', 1) AS INT) ELSE 2024 END AS y,
  CASE kind WHEN 'f' THEN CAST(regexp_extract(c, '([0-9]{{4}})[/-]([0-9]{{1,2}})[/-]([0-9]{{1,2}})', 2) AS INT) WHEN 'm' THEN CAST(regexp_extract(c, '([0-9]{{1,2}})[/月]([0-9]{{1,2}})', 1) AS INT) ELSE 2 END AS m,
  CASE kind WHEN 'f' THEN CAST(regexp_extract(c, '([0-9]{{4}})[/-]([0-9]{{1,2}})[/-]([0-9]{{1,2}})', 3) AS INT) WHEN 'm' THEN CAST(regexp_extract(c, '([0-9]{{1,2}})[/月]([0-9]{{1,2}})', 2) AS INT) ELSE 1 END AS d FROM k),
x AS (SELECT *, (CAST(coalesce(CAST(day0 AS DATE), CAST(make_date(y, 1, 1) + to_months(m - 1) AS DATE) + (d - 1)) AS DATE) - DATE '1970-01-01') AS days FROM p)
SELECT id, time_str, {now_rule} AS epoch_ms, hour, minute FROM x"""


_WALL = "CAST(days AS BIGINT) * 86400000 + hour * 3600000 + minute * 60000"
_NOW = f"CASE WHEN kind = 't' AND NOT regexp_matches(c, '[0-9]{{1,2}}:[0-9]{{2}}') THEN {AS_OF_MS} ELSE {_WALL} END"


@query(checkpoint_sql("周|是期|星期", _NOW))
def q_checkpoint_epoch(spark, sf_dir):
    t = times(spark, sf_dir).withColumn("c", P.checkpoint(F.col("time_str"), AS_OF_MS))
    return t.select("id", "time_str", "c.epoch_ms", "c.hour", "c.minute")


@query(checkpoint_sql("周|是期", _WALL))
def q_checkpoint_parity(spark, sf_dir):
    t = times(spark, sf_dir).withColumn("c", P.checkpoint(F.col("time_str"), AS_OF_MS, strict_parity=True))
    return t.select("id", "time_str", "c.epoch_ms", "c.hour", "c.minute")


@query(checkpoint_sql("周|是期|星期", f"CASE WHEN kind IN ('f', 'm') AND (y = 0 OR m = 0 OR d = 0) THEN 1706745600000 + hour * 3600000 + minute * 60000 ELSE {_NOW} END").replace("epoch_ms, hour, minute FROM x", "message_ms FROM x"))
def q_message_ts(spark, sf_dir):
    return times(spark, sf_dir).select("id", "time_str", P.message_epoch(F.col("time_str"), AS_OF_MS).alias("message_ms"))


_CLOCK = "([0-9]{1,2})[:：]([0-9]{2})"
_RULES = {
    "cjk": f"^([0-9]{{1,2}})月([0-9]{{1,2}})[日号][^0-9]*{_CLOCK}([^0-9]|$)",
    "before": f"^(昨天|昨日)[^0-9]*{_CLOCK}([^0-9]|$)",
    "weekday": f"^(周|星期)([一二三四五六日天])[^0-9]*{_CLOCK}([^0-9]|$)",
    "alone": "^([0-9]{1,2})[:：]([0-9]{2})$",
}


def _group(rule: str, i: int) -> str:
    return f"TRY_CAST(regexp_extract(c, '{_RULES[rule]}', {i}) AS INT)"


def _fits(rule: str, hour: int, more: str = "") -> str:
    return f"regexp_matches(c, '{_RULES[rule]}') AND {_group(rule, hour)} BETWEEN 0 AND 23 AND {_group(rule, hour + 1)} BETWEEN 0 AND 59{more}"


@query(f"""WITH t AS (SELECT id, time_str, replace(time_str, ' ', '') AS c FROM {TIMES_SQL}),
r AS (SELECT *, CASE WHEN NOT (regexp_matches(c, '{_CLOCK}([^0-9]|$)') AND length(c) <= 20 AND (regexp_matches(c, '[月日号昨天今周星期]') OR regexp_matches(c, '^[0-9]{{1,2}}:[0-9]{{2}}$'))) THEN ''
  WHEN {_fits("cjk", 3, f" AND {_group('cjk', 1)} BETWEEN 1 AND 12 AND {_group('cjk', 2)} BETWEEN 1 AND 31")} THEN 'cjk' WHEN {_fits("before", 2)} THEN 'before' WHEN {_fits("weekday", 3)} THEN 'weekday' WHEN {_fits("alone", 1)} THEN 'alone' ELSE '' END AS rule FROM t),
w AS (SELECT *, CASE rule WHEN 'before' THEN CAST({TODAY} - 1 AS DATE) WHEN 'weekday' THEN {_weekday_sql("regexp_extract(c, '^(周|星期)(.)', 2)")} END AS day0 FROM r)
SELECT id, time_str, CASE rule WHEN 'cjk' THEN {_group("cjk", 3)} WHEN 'before' THEN {_group("before", 2)} WHEN 'weekday' THEN {_group("weekday", 3)} WHEN 'alone' THEN {_group("alone", 1)} END AS hour,
  CASE rule WHEN 'cjk' THEN {_group("cjk", 4)} WHEN 'before' THEN {_group("before", 3)} WHEN 'weekday' THEN {_group("weekday", 4)} WHEN 'alone' THEN {_group("alone", 2)} END AS minute,
  CASE rule WHEN 'cjk' THEN {_group("cjk", 1)} ELSE month(day0) END AS month, CASE rule WHEN 'cjk' THEN {_group("cjk", 2)} ELSE day(day0) END AS day, year(day0) AS year FROM w""")
def q_parse_timestamp(spark, sf_dir):
    t = times(spark, sf_dir).withColumn("p", P.parse_timestamp(F.col("time_str"), AS_OF_MS))
    return t.select("id", "time_str", "p.hour", "p.minute", "p.month", "p.day", "p.year")
