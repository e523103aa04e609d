"""Queries over typed settings, lists, noise filters, display texts and epochs of parsed times."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.functions import layout as Y
from chatloom.functions import text as X
from chatloom.functions import timeparse as T
from chatloom.plans.registry import query
from chatloom.sources.files import with_settings
from chatloom.sources.messages import AS_OF_MS


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("""SELECT event_id, epoch_ms(CAST(make_date(CAST(coalesce(y, 2024) AS INT), 1, 1) + to_months(CAST(coalesce(mo, 2) - 1 AS INT)) AS TIMESTAMP)) + (coalesce(d, 1) - 1) * 86400000 + h * 3600000 + mi * 60000 AS ms
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2020 + event_id % 7 END AS y, CASE WHEN event_id % 4 <> 1 THEN 1 + event_id % 12 END AS mo, CASE WHEN event_id % 4 <> 1 THEN 1 + event_id % 31 END AS d, event_id % 24 AS h, event_id % 60 AS mi FROM events)""")
def q_epoch_ms(spark, sf_dir):
    i = F.col("event_id")
    dated = i % 4 != 1
    parts = {"year": F.when(i % 3 == 0, 2020 + i % 7), "month": F.when(dated, 1 + i % 12), "day": F.when(dated, 1 + i % 31), "hour": i % 24, "minute": i % 60}
    parsed = F.struct(*(c.cast("int").alias(name) for name, c in parts.items()))
    return _events(spark, sf_dir).select("event_id", parsed.alias("p")).select("event_id", T.to_epoch_ms(F.col("p"), AS_OF_MS).alias("ms"))


_VALUES = ["42", " 7 px", "", "none", "-3", "true", "TRUE", "False", "007", "+5"]
_VALUES_SQL = ", ".join(f"'{v}'" for v in _VALUES)


@query(f"""WITH v AS (SELECT event_id, CASE WHEN event_id % 11 <> 10 THEN [{_VALUES_SQL}][CAST(event_id % 11 AS INT) + 1] END AS value FROM events)
SELECT event_id, coalesce(CASE WHEN coalesce(value, '') = '' THEN 60 ELSE TRY_CAST(regexp_extract(value, '^\\s*([+-]?[0-9]+)', 1) AS INT) END, -1000) AS number,
  CASE WHEN coalesce(value, '') = '' THEN true ELSE lower(value) = 'true' END AS flag FROM v""")
def q_typed_settings(spark, sf_dir):
    value = F.get(F.array(*map(F.lit, _VALUES)), (F.col("event_id") % 11).cast("int"))
    return _events(spark, sf_dir).select("event_id", value.alias("value")).select("event_id", F.coalesce(Y.setting_number(F.col("value"), 60), F.lit(-1000)).alias("number"), Y.setting_flag(F.col("value"), True).alias("flag"))


@query("""WITH v AS (SELECT event_id, event_type || ' , user_' || user_id || ',, ' || CASE WHEN event_id % 5 = 0 THEN '' ELSE 'x ' || event_id % 9 END AS list FROM events)
SELECT event_id, array_to_string(list_filter(list_transform(string_split(list, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM v""")
def q_csv_list(spark, sf_dir):
    last = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("x "), (F.col("event_id") % 9).cast("string")))
    text = F.concat("event_type", F.lit(" , user_"), F.col("user_id").cast("string"), F.lit(",, "), last)
    return _events(spark, sf_dir).select("event_id", F.array_join(X.csv_list(text), "|").alias("items"))


@query("SELECT doc_id, left(text, 30) AS shown, doc_id * 7 % 23 >= 10 AND doc_id % 13 >= 5 AND doc_id % 17 >= 5 AS is_box FROM documents")
def q_display_texts(spark, sf_dir):
    d, i = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id")
    return d.select("doc_id", X.truncated(F.col("text"), 30).alias("shown"), Y.is_text_box(i * 7 % 23, i % 13, i % 17).alias("is_box"))


@query("SELECT event_id, true AS in_range FROM events")
def q_random_delay(spark, sf_dir):
    delays = _events(spark, sf_dir).select("event_id", X.random_delay(200, 1200, 7).alias("ms"))
    return delays.select("event_id", F.col("ms").between(200, 1200).alias("in_range"))


@query("""WITH o AS (SELECT 'k' || user_id AS name, 'old ' || min(event_id) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY 1), n AS (SELECT 'k' || user_id AS name, 'new ' || max(event_id) AS value FROM events WHERE event_id % 3 = 0 AND user_id % 2 = 0 GROUP BY 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE name NOT IN (SELECT name FROM n)""")
def q_settings_upsert(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("name", F.concat(F.lit("k"), F.col("user_id").cast("string")))
    old = e.filter("event_id % 3 <> 0").groupBy("name").agg(F.concat(F.lit("old "), F.min("event_id").cast("string")).alias("value"))
    new = e.filter("event_id % 3 = 0 AND user_id % 2 = 0").groupBy("name").agg(F.concat(F.lit("new "), F.max("event_id").cast("string")).alias("value"))
    return with_settings(old, new)
