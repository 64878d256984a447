"""Batch twins of the streaming operators."""

from pyspark.sql import functions as F

from smeltry.catalog.registry import query
from smeltry.catalog.row_queries import HOURS_SQL, MONITOR_SQL
from smeltry.catalog.tables import each, ts
from smeltry.functions.ladders import CONSUMER_DELAY, MONITOR_DELAY
from smeltry.operators import rows as R
from smeltry.streaming import events as E

DELAYED_SQL = f"SELECT *, {HOURS_SQL.format('event_time')} AS h FROM bronze_events"
HISTOGRAM_SQL = f"""SELECT time_bucket(INTERVAL 30 SECOND, ingestion_time) AS w, 'user_activity_events' AS topic, {MONITOR_SQL} AS delay_category,
  count(*) AS messages FROM ({DELAYED_SQL}) GROUP BY ALL"""


def _histogram(w):
    e = w.bronze_events.withColumn("topic", F.lit("user_activity_events"))
    return E.delay_histogram(e, "event_time", "ingestion_time", MONITOR_DELAY)


@query(
    "delay_histogram",
    f"""SELECT {ts('w', 'window_start')}, {ts('w + INTERVAL 30 SECOND', 'window_end')}, topic, delay_category, messages FROM ({HISTOGRAM_SQL})""",
)
def _(w):
    return _histogram(w)


@query(
    "delay_totals",
    f"""SELECT topic, delay_category, CAST(sum(messages) AS BIGINT) AS messages,
      round(CAST(sum(messages) AS DOUBLE) * 100 / sum(sum(messages)) OVER (PARTITION BY topic), 4) AS percent FROM ({HISTOGRAM_SQL}) GROUP BY topic, delay_category""",
)
def _(w):
    return E.delay_totals(_histogram(w))


@query(
    "high_delay_alerts",
    f"SELECT event_id, round(h, 6) AS delay_hours, {MONITOR_SQL} AS delay_category FROM ({DELAYED_SQL}) WHERE h > 6",
)
def _(w):
    d = R.with_delay(w.bronze_events, "event_time", "ingestion_time", MONITOR_DELAY)
    return E.high_delay_alerts(d, 6.0).select("event_id", F.round("delay_hours", 6).alias("delay_hours"), "delay_category")


@query(
    "recent_high_delays",
    f"""SELECT event_id, round(h, 6) AS delay_hours FROM (SELECT * FROM ({DELAYED_SQL}) ORDER BY ingestion_time DESC, event_id LIMIT 50)
    WHERE h > 6 ORDER BY ingestion_time DESC, event_id LIMIT 5""",
)
def _(w):
    d = R.with_delay(w.bronze_events, "event_time", "ingestion_time", CONSUMER_DELAY)
    newest = [F.col("ingestion_time").desc(), F.col("event_id").asc()]
    return E.recent_high_delays(d, newest).select("event_id", F.round("delay_hours", 6).alias("delay_hours"))


LAG_SQL = """WITH envelope AS (
    SELECT topic, part, pos, ingestion_time FROM event_envelope
    UNION ALL SELECT 'marketplace_sales', quantity % 3, CAST(floor(amount * 100) AS BIGINT), ingestion_time FROM bronze_sales),
  ends AS (SELECT topic, part, max(pos) + 1 AS end_offset FROM envelope GROUP BY topic, part),
  committed AS (SELECT topic, part, max(pos) + 1 AS position FROM envelope
    WHERE topic = 'user_activity_events' AND part < 5 AND ingestion_time < TIMESTAMP '2024-01-20' GROUP BY topic, part),
  lag AS (SELECT e.topic, CAST(sum(end_offset - coalesce(position, 0)) AS BIGINT) AS total_lag, count(*) AS partitions, count(position) AS known
    FROM ends e LEFT JOIN committed c ON e.topic = c.topic AND e.part = c.part GROUP BY e.topic),
  graded AS (SELECT topic, total_lag, partitions, round(CAST(total_lag AS DOUBLE) / partitions, 4) AS avg_lag,
    CASE WHEN known = 0 THEN 'not_running' WHEN total_lag > 1000 THEN 'lagging' ELSE 'running' END AS status FROM lag)"""


def _lag(w):
    cols = ["topic", "partition", "offset", "timestamp"]
    envelope = w.event_envelope.select(*cols).unionByName(w.sales_envelope.select(*cols))
    committed = (
        envelope.filter("topic = 'user_activity_events' AND partition < 5")
        .filter(F.col("timestamp") < F.lit("2024-01-20").cast("timestamp"))
        .groupBy("topic", "partition").agg((F.max("offset") + 1).alias("position"))
    )
    return E.consumer_lag(envelope, committed, limit=1000)


@query("consumer_lag", f"{LAG_SQL} SELECT * FROM graded")
def _(w):
    return _lag(w)


@query(
    "consumer_health",
    f"""{LAG_SQL} SELECT CASE max(CASE status WHEN 'not_running' THEN 2 WHEN 'lagging' THEN 1 ELSE 0 END)
      WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS overall_status, count(*) AS topics FROM graded""",
)
def _(w):
    return E.consumer_health(_lag(w))


@query(
    "session_activity",
    f"""SELECT user_id, CAST(session_no AS BIGINT) AS session_no, {ts('min(happened)', 'session_start')}, {ts('max(happened)', 'last_event')}, count(*) AS events FROM (
      SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY happened, n ROWS UNBOUNDED PRECEDING) AS session_no FROM (
        SELECT *, CASE WHEN happened - lag(happened) OVER (PARTITION BY user_id ORDER BY happened, n) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM raw_events))
    GROUP BY user_id, session_no""",
)
def _(w):
    e = w.table("events").select("user_id", F.col("ts").cast("timestamp").alias("happened"))
    return E.session_activity(e, "user_id", "happened", "30 minutes")


@query(
    "activity_by_session",
    f"""SELECT session_id, {each(ts, 'session_start', 'last_event')}, events FROM (SELECT session_id, min(event_time) AS session_start,
      max(event_time) AS last_event, count(*) AS events FROM bronze_events GROUP BY session_id)""",
)
def _(w):
    return E.activity_by_session(w.bronze_events)
