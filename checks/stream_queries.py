"""Streaming queries next to SQL over the same whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.audit_queries import LINES
from gridmark.streaming import incremental


def table_stream(spark, sf_dir, name):
    """One of the given tables as a file stream."""
    schema = v.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def stream_audit_counts(spark, sf_dir):
    lines = v.as_label_text(table_stream(spark, sf_dir, "lineitem"))
    return incremental.run_once(incremental.audit_counts(lines), "update", keys=["violation_type", "severity"])


def stream_dedup(spark, sf_dir):
    """First arrival per content; which arrival is kept is open, so only contents are compared."""
    events = table_stream(spark, sf_dir, "events").select(
        F.sha2(F.encode("props", "UTF-8"), 256).alias("sha256"), F.col("ts").cast("timestamp").alias("ts")
    )
    return incremental.run_once(incremental.dedup_stream(events, delay="3650 days")).select("sha256")


def stream_frame_sampling(spark, sf_dir):
    """First event of every user an hour, as a camera's first frame an interval."""
    frames = table_stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value"
    )
    sampled = incremental.first_frames(frames, ["stream_id"], interval="1 hour", delay="2 hours", ties=("event_id",))
    done = incremental.run_once(sampled, "update", keys=["stream_id", "window_start", "window_end"])
    return done.withColumns({"window_start": F.unix_timestamp("window_start"), "ts": F.unix_micros("ts")}).drop("window_end")


QUERIES = {"stream_audit_counts": stream_audit_counts, "stream_dedup": stream_dedup, "stream_frame_sampling": stream_frame_sampling}
SQL = {
    "stream_audit_counts": f"""WITH {LINES} SELECT violation_type,
      CASE WHEN violation_type = 'degenerate_box' THEN 'WARNING' WHEN violation_type IS NOT NULL THEN 'ERROR' END AS severity,
      count(*) AS n FROM v_audit GROUP BY 1, 2""",
    "stream_frame_sampling": """SELECT user_id AS stream_id, epoch_us(ts) // 3600000000 * 3600 AS window_start, epoch_us(ts) AS ts,
      event_id, event_type, value, count(*) OVER w AS frames FROM events
      WINDOW w AS (PARTITION BY user_id, epoch_us(ts) // 3600000000)
      QUALIFY row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) = 1""",
    "stream_dedup": "SELECT DISTINCT sha256(props) AS sha256 FROM events",
}
