"""Log queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomline.operators import logs
from loomline.plans.params import DEFAULT as P
from loomline.plans.registry import add
from loomline.sources import sinks

RANGE = f"ts BETWEEN TIMESTAMP '{P.t0}' AND TIMESTAMP '{P.t1}'"
HOUR = "time_bucket(INTERVAL 1 HOUR, ts) AS time"
AS_OF = "2024-01-29 00:00:00"


add(
    "log_volume",
    lambda t: logs.volume(t.service_logs, P, logs.label("edge-.*|oeecloud")),
    f"SELECT {HOUR}, count(*) AS n FROM service_logs WHERE {RANGE} AND regexp_full_match(service, 'edge-.*|oeecloud') GROUP BY 1",
)
add(
    "log_volume_last",
    lambda t: logs.last_bucket(logs.volume(t.service_logs, P, logs.label("edge-.*|oeecloud"))),
    f"SELECT max_by(n, time) AS value FROM (SELECT {HOUR}, count(*) AS n FROM service_logs WHERE {RANGE} AND regexp_full_match(service, 'edge-.*|oeecloud') GROUP BY 1)",
)
add("log_errors", lambda t: logs.volume(t.service_logs, P, F.col("line").rlike(logs.ERRORS)), f"SELECT {HOUR}, count(*) AS n FROM service_logs WHERE {RANGE} AND regexp_matches(line, '{logs.ERRORS}') GROUP BY 1")
for key, marker in (("log_published_5m", "pubsub_pub"), ("log_received_5m", "pubsub_rcv")):
    add(
        key,
        lambda t, m=marker: logs.trailing(t.service_logs, m, AS_OF),
        f"SELECT count(*) AS value FROM service_logs WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTE AND ts <= TIMESTAMP '{AS_OF}' AND contains(line, '{marker}')",
    )
add(
    "log_volume_by_service",
    lambda t: logs.volume(t.service_logs, P, ~logs.label("loki|hasura-init"), "service"),
    f"SELECT {HOUR}, service, count(*) AS n FROM service_logs WHERE {RANGE} AND NOT regexp_full_match(service, 'loki|hasura-init') GROUP BY 1, 2",
)
FLOW = f"SELECT {HOUR}, count(*) FILTER (WHERE contains(line, 'pubsub_pub')) AS sent, count(*) FILTER (WHERE contains(line, 'pubsub_rcv')) AS received FROM service_logs WHERE {RANGE} AND (contains(line, 'pubsub_pub') OR contains(line, 'pubsub_rcv')) GROUP BY 1"
add(
    "log_flow_rate",
    lambda t: logs.flow(t.service_logs, P).select("time", F.round(F.col("sent") / 3600.0, 6).alias("sent_rate"), F.round(F.col("received") / 3600.0, 6).alias("received_rate")).withColumns({c: F.col(c).cast("double") for c in ("sent_rate", "received_rate")}),
    f"SELECT time, CAST(round(sent / 3600.0, 6) AS DOUBLE) AS sent_rate, CAST(round(received / 3600.0, 6) AS DOUBLE) AS received_rate FROM ({FLOW})",
)
add("log_flow_gap", lambda t: logs.flow(t.service_logs, P).withColumn("gap", F.col("sent") - F.col("received")), f"SELECT time, sent, received, sent - received AS gap FROM ({FLOW})")
add(
    "log_errors_warnings",
    lambda t: t.service_logs.where(logs.within("ts", P) & F.col("line").rlike(logs.TROUBLE) & F.col("line").rlike("Exception")),
    f"SELECT * FROM service_logs WHERE {RANGE} AND regexp_matches(line, '{logs.TROUBLE}') AND regexp_matches(line, 'Exception')",
)
add("log_search", lambda t: logs.search(t.service_logs, P, "oeecloud", "(?i)exception|rcv"), f"SELECT * FROM service_logs WHERE {RANGE} AND service = 'oeecloud' AND regexp_matches(line, '(?i)exception|rcv')")
add(
    "log_marker_lines",
    lambda t: t.service_logs.where(logs.within("ts", P)).where(" OR ".join(f"contains(line, '{m}')" for m in ("pubsub_pub", "pubsub_rcv", "pubsub_payload"))),
    f"SELECT * FROM service_logs WHERE {RANGE} AND (contains(line, 'pubsub_pub') OR contains(line, 'pubsub_rcv') OR contains(line, 'pubsub_payload'))",
)
add("log_service_values", lambda t: t.service_logs.select("service").distinct(), "SELECT DISTINCT service FROM service_logs")


def retained(t):
    """Lines stored by hour, the old hours dropped from disk."""
    path = f"{sinks.work_dir(t.spark)}/logs-{uuid.uuid4().hex}"
    sinks.store_logs(t.service_logs, path)
    sinks.drop_old_logs(t.spark, path, AS_OF)
    return sinks.stored_logs(t.spark, path, AS_OF)


add("log_retention", retained, f"SELECT * FROM service_logs WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR")
add(
    "src_service_logs",
    lambda t: logs.from_containers(t.service_logs.select(F.when(F.col("service") == "simulator", "other").otherwise("factory").alias("project"), F.concat(F.lit("/"), "service", F.lit("-1")).alias("name"), "service", F.lit("stdout").alias("stream"), "ts", "line"), "factory"),
    """SELECT ts, service || '-1' AS container, service, 'stdout' AS logstream, json_extract_string(line, '$.level') AS level, json_extract_string(line, '$.msg') AS msg FROM service_logs WHERE service <> 'simulator'""",
)
