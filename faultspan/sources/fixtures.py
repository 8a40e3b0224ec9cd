"""Error events, edges, requests and logs made of the driver's `events` table, as columns that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EVENT = {
    "id": "event_id + 1",
    "event_id": "concat('evt-', lpad(CAST(event_id AS STRING), 10, '0'))",
    "ts": "CAST(ts AS TIMESTAMP)",
    "application": "concat('app-', CAST(user_id % 5 AS STRING))",
    "version": "concat('1.', CAST(k % 4 AS STRING))",
    "environment": "CASE user_id % 4 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' WHEN 2 THEN 'dev' ELSE 'ci' END",
    "command": "CASE WHEN k % 3 = 0 THEN 'serve' WHEN k % 3 = 1 THEN 'worker' ELSE NULL END",
    "subsystem": "event_type",
    "hostname": "CASE WHEN user_id % 20 = 0 THEN NULL ELSE concat('host-', CAST(user_id % 20 AS STRING)) END",
    "severity": "CASE WHEN event_type = 'error' AND k >= 90 THEN 'fatal' WHEN event_type = 'error' AND k >= 75 THEN 'critical' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'warn' WHEN event_type = 'signup' THEN 'info' WHEN event_type = 'view' THEN 'debug' ELSE 'trace' END",
    "category": "CASE WHEN k % 11 = 0 THEN 'application.validation' WHEN k % 11 = 1 THEN 'dns_error' ELSE NULL END",
    "error_code": "CASE k % 10 WHEN 0 THEN 'ETIMEDOUT' WHEN 1 THEN 'ECONNREFUSED' WHEN 2 THEN 'ENOTFOUND' WHEN 3 THEN 'ENOMEM' ELSE NULL END",
    "exception": "CASE k % 7 WHEN 0 THEN 'panic' WHEN 1 THEN 'IOException' WHEN 2 THEN 'TimeoutError' ELSE NULL END",
    "message": "CASE k % 6 WHEN 0 THEN concat('Disk Full on volume-', CAST(k % 3 AS STRING)) WHEN 1 THEN 'worker killed: Out of Memory in module.core.step' WHEN 2 THEN concat('login rejected password=hunter', CAST(k AS STRING), ' at api/v2/login') WHEN 3 THEN concat('cannot reach postgres://svc:s3cret', CAST(k AS STRING), '@db-1:5432/main') WHEN 4 THEN 'connection refused ECONNREFUSED while calling api/v2/users' ELSE 'timeout waiting for upstream dns lookup' END",
    "stacktrace": "CASE WHEN k % 2 = 0 THEN concat('at step (core.rs:', CAST(k AS STRING), ')', chr(10), 'at main (core.rs:7)') ELSE NULL END",
    "correlation_id": "CASE WHEN k % 2 = 0 THEN concat('req-', CAST(event_id - event_id % 50 AS STRING)) ELSE NULL END",
    "parent_event_id": "CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 <= 5 THEN concat('evt-', lpad(CAST(event_id - 1 AS STRING), 10, '0')) ELSE concat('evt-', lpad(CAST(event_id - event_id % 10 AS STRING), 10, '0')) END",
    "resolved_at": "CASE WHEN event_id % 3 = 0 THEN CAST(ts AS TIMESTAMP) + INTERVAL '1' HOUR * (k % 5 + 1) ELSE NULL END",
    "context": """concat('{"pid":', CAST(1000 + user_id AS STRING), ',"request_id":"r', CAST(event_id % 97 AS STRING), '","duration_ms":', CAST(k * 3 AS STRING), '}')""",
    "metadata": """concat('{"user_email":"u', CAST(user_id AS STRING), '@mail.example.com"}')""",
}
_EDGE = {
    "src_event_id": "concat('evt-', lpad(CAST(event_id - event_id % 50 AS STRING), 10, '0'))",
    "dst_event_id": "concat('evt-', lpad(CAST(event_id AS STRING), 10, '0'))",
    "rel": "CASE WHEN event_id % 25 = 0 THEN 'correlated' ELSE 'retry_of' END",
}
_REQUEST = {
    "request_id": "event_id",
    "received_at": "CAST(ts AS TIMESTAMP)",
    "remote_addr": "CASE WHEN user_id % 13 = 0 THEN '10.0.0.9' WHEN user_id % 3 = 0 THEN '::1' ELSE '127.0.0.1' END",
    "origin": "CASE WHEN user_id % 7 = 0 THEN 'https://evil.example' ELSE concat('https://app', CAST(user_id % 3 AS STRING), '.example') END",
    "user_agent": "concat('agent/', CAST(user_id % 4 AS STRING))",
    "body": """CASE WHEN event_id % 17 = 0 THEN '{broken' ELSE concat('{"application":"web","events":[{"message":"boom ', CAST(k AS STRING), '","severity":"', CASE WHEN event_id % 2 = 0 THEN 'fatal' ELSE 'warn' END, '","error_code":"E', CAST(k AS STRING), '","tags":["a",7,null,{"x":1},"b"],"context":{"url":"/p/', CAST(k AS STRING), '","n":1}},{"message":"second"}]}') END""",
}
_HTTP = {
    "request_id": "event_id",
    "ts": "CAST(ts AS TIMESTAMP)",
    "application": "concat('svc-', CAST(user_id % 5 AS STRING))",
    "method": "CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END",
    "url": "concat('https://api.example/v2/users/', CAST(user_id AS STRING), '?page=1')",
    "status": "CASE event_type WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN NULL ELSE 503 END WHEN 'purchase' THEN 409 WHEN 'signup' THEN 429 ELSE 200 END",
    "body": """CASE WHEN event_type = 'purchase' THEN concat('{"error":{"code":"CONFLICT","message":"version ', CAST(event_id % 9 AS STRING), '"}}') ELSE 'plain text' END""",
    "correlation_id": "concat('req-', CAST(event_id - event_id % 50 AS STRING))",
    "latency_ms": "CAST(floor(value * 10) AS INT)",
}
_CLOSE = {
    "close_id": "event_id",
    "ts": "CAST(ts AS TIMESTAMP)",
    "code": "CASE event_id % 5 WHEN 0 THEN 1000 WHEN 1 THEN 1001 WHEN 2 THEN 1005 WHEN 3 THEN 1006 ELSE 1011 END",
    "was_clean": "event_id % 4 = 0",
    "auth_reason": "CASE WHEN event_id % 6 = 0 THEN 'auth' ELSE NULL END",
}
_RESOLUTION = {
    "event_id": "concat('evt-', lpad(CAST(event_id AS STRING), 10, '0'))",
    "resolved_at": "CAST(ts AS TIMESTAMP) + INTERVAL '2' HOUR",
    "force": "event_id % 8 = 0",
}
_WHERE = {"error_edges": "event_id % 50 <> 0 AND event_id % 5 = 0", "resolutions": "event_id % 4 = 0"}
TABLES = {"error_events": _EVENT, "error_edges": _EDGE, "ingest_requests": _REQUEST, "http_log": _HTTP, "ws_close_log": _CLOSE, "resolutions": _RESOLUTION}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.expr("CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"))
    rows = base.where(_WHERE.get(name, "true")).selectExpr(*(f"{e} AS `{c}`" for c, e in TABLES[name].items()))
    return rows.withColumn("tags", F.array("subsystem", "environment")) if name == "error_events" else rows


def sql(name: str) -> str:
    """The same table in DuckDB."""
    tags = ", [event_type, CASE user_id % 4 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' WHEN 2 THEN 'dev' ELSE 'ci' END] AS tags" if name == "error_events" else ""
    columns = ", ".join(f"{e} AS {c}" for c, e in TABLES[name].items())
    return f"SELECT {columns}{tags} FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) b WHERE {_WHERE.get(name, 'true')}"
