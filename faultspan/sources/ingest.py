"""Raw records to events: SDK payloads, untrusted browser batches, HTTP outcomes, socket closes, client failures, causes, log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultspan.functions.columns import clamped, clamped_context, clamped_severity, parsed_severity, with_keys

PAYLOAD = "application string, message string, severity string, version string, environment string, category string, error_code string, exception string, stacktrace string, correlation_id string, parent_event_id string, context string, tags array<string>, metadata string"
BATCH = "application string, events array<struct<message:variant,severity:string,exception:variant,stacktrace:variant,error_code:variant,correlation_id:variant,tags:variant,context:string>>"
#: Longest texts that an untrusted event may have.
LONGEST = {"message": 2000, "exception": 200, "stacktrace": 8000, "error_code": 100, "correlation_id": 100}
LONGEST_TAG, LONGEST_URL, LONGEST_AGENT = 50, 2000, 500


def sdk_payloads(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Events of JSON payloads, and the rejected ones with the reason; application and message are needed."""
    x = raw.withColumn("p", F.from_json(body, PAYLOAD))
    empty = lambda c: F.coalesce(F.trim(F.col(f"p.{c}")), F.lit("")) == ""
    is_json = F.coalesce(F.try_parse_json(body).isNotNull(), F.lit(False))
    x = x.withColumn("reason", F.when(~is_json, "not JSON").when(empty("application"), "no application").when(empty("message"), "no message"))
    good = x.where("reason IS NULL").select(*(c for c in raw.columns if c != body), "p.*")
    return good.withColumn("severity", parsed_severity("severity")), x.where("reason IS NOT NULL").select(*raw.columns, "reason")


def guard(raw: DataFrame, allowed_origins: list[str], max_bytes: int = 65_536, limited: Column | None = None) -> DataFrame:
    """Add status: 403 for a remote address that isn't this machine's or an origin that isn't allowed, 429, 413, 400, else 202, in this order."""
    local = F.col("remote_addr").isNull() | F.col("remote_addr").isin("127.0.0.1", "::1", "::ffff:127.0.0.1")
    x = F.try_parse_json("body")
    status = F.when(~local, 403).when(~F.coalesce(F.col("origin").isin(allowed_origins), F.lit(False)), 403)
    if limited is not None:
        status = status.when(limited, 429)
    status = status.when(F.octet_length("body") > max_bytes, 413).when(x.isNull() | ~F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)), 400)
    return raw.withColumn("status", status.otherwise(202))


def browser_batches(guarded: DataFrame, application: str, max_batch: int = 20) -> DataFrame:
    """Events of accepted batches, each text clamped; the application is the endpoint's, not the body's."""
    x = guarded.where("status = 202").withColumn("p", F.from_json("body", BATCH))
    x = x.select("request_id", "received_at", "user_agent", F.posexplode(F.slice("p.events", 1, max_batch)).alias("place", "e"))
    # what isn't a string is no text
    text = {c: clamped(F.when(F.schema_of_variant(F.col(f"e.{c}")) == "STRING", F.try_variant_get(F.col(f"e.{c}"), "$", "string")), n) for c, n in LONGEST.items()}
    text["message"] = F.coalesce(F.nullif(text["message"], F.lit("")), F.lit("browser error"))
    # tags that are no strings are left out, and no array of tags is none
    given = F.try_variant_get(F.col("e.tags"), "$", "array<variant>")
    own = F.transform(F.filter(given, lambda t: F.schema_of_variant(t) == "STRING"), lambda t: F.try_variant_get(t, "$", "string"))
    tags = F.concat(F.array(F.lit("browser")), F.coalesce(F.transform(F.slice(own, 1, 5), lambda t: clamped(t, LONGEST_TAG)), F.array().cast("array<string>")))
    own_url = F.try_variant_get(F.try_parse_json(F.col("e.context")), "$.url", "variant")
    url = clamped(F.when(F.schema_of_variant(own_url) == "STRING", F.try_variant_get(own_url, "$", "string")), LONGEST_URL)
    agent = clamped("user_agent", LONGEST_AGENT)
    context = clamped_context(F.col("e.context"), more={"url": url, "ua": agent})
    return x.select("request_id", "place", F.col("received_at").alias("ts"), F.lit(application).alias("application"), clamped_severity(F.col("e.severity")).alias("severity"), *(c.alias(n) for n, c in text.items()), tags.alias("tags"), context.alias("context"), url.alias("url"), agent.alias("user_agent"))


def http_outcomes(log: DataFrame, body_chars: int = 4096) -> DataFrame:
    """Events of failed requests: a status of 400 or more, or none at all."""
    status, code = F.col("status"), F.get_json_object("body", "$.error.code")
    told = F.get_json_object("body", "$.error.message")
    unreachable = status.isNull()
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    again = unreachable | (status >= 500) | status.isin(408, 429)
    kind = F.when(unreachable, "upstream-unreachable").when(status >= 500, "upstream-5xx").otherwise("upstream-4xx")
    message = F.concat(F.col("method"), F.lit(" "), path, F.lit(" → "), F.coalesce(status.cast("string"), F.lit("unreachable")), F.when(told.isNotNull(), F.concat(F.lit(" ("), told, F.lit(")"))).otherwise(""))
    new_id = F.substring(F.sha2(F.concat_ws("\x1f", "request_id", F.unix_micros("ts"), "method", "url"), 256), 1, 32)  # the same when a task is repeated
    context = F.to_json(F.struct(F.struct("method", path.alias("path"), "status").alias("http"), F.struct("latency_ms").alias("timing"), F.struct(clamped("body", body_chars).alias("body")).alias("upstream")))
    return log.where(unreachable | (status >= 400)).select(
        "request_id", "ts", "application", F.when(unreachable | (status >= 500), "error").otherwise("warn").alias("severity"),
        F.when(unreachable, "UPSTREAM_UNREACHABLE").otherwise(F.coalesce(code, F.concat(F.lit("HTTP_"), status.cast("string")))).alias("error_code"),
        message.alias("message"), F.array_compact(F.array(F.lit("fetch"), kind, F.when(again, F.lit("retryable")))).alias("tags"), F.coalesce("correlation_id", new_id).alias("correlation_id"), context.alias("context"),
    )


def socket_closes(log: DataFrame, only_unclean: bool = False) -> DataFrame:
    """Events of closes with other codes than 1000 and 1001; with only_unclean, not of clean ones."""
    odd = ~F.col("code").isin(1000, 1001) & ((~F.col("was_clean")) if only_unclean else F.lit(True))
    code = F.when(F.col("auth_reason").isNotNull(), "COLLAB_AUTH_FAILED").otherwise(F.concat(F.lit("WS_CLOSE_"), F.col("code").cast("string")))
    return log.where(odd).select("close_id", "ts", code.alias("error_code"), F.concat(F.lit("websocket closed: "), F.col("code").cast("string")).alias("message"), F.lit("error").alias("severity"))


def client_failures(log: DataFrame) -> DataFrame:
    """Events of failed queries and mutations (kind, error_message, error_code, status, correlation_id, submitted_ms, updated_ms, http_latency_ms)."""
    own = F.col("updated_ms") - F.col("submitted_ms")
    latency = F.coalesce("http_latency_ms", F.when(own >= 0, own))
    return log.withColumns({"latency_ms": latency, "tags": F.array(F.lit("react-query"), F.when(F.col("kind") == "mutation", "mutation").otherwise("query")), "severity": F.lit("error"), "message": F.col("error_message")})


def flattened_causes(df: DataFrame, causes: str = "causes", most: int = 10) -> DataFrame:
    """Write an array of causes (code, name, message), outermost first, under the stack, and the deepest one as the root cause and in the context, unless there is one."""
    c = F.slice(causes, 1, most)
    line = F.transform(c, lambda x: F.concat(F.lit("Caused by: "), F.concat_ws(" ", x["code"], F.concat(F.coalesce(x["name"], F.lit("Error")), F.lit(": "), F.coalesce(x["message"], F.lit(""))))))
    deepest = F.try_element_at(c, F.lit(-1))
    cause = F.coalesce(deepest["code"], deepest["name"])
    out = df.withColumns({"stacktrace": F.when(F.size(c) > 0, F.concat_ws("\n", "stacktrace", F.array_join(line, "\n"))).otherwise(F.col("stacktrace")), "root_cause": F.coalesce("root_cause", cause)})
    return out.withColumn("context", with_keys("context", {"root_cause": cause})) if "context" in df.columns else out


def request_errors(log: DataFrame, framework: str) -> DataFrame:
    """Events of errors in request handlers (exception, message, stacktrace, method, url, route)."""
    path = F.regexp_extract("url", r"^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1)
    return log.withColumns({"severity": F.lit("error"), "tags": F.array(F.lit(framework), F.lit("request-error")), "context": F.to_json(F.struct(F.struct("method", path.alias("path")).alias("http"), "route"))})


def log_records(log: DataFrame, levels: tuple[str, ...] = ("WARN", "ERROR")) -> DataFrame:
    """Events of log records (level, target, name, message) of these levels; a missing message is the record's name."""
    return log.where(F.upper("level").isin(*levels)).select("*", F.lower("level").alias("severity"), F.col("target").alias("subsystem")).withColumn("message", F.coalesce("message", "name"))
