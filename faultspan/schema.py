"""The event model: columns, severities, the category tree, classification rules and redaction patterns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Severities from the mildest on; a rank is 10 for the first and 10 more for each next one.
SEVERITIES = ["trace", "debug", "info", "warn", "error", "critical", "fatal"]
RANKS = {s: 10 * i for i, s in enumerate(SEVERITIES, 1)}

_TIMES, _LONGS, _LISTS = {"ts", "resolved_at"}, {"id"}, {"tags"}
#: The columns of an event.
EVENT_COLUMNS = [
    "id", "event_id", "ts", "application", "version", "environment", "command", "subsystem", "hostname", "severity", "category", "error_code",
    "exception", "message", "stacktrace", "root_cause", "fingerprint", "correlation_id", "parent_event_id", "resolved_at", "context", "tags",
    "metadata", "audit_hash",
]


def _type(name: str) -> T.DataType:
    return T.TimestampType() if name in _TIMES else T.LongType() if name in _LONGS else T.ArrayType(T.StringType()) if name in _LISTS else T.StringType()


EVENT_SCHEMA = T.StructType([T.StructField(c, _type(c)) for c in EVENT_COLUMNS])
SCHEMA_VERSION = 7

#: The builtin categories with their labels; a category's parent is its path without the last part.
CATEGORIES = {
    "infrastructure": "Infrastructure",
    "application": "Application",
    "runtime": "Runtime",
    "external": "External",
    "infrastructure.network": "Network",
    "infrastructure.network.dns": "DNS",
    "infrastructure.network.timeout": "Timeout",
    "infrastructure.network.connection": "Connection",
    "infrastructure.storage": "Storage",
    "infrastructure.storage.disk": "Disk",
    "infrastructure.storage.database": "Database",
    "infrastructure.compute": "Compute",
    "infrastructure.compute.memory": "Memory",
    "infrastructure.compute.cpu": "CPU",
    "application.error": "Error",
    "application.validation": "Validation",
    "application.authentication": "Authentication",
    "application.authorization": "Authorization",
    "runtime.panic": "Panic",
    "runtime.segfault": "Segmentation Fault",
    "runtime.outofmemory": "Out of Memory",
    "external.api": "API",
    "external.api.rate_limit": "Rate Limit",
    "external.service": "Service",
}
ALIASES = {"dns_error": "infrastructure.network.dns", "oom": "runtime.outofmemory"}

#: What keeps a match's first group, hides the rest and keeps a second group, in order.
SECRETS = [
    r"(?i)(Authorization:\s*Bearer\s+)\S+",
    r"""(?i)(api[_-]?key["']?\s*[:=]\s*["']?)[\w-]{8,}""",
    r"""(?i)(password["']?\s*[:=]\s*["']?)\S+""",
    r"(AWS_[A-Z_]*\s*[:=]\s*)\S+",
    r"(AKIA)[0-9A-Z]{16}",
    r"([a-zA-Z]+://[^:\s/]+:)[^@\s]+(@)",
]
HIDDEN = "«redacted»"


@dataclass(frozen=True)
class Rule:
    """kind is error_code, exception, keyword (in the message, any case) or regex (in the message)."""

    id: str
    kind: str
    value: str
    category: str
    tags: tuple[str, ...] = field(default=())


#: The builtin rules in order.
RULES = [
    Rule("builtin_etimedout", "error_code", "ETIMEDOUT", "infrastructure.network.timeout", ("timeout",)),
    Rule("builtin_econnrefused", "error_code", "ECONNREFUSED", "infrastructure.network.connection", ("connection_refused",)),
    Rule("builtin_enotfound", "error_code", "ENOTFOUND", "infrastructure.network.dns", ("dns_error",)),
    Rule("builtin_enomem", "error_code", "ENOMEM", "infrastructure.compute.memory", ("out_of_memory",)),
    Rule("builtin_panic", "exception", "panic", "runtime.panic", ("panic",)),
    Rule("builtin_ioerror", "exception", "IOException", "infrastructure.storage", ("io_error",)),
    Rule("builtin_disk_full", "keyword", "disk full", "infrastructure.storage.disk", ("disk_full",)),
    Rule("builtin_out_of_memory_msg", "keyword", "out of memory", "runtime.outofmemory", ("oom",)),
]


def categories(spark: SparkSession) -> DataFrame:
    """canonical, parent, label, builtin."""
    return spark.createDataFrame([(c, c.rpartition(".")[0] or None, label, True) for c, label in CATEGORIES.items()], "canonical string, parent string, label string, builtin boolean")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES.items()), "alias string, canonical string")
