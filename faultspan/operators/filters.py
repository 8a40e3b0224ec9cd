"""Filters as one predicate, age limits, keyset pages and their cursors."""

from __future__ import annotations

import base64
import functools
import json
import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultspan.functions.columns import epoch_ms, severity_rank
from faultspan.schema import RANKS

EQUAL = ("application", "version", "environment", "command", "subsystem", "hostname", "category", "error_code", "correlation_id", "fingerprint")


@dataclass(frozen=True)
class Filters:
    """What is given must hold all together; nothing given holds for every event. Times are inclusive; an unknown least severity means warn's limit, 30."""

    application: str | None = None
    version: str | None = None
    environment: str | None = None
    command: str | None = None
    subsystem: str | None = None
    hostname: str | None = None
    category: str | None = None
    error_code: str | None = None
    correlation_id: str | None = None
    fingerprint: str | None = None
    severity_min: str | None = None
    start_ms: int | None = None
    end_ms: int | None = None
    resolved: bool | None = None
    tags: tuple[str, ...] = ()
    category_under: str | None = None

    def column(self) -> Column:
        out = [F.col(c) == getattr(self, c) for c in EQUAL if getattr(self, c) is not None]
        if self.severity_min is not None:
            out.append(severity_rank("severity") >= RANKS.get(self.severity_min, 30))
        if self.start_ms is not None:
            out.append(F.col("ts") >= F.timestamp_millis(F.lit(self.start_ms)))
        if self.end_ms is not None:  # the event's milliseconds count, so all of the last one is in
            out.append(F.col("ts") < F.timestamp_millis(F.lit(self.end_ms + 1)))
        if self.resolved is not None:
            out.append(F.col("resolved_at").isNotNull() if self.resolved else F.col("resolved_at").isNull())
        if self.tags:
            out.append(functools.reduce(Column.__or__, map(tagged, self.tags)))
        if self.category_under is not None:
            out.append((F.col("category") == self.category_under) | F.col("category").startswith(self.category_under + "."))
        return functools.reduce(Column.__and__, out) if out else F.lit(True)

    def checked(self) -> Filters:
        if self.start_ms is not None and self.end_ms is not None and self.start_ms > self.end_ms:
            raise ValueError("the range ends before it starts")
        return self


def tagged(part: str) -> Column:
    """One of the tags holds this text."""
    return F.exists("tags", lambda t: t.contains(part))


def age_ms(spec: str) -> int:
    """30d, 24h, 10m or 5s in milliseconds."""
    m = re.fullmatch(r"(\d+)([dhms])", spec.strip())
    if not m:
        raise ValueError(f"not an age: {spec!r}")
    return int(m[1]) * {"d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1000}[m[2]]


def older_than(spec: str, now_ms: int) -> Column:
    return F.col("ts") < F.timestamp_millis(F.lit(now_ms - age_ms(spec)))


def time_ms(text: str | None) -> int | None:
    """An RFC 3339 time in milliseconds, None where it isn't one, as if it had not been given."""
    try:
        t = datetime.fromisoformat((text or "").replace("Z", "+00:00"))
        return None if t.tzinfo is None else round(t.timestamp() * 1000)
    except ValueError:
        return None


def clamp(limit: int | None, default: int = 20, most: int = 200) -> int:
    return max(1, min(most, default if limit is None else limit))


def cursor(ts_ms: int, id: int, score: float | None = None) -> str:
    return base64.b64encode(json.dumps({"ts_epoch_ms": ts_ms, "id": id} | ({} if score is None else {"score": score})).encode()).decode()


def read_cursor(text: str | None) -> tuple[dict | None, str | None]:
    """The position and a warning: what can't be read gives the first page."""
    if not text:
        return None, None
    try:
        x = json.loads(base64.b64decode(text, validate=True))
        return {"ts_epoch_ms": int(x["ts_epoch_ms"]), "id": int(x["id"]), "score": x.get("score")}, None
    except (ValueError, KeyError, TypeError):
        return None, "the cursor can't be read; this is the first page"


def page(df: DataFrame, limit: int | None = None, after: str | None = None, by_score: bool = False, more: int = 0) -> DataFrame:
    """One page by recency, or by score (smallest first), then time and id from the latest on; with as many more rows as are asked for beyond the limit."""
    at, _ = read_cursor(after)
    ms = epoch_ms("ts")
    if at:
        later = (ms < at["ts_epoch_ms"]) | ((ms == at["ts_epoch_ms"]) & (F.col("id") < at["id"]))
        df = df.where((F.col("score") > at["score"]) | ((F.col("score") == at["score"]) & later) if by_score else later)
    return df.orderBy(*([F.asc("score")] if by_score else []), ms.desc(), F.desc("id")).limit(clamp(limit) + more)


@dataclass
class Page:
    items: list
    next_cursor: str | None
    total: int | None
    warning: str | None


def fetch(df: DataFrame, limit: int | None = None, after: str | None = None, by_score: bool = False, count: bool = True) -> Page:
    """A page's rows with the next cursor and, if asked for, the number of all rows without regard to cursor and limit."""
    n = clamp(limit)
    _, warning = read_cursor(after)
    rows = page(df.withColumn("__ms", epoch_ms("ts")), n, after, by_score, more=1).collect()
    shown, more = rows[:n], len(rows) > n
    last = shown[-1] if shown else None
    return Page(shown, cursor(last["__ms"], last["id"], last["score"] if by_score else None) if more and last else None, df.count() if count else None, warning)
