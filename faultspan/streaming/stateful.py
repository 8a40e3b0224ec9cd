"""Throttled notifications and rate limits, over tables and over streams, by the same walk along each key's rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from faultspan.functions.columns import severity_rank
from faultspan.functions.lineage import checkpointed
from faultspan.schema import RANKS


def severe(df: DataFrame, least: str = "error") -> DataFrame:
    """Events severe enough to tell of; an unknown limit is error's, 50."""
    return df.where(severity_rank("severity") >= RANKS.get(least, 50))


def fires(times: Iterable[int], interval_ms: int, last: int | None) -> tuple[list[bool], int | None]:
    """Which of ascending times are told: the first, then each that is the interval or more after the last one told; and that one."""
    out = []
    for t in times:
        out.append(last is None or t - last >= interval_ms)
        last = int(t) if out[-1] else last
    return out, last


def following(cells: DataFrame, bits: int) -> DataFrame:
    """Add next to distinct k, b: the key's next larger b; groups hold 2 ** 16 numbers at most."""
    x = cells.withColumn("s", F.shiftright("b", 16) if bits > 16 else F.lit(0))
    x = x.withColumn("next", F.lead("b").over(Window.partitionBy("k", "s").orderBy("b")))
    if bits <= 16:
        return x.select("k", "b", "next")
    upper = x.groupBy("k", "s").agg(F.min("b").alias("first"))
    later = following(upper.select("k", F.col("s").alias("b")), bits - 16).select("k", F.col("b").alias("s"), F.col("next").alias("s2"))
    later = later.join(upper.select("k", F.col("s").alias("s2"), "first"), ["k", "s2"]).select("k", "s", "first")
    return x.join(later, ["k", "s"], "left").select("k", "b", F.coalesce("next", "first").alias("next"))


def block(ms: str, size: int) -> Column:
    return F.expr(f"({ms} - pmod({ms}, {size}L)) div {size}L")


def starts(times: DataFrame, interval_ms: int) -> DataFrame:
    """Of distinct k, ms each key's first time, then each first one that is the interval or more after the last.

    Each time's successor lies in the next block of the interval's length or is the first of a later block; the chains
    from the first times on are then followed by pointer jumping, so no group holds a whole key.
    """
    times = checkpointed(times.select("k", "ms", block("ms", interval_ms).alias("b")))
    asked = times.select("k", (F.col("ms") + interval_ms).alias("ms"), (F.col("b") + 1).alias("b"), F.lit(0).alias("own"))
    back = Window.partitionBy("k", "b").orderBy(F.desc("ms"), F.desc("own")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = times.withColumn("own", F.lit(1)).unionByName(asked).withColumn("to", F.min(F.when(F.col("own") == 1, F.col("ms"))).over(back))
    near = both.where("own = 0").select("k", (F.col("ms") - interval_ms).alias("ms"), (F.col("b") - 1).alias("b"), "to")
    blocks = checkpointed(times.groupBy("k", "b").agg(F.min("ms").alias("first")))
    after = checkpointed(following(blocks.select("k", "b"), max(1, 45 - interval_ms.bit_length())))
    second = after.select("k", F.col("b").alias("next"), F.col("next").alias("next2"))
    far = after.join(second, ["k", "next"]).select("k", "b", F.when(F.col("next") == F.col("b") + 1, F.col("next2")).otherwise(F.col("next")).alias("c"))
    far = far.join(blocks.select("k", F.col("b").alias("c"), "first"), ["k", "c"]).select("k", "b", "first")
    jump = checkpointed(near.join(far, ["k", "b"], "left").select("k", "ms", F.coalesce("to", "first").alias("to")).where("to IS NOT NULL"))
    out = checkpointed(times.groupBy("k").agg(F.min("ms").alias("ms")))
    while True:
        more = checkpointed(out.join(jump, ["k", "ms"]).select("k", F.col("to").alias("ms")))
        if not more.take(1):
            return out
        out = out.unionByName(more)  # what was found before stays where it is written
        twice = checkpointed(jump.join(jump.select("k", F.col("ms").alias("to"), F.col("to").alias("to2")), ["k", "to"]).select("k", "ms", F.col("to2").alias("to")))
        # later turns begin where this one found something or where so many steps lead: chains run together, so these are soon few
        jump = checkpointed(twice.join(twice.select("k", F.col("to").alias("ms")).unionByName(out), ["k", "ms"], "left_semi"))


def _key(key: str) -> Column:
    """The key as text, null apart from all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def throttled(df: DataFrame, interval_ms: int | None, least: str = "error", key: str = "fingerprint") -> DataFrame:
    """Events that are told of: of each key no two within the interval; none or 0 tells of all.

    Only the first event of a key and millisecond can be told of; one without a time only if its key has no times.
    """
    rows = severe(df, least)
    if not interval_ms:
        return rows
    narrow = checkpointed(rows.groupBy(_key(key).alias("k"), F.unix_millis("ts").alias("ms")).agg(F.min("id").alias("id")))
    timed = narrow.where("ms IS NOT NULL")
    told = timed.join(starts(timed, max(1, interval_ms)), ["k", "ms"]).select("id")
    rest = narrow.where("ms IS NULL").join(timed, "k", "left_anti").select("id")
    return rows.join(told.unionByName(rest), "id", "left_semi")


def rate_limited(df: DataFrame, most: int = 60, window_ms: int = 60_000, key: str = "client", ts: str = "received_at", order: str = "request_id") -> DataFrame:
    """Add limited: a window begins with a key's first request after the last one has ended, and all requests in it count, refused ones too; requests without a time count in the last window.

    Of each window only the `most`-th request's time and order is found, from narrow rows of which each task keeps `most`, and
    what comes after it is limited; requests alike in time and order share one answer.
    """
    if window_ms <= 0:
        return df.withColumn("limited", F.lit(most < 1))
    x = df.withColumns({"__k": _key(key), "__ms": F.unix_millis(ts)}).withColumn("__b", block("__ms", window_ms))
    begun = starts(x.where("__ms IS NOT NULL").select(F.col("__k").alias("k"), F.col("__ms").alias("ms")).distinct(), window_ms)
    # starts are a window or more apart: a block has one at most, and a request's window began in its block or the one before
    own = begun.select(F.col("k").alias("__k"), block("ms", window_ms).alias("__b"), F.col("ms").alias("__own"))
    before = own.select("__k", (F.col("__b") + 1).alias("__b"), F.col("__own").alias("__before"))
    timed = x.where("__ms IS NOT NULL").join(own, ["__k", "__b"], "left").join(before, ["__k", "__b"], "left")
    timed = timed.withColumn("__start", F.when(F.col("__own") <= F.col("__ms"), F.col("__own")).otherwise(F.col("__before")))
    last = begun.groupBy(F.col("k").alias("__k")).agg(F.max("ms").alias("__start"))
    both = timed.select(*df.columns, "__k", "__ms", "__start").unionByName(x.where("__ms IS NULL").join(last, "__k", "left").select(*df.columns, "__k", "__ms", "__start"))
    if most < 1:
        return both.select(*df.columns, F.lit(True).alias("limited"))
    at = F.struct(F.coalesce("__ms", F.lit(2**63 - 1)).alias("ms"), F.col(order).alias("order"))
    narrow = both.select("__k", F.coalesce("__start", F.lit(-(2**63))).alias("__start"), at.alias("__at"))
    first = narrow.withColumn("__n", F.row_number().over(Window.partitionBy("__k", "__start").orderBy("__at"))).where(F.col("__n") <= most)
    cut = first.where(F.col("__n") == most).select("__k", "__start", F.col("__at").alias("__cut"))
    both = both.withColumns({"__start": F.coalesce("__start", F.lit(-(2**63))), "__at": at}).join(cut, ["__k", "__start"], "left")
    return both.withColumn("limited", F.coalesce(F.col("__at") > F.col("__cut"), F.lit(False))).select(*df.columns, "limited")


def client_key(df: DataFrame) -> DataFrame:
    return df.withColumn("client", F.coalesce("remote_addr", "origin", F.lit("")))


def throttled_stream(stream: DataFrame, interval_ms: int, least: str = "error", late: str = "10 minutes") -> DataFrame:
    """event_id, fingerprint, ts of what is told of, with a key's last told time as state until the watermark is past its interval."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["ms", "event_id"])
        keep, last = fires(rows["ms"], interval_ms, state.get[0] if state.exists else None)
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last) + interval_ms, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[keep, ["event_id", "fingerprint", "ts"]]

    rows = severe(stream.withWatermark("ts", late), least).select("event_id", "fingerprint", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("fingerprint").applyInPandasWithState(step, "event_id string, fingerprint string, ts timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited_stream(stream: DataFrame, most: int = 60, window_ms: int = 60_000, late: str = "10 minutes") -> DataFrame:
    """request_id, client, limited, with a key's window and count as state until the watermark is past the window."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values(["ms", "request_id"])
        over = []
        for t in rows["ms"]:
            if start is None or t >= start + window_ms:
                start, n = int(t), 0
            n += 1
            over.append(n > most)
        state.update((start, n))
        state.setTimeoutTimestamp(max(start + window_ms, state.getCurrentWatermarkMs() + 1))
        yield rows[["request_id", "client"]].assign(limited=over)

    rows = client_key(stream.withWatermark("received_at", late)).select("request_id", "client", "received_at", F.unix_millis("received_at").alias("ms"))
    return rows.groupBy("client").applyInPandasWithState(step, "request_id bigint, client string, limited boolean", "start bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)
