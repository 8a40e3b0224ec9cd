"""Traces by correlation, cause chains, descendants, roots of all events, and the dossier of an error.

Chains follow parent_event_id. Whole tables are resolved by pointer jumping: at each turn every event's pointer goes
twice as far, so turns grow with the logarithm of the depth; each turn is checkpointed. A cycle is told, not followed.

Ancestors and descendants are made of `jumps`: tables of each event's ancestor 1, 2, 4 ... above, as far as chains go. Every
distance is one sum of these, so each pair is found once, and turns grow with the logarithm of the depth.

`labelled` numbers every tree in the order of a walk through it, so that what is below an event is a range of numbers.
Given such labels, ancestors and descendants are one join: a range is cut into blocks of powers of two, a number lies in one block of each
size, and so a number and a range that has it meet in exactly one block, whatever the depth and however many others there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultspan.functions.columns import severity_rank
from faultspan.functions.lineage import checkpointed

from .analytics import rollup


def timeline(df: DataFrame) -> DataFrame:
    """Events of each trace with their step, by time and id."""
    w = Window.partitionBy("correlation_id").orderBy("ts", "id")
    return df.where(F.col("correlation_id").isNotNull()).withColumn("step", F.row_number().over(w))


def summary(df: DataFrame) -> DataFrame:
    """Of each trace: events, start, end, applications, worst severity's rank."""
    return df.where(F.col("correlation_id").isNotNull()).groupBy("correlation_id").agg(
        F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.array_sort(F.collect_set("application")).alias("applications"), F.max(severity_rank("severity")).alias("worst")
    )


def edges_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end among the ids, each once; two semi joins instead of a join on either."""
    own = ids.select("event_id").distinct()
    return edges.join(own, edges["src_event_id"] == own["event_id"], "left_semi").unionByName(edges.join(own, edges["dst_event_id"] == own["event_id"], "left_semi")).distinct()


def caused_by(df: DataFrame) -> DataFrame:
    """Edges from parent to child where both are there."""
    child = df.where(F.col("parent_event_id").isNotNull()).select(F.col("parent_event_id").alias("src_event_id"), F.col("event_id").alias("dst_event_id"))
    return child.join(df.select(F.col("event_id").alias("src_event_id")), "src_event_id", "left_semi").select("src_event_id", "dst_event_id", F.lit("caused_by").alias("rel"))


#: Children of one event are dealt to so many groups, so that no task orders all of them.
SPREAD = 1024


def labelled(df: DataFrame) -> DataFrame:
    """event_id, root_id, depth, pre (place in a walk through the tree, from 0), size (events below, itself included), there (false for a parent that is only named); without labels in and below a cycle.

    The walk is a list: into an event, into its first child or out again, from there into the next sibling or out of the parent.
    Pointer jumping sums up what is left of the list behind each entry, in turns that grow with the logarithm of its length.
    """
    own = df.where(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.min("parent_event_id").alias("up"))
    named = own.where("up IS NOT NULL").select(F.col("up").alias("event_id")).distinct().join(own, "event_id", "left_anti")
    nodes = checkpointed(own.withColumn("there", F.lit(True)).unionByName(named.select("event_id", F.lit(None).cast("string").alias("up"), F.lit(False).alias("there"))))
    child = nodes.where("up IS NOT NULL").withColumn("s", F.pmod(F.xxhash64("event_id"), F.lit(SPREAD)))
    child = checkpointed(child.withColumn("next", F.lead("event_id").over(Window.partitionBy("up", "s").orderBy("event_id"))).select("event_id", "up", "s", "next"))
    groups = child.groupBy("up", "s").agg(F.min("event_id").alias("first"))
    groups = groups.withColumn("then", F.lead("first").over(Window.partitionBy("up").orderBy("s")))
    first = groups.groupBy("up").agg(F.min_by("first", "s").alias("child")).withColumnRenamed("up", "event_id")
    sibling = child.join(groups, ["up", "s"]).select("event_id", F.coalesce("next", "then").alias("sibling"))
    into, out = (lambda c: F.concat(F.lit("<"), c)), (lambda c: F.concat(F.lit(">"), c))
    x = nodes.join(first, "event_id", "left").join(sibling, "event_id", "left")
    steps = F.array(
        F.struct(into(F.col("event_id")).alias("e"), F.coalesce(into(F.col("child")), out(F.col("event_id"))).alias("to"), F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("deep")),
        F.struct(out(F.col("event_id")).alias("e"), F.coalesce(into(F.col("sibling")), out(F.col("up"))).alias("to"), F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("deep")),
    )
    at = checkpointed(x.select(F.explode(steps).alias("x")).select("x.*").withColumn("last", F.col("e")))
    done, at = at.where("to IS NULL"), at.where("to IS NOT NULL")
    while True:
        # entries whose pointer has come to a finished one are finished; the others take over their target's pointer and sums
        every = done.unionByName(at).select(F.col("e").alias("to"), F.col("to").alias("next"), F.col("n").alias("n2"), F.col("deep").alias("deep2"), F.col("last").alias("last2"))
        step = checkpointed(at.join(every, "to").select("e", F.col("next").alias("to"), (F.col("n") + F.col("n2")).alias("n"), (F.col("deep") + F.col("deep2")).alias("deep"), F.col("last2").alias("last")))
        new = step.where("to IS NULL")
        if not new.take(1):  # what is left goes round
            break
        done, at = checkpointed(done.unionByName(new)), step.where("to IS NOT NULL")
    name = F.substring("e", 2, 1 << 30).alias("event_id")
    ins = done.where(F.col("e").startswith("<")).select(name, F.substring("last", 2, 1 << 30).alias("root_id"), F.col("n").alias("n_in"), (-F.col("deep")).alias("depth"))
    outs = done.where(F.col("e").startswith(">")).select(name, F.col("n").alias("n_out"))
    both = ins.join(outs, "event_id").join(nodes.select("event_id", "there"), "event_id")
    whole = both.where("event_id = root_id").select("root_id", F.col("n_in").alias("all"))
    return checkpointed(both.join(whole, "root_id").select("event_id", "root_id", "depth", (F.col("all") - F.col("n_in")).alias("pre"), (F.col("n_in") - F.col("n_out")).alias("size"), "there", "all"))


def _below(labels: DataFrame, upper: DataFrame, lower: DataFrame) -> DataFrame:
    """up, down, depth of all pairs of upper and lower events (event_id) of which the one is above the other."""
    right = lambda x, lv: F.call_function("shiftright", x, lv)
    level = lambda size: F.floor(F.log2(size.cast("double") + 0.5)).cast("int")

    def blocks(a: F.Column, b: F.Column) -> F.Column:
        """The blocks of powers of two that [a, b) is made of."""
        def at(lv: F.Column) -> F.Column:
            one = F.lit(1).cast("bigint")
            x, y = right(a + F.call_function("shiftleft", one, lv) - 1, lv), right(b, lv)
            return F.array_compact(F.array(F.when((x < y) & (x % 2 == 1), F.struct(lv.alias("level"), x.alias("block"))), F.when((x < y) & (y % 2 == 1), F.struct(lv.alias("level"), (y - 1).alias("block")))))

        return F.flatten(F.transform(F.sequence(F.lit(0), level(b - a) + 1), at))

    ranges = labels.where("size > 1").join(upper.select("event_id").distinct(), "event_id", "left_semi")
    ranges = ranges.select("root_id", F.col("event_id").alias("up"), F.col("depth").alias("high"), F.explode(blocks(F.col("pre") + 1, F.col("pre") + F.col("size"))).alias("b")).select("root_id", "up", "high", "b.*")
    points = labels.where("depth > 0").join(lower.select("event_id").distinct(), "event_id", "left_semi")
    points = points.select("root_id", F.col("event_id").alias("down"), F.col("depth").alias("low"), F.explode(F.transform(F.sequence(F.lit(0), level(F.col("all"))), lambda lv: F.struct(lv.alias("level"), right(F.col("pre"), lv).alias("block")))).alias("b")).select("root_id", "down", "low", "b.*")
    return ranges.join(points, ["root_id", "level", "block"]).select("up", "down", (F.col("low") - F.col("high")).cast("int").alias("depth"))


@dataclass
class Jumps:
    """Tables by k of event_id, up (its ancestor 2 ** k above), there (false for one that is only named), of every event that has one; events in or below a cycle, which these lack; whether an event id has one parent at most."""

    tables: list[DataFrame]
    odd: DataFrame | None
    one_parent: bool


def jumps(df: DataFrame) -> Jumps:
    """Each table is the one before joined with itself. In a tree some chain ends between 2 ** k and 2 ** (k + 1), so a turn that ends none has cycles only."""
    parent = F.col("parent_event_id")
    own = checkpointed(df.where("event_id IS NOT NULL").groupBy("event_id").agg(F.min(parent).alias("up"), (F.min(parent) < F.max(parent)).alias("several")))
    have = own.select(F.col("event_id").alias("up"), F.lit(True).alias("there"))
    at = checkpointed(own.where("up IS NOT NULL").select("event_id", "up").join(have, "up", "left").select("event_id", "up", F.coalesce("there", F.lit(False)).alias("there")))
    tables, odd, n = [], None, at.count()
    while n:
        tables.append(at)
        at = checkpointed(at.where("there").select("event_id", F.col("up").alias("by")).join(at.withColumnRenamed("event_id", "by"), "by").select("event_id", "up", "there"))
        before, n = n, at.count()
        if n == before:
            odd = at.select("event_id")
            tables = [checkpointed(t.join(odd, "event_id", "left_anti")) for t in tables]
            break
    return Jumps(tables, odd, not own.where("several").take(1))


def _pairs(j: Jumps, seeds: DataFrame | None, upwards: bool) -> DataFrame | None:
    """down, up, depth, there (of up) of all pairs with the lower (upwards) or the upper event among the seeds, None for all; None if there are no pairs. From the farthest jumps on, so that each distance is met once."""
    own = seeds.select("event_id").distinct() if seeds is not None else None
    found: list[DataFrame] = []
    for k in reversed(range(len(j.tables))):
        t, far = j.tables[k].withColumnRenamed("event_id", "down"), F.lit(1 << k)
        first = t if own is None else checkpointed(t.join(own.withColumnRenamed("event_id", "down" if upwards else "up"), "down" if upwards else "up", "left_semi"))
        so_far = found[0] if found else None
        for x in found[1:]:
            so_far = so_far.unionByName(x)
        found.append(first.select("down", "up", far.alias("depth"), "there"))
        if so_far is None:
            continue
        if upwards:
            more = so_far.where("there").select("down", F.col("up").alias("by"), "depth").join(t.withColumnRenamed("down", "by"), "by")
        else:
            more = so_far.withColumnRenamed("down", "by").join(t.select("down", F.col("up").alias("by")), "by")
        more = more.select("down", "up", (F.col("depth") + far).alias("depth"), "there")
        found.append(checkpointed(more) if k else more)
    out = found[0] if found else None
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _round(df: DataFrame, seeds: DataFrame, j: Jumps, upwards: bool) -> DataFrame | None:
    """What lies in or below a cycle, walked step by step."""
    if j.odd is None:
        return None
    odd = checkpointed(df.join(j.odd, "event_id", "left_semi"))
    steps = odd.select("event_id", F.col("parent_event_id").alias("next")) if upwards else odd.select(F.col("parent_event_id").alias("event_id"), F.col("event_id").alias("next"))
    return _walk(steps, seeds.join(odd.select("event_id"), "event_id", "left_semi"))


def _walked(df: DataFrame, seeds: DataFrame, labels: DataFrame | None, upwards: bool) -> DataFrame:
    of, other = ("down", "up") if upwards else ("up", "down")
    if labels is None:
        j = jumps(df)
        pairs, all_ = _pairs(j, None if seeds is df else seeds, upwards or seeds is df), seeds is df
        if pairs is None:
            pairs = df.sparkSession.createDataFrame([], "down string, up string, depth int, there boolean")
        pairs = pairs.where("there") if all_ and not upwards else pairs
    else:
        pairs = _below(labels, labels, seeds) if upwards else _below(labels, seeds, labels)
    out = pairs.select(F.col(of).alias("of_id"), F.col(other).alias("event_id"), "depth", F.lit(False).alias("cycle"))
    if labels is not None:
        # what has no labels lies in or below a cycle
        odd = checkpointed(df.join(labels.select("event_id"), "event_id", "left_anti").select("event_id"))
        j = Jumps([], odd if odd.take(1) else None, True)
    rest = _round(df, seeds, j, upwards)
    return out if rest is None else out.unionByName(rest)


def ancestors(df: DataFrame, seeds: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """of_id, event_id, depth of every ancestor of the seeds, up to a missing parent; an event met before ends the walk with cycle set."""
    return _walked(df, seeds, labels, True)


def descendants(df: DataFrame, seeds: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """of_id, event_id, depth of all below the seeds."""
    return _walked(df, seeds, labels, False)


def _walk(steps: DataFrame, seeds: DataFrame) -> DataFrame:
    steps = steps.where("event_id IS NOT NULL AND next IS NOT NULL")
    at = seeds.select(F.col("event_id").alias("of_id"), "event_id", F.array("event_id").alias("path"), F.lit(False).alias("cycle"))
    out, depth = at.limit(0).select("of_id", "event_id", F.lit(0).alias("depth"), "cycle"), 0
    while True:  # paths end where they meet themselves
        depth += 1
        at = at.where(~F.col("cycle")).join(steps, "event_id").select("of_id", F.col("next").alias("event_id"), "path", F.array_contains("path", F.col("next")).alias("cycle"))
        at = checkpointed(at.withColumn("path", F.concat("path", F.array("event_id"))))
        if not at.take(1):
            break
        out = out.unionByName(at.select("of_id", "event_id", F.lit(depth).alias("depth"), "cycle"))
    return out


def present(df: DataFrame, walked: DataFrame) -> DataFrame:
    """Leave out what a chain names but the table lacks."""
    return walked.join(df.select("event_id"), "event_id", "left_semi")


def roots(df: DataFrame, most: int = 40) -> DataFrame:
    """event_id, root_id, depth, cycle of every event: the last ancestor that is there, and how far it is; null root in and below a cycle."""
    have = df.select(F.col("event_id").alias("parent_event_id"))
    parent = df.select("event_id", "parent_event_id").join(have.withColumn("there", F.lit(True)), "parent_event_id", "left")
    at = checkpointed(parent.select("event_id", F.when(F.col("there"), F.col("parent_event_id")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("bigint").alias("depth")))
    done = at.where("up IS NULL").select("event_id", F.col("event_id").alias("root_id"), "depth")
    at = at.where("up IS NOT NULL")
    for _ in range(most):
        # pointers whose target is a root are done; the others take over their target's pointer
        ends = at.join(done.select(F.col("event_id").alias("up"), "root_id", F.col("depth").alias("more")), "up", "left")
        step = checkpointed(ends.join(at.select(F.col("event_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("far")), "up", "left"))
        new = step.where("root_id IS NOT NULL").select("event_id", "root_id", (F.col("depth") + F.col("more")).alias("depth"))
        if not new.take(1):  # each turn finishes some, as long as any can end: the rest goes round
            break
        done = checkpointed(done.unionByName(new))
        at = step.where("root_id IS NULL").select("event_id", F.col("next").alias("up"), (F.col("depth") + F.col("far")).alias("depth"))
        if not at.take(1):
            break
    return done.withColumn("cycle", F.lit(False)).unionByName(at.select("event_id", F.lit(None).cast("string").alias("root_id"), F.lit(None).cast("bigint").alias("depth"), F.lit(True).alias("cycle")))


def tree_sizes(assigned: DataFrame) -> DataFrame:
    """Events and greatest depth under each root."""
    return assigned.where("NOT cycle").groupBy("root_id").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


def _members(df: DataFrame, seeds: DataFrame, j: Jumps) -> DataFrame:
    """of_id, event_id, relation, depth of the focal events, their chains and all below, as far as they are there."""
    out = seeds.join(df.select("event_id"), "event_id", "left_semi").select(F.col("event_id").alias("of_id"), "event_id", F.lit("focal").alias("relation"), F.lit(0).alias("depth"))
    up = _pairs(j, None if seeds is df else seeds, True)
    if up is not None:
        up = checkpointed(up.where("there")) if seeds is df else up.where("there")
        down = up if seeds is df else _pairs(j, seeds, False)
        out = out.unionByName(up.select(F.col("down").alias("of_id"), F.col("up").alias("event_id"), F.lit("ancestor").alias("relation"), "depth"))
        out = out.unionByName(down.select(F.col("up").alias("of_id"), F.col("down").alias("event_id"), F.lit("descendant").alias("relation"), "depth"))
    for name, upwards in (("ancestor", True), ("descendant", False)):
        if (rest := _round(df, seeds, j, upwards)) is not None:
            out = out.unionByName(present(df, rest).select("of_id", "event_id", F.lit(name).alias("relation"), "depth"))
    return out


def _inside(df: DataFrame, members: DataFrame) -> DataFrame:
    """Edges from parent to child among the members of each focal event."""
    src = members.select("of_id", F.col("event_id").alias("src_event_id"))
    dst = members.select("of_id", F.col("event_id").alias("dst_event_id"))
    return caused_by(df).join(src, "src_event_id").join(dst, ["of_id", "dst_event_id"]).select("of_id", "src_event_id", "dst_event_id", "rel")


def _focal(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges at each focal event."""
    own = seeds.select(F.col("event_id").alias("of_id"))
    return edges.join(own, F.col("src_event_id") == F.col("of_id")).unionByName(edges.join(own, F.col("dst_event_id") == F.col("of_id"))).select("of_id", "src_event_id", "dst_event_id", "rel")


def trace_of(df: DataFrame, edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For a table of focal events: their chains and all below (of_id, event_id, relation, depth), and the edges among them or at the focal event."""
    members = _members(df, seeds, jumps(df))
    return members, _inside(df, members).unionByName(_focal(edges, seeds)).distinct()


def resolve_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """given, event_id: an event id stands for itself, a fingerprint for its first event; others have a null and an error."""
    known = df.select(F.col("event_id").alias("given"), "event_id")
    by_print = rollup(df).select(F.col("fingerprint").alias("given"), F.col("sample_event_id").alias("sample"))
    x = ids.select("given").join(known, "given", "left").join(by_print, "given", "left")
    return x.select("given", F.coalesce("event_id", "sample").alias("event_id")).withColumn("error", F.when(F.col("event_id").isNull(), "no such event or fingerprint"))


def explain(df: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row for each focal event: itself, the root cause of its chain, the chain by time, edges, recurrence, path of the category."""
    j = jumps(df)
    members = _members(df, seeds, j)
    have = df.select(F.col("event_id").alias("parent_event_id")).distinct().withColumn("known", F.lit(True))
    detail = df.select("event_id", "ts", "id", "parent_event_id").join(have, "parent_event_id", "left")
    # a member's parent is a member, unless an event id has several parents: then edges are looked for among the members
    tie = lambda src, dst, rel: F.struct(src.alias("src_event_id"), dst.alias("dst_event_id"), rel.alias("rel"))
    by_parent = F.when(F.col("known"), tie(F.col("parent_event_id"), F.col("event_id"), F.lit("caused_by")))
    at, above = F.struct("ts", "id", "event_id"), F.col("relation") != "descendant"
    line = members.join(detail, "event_id").select("of_id", F.when(above, at).alias("at"), F.when(above & F.col("parent_event_id").isNull(), at).alias("top"), (by_parent if j.one_parent else F.lit(None)).alias("tie"))
    ties = _focal(edges, seeds) if j.one_parent else _focal(edges, seeds).unionByName(_inside(df, members))
    ties = ties.select("of_id", tie(F.col("src_event_id"), F.col("dst_event_id"), F.col("rel")).alias("tie"))
    # everything of a focal event comes together once
    of = line.unionByName(ties, allowMissingColumns=True).groupBy("of_id").agg(
        F.min("top")["event_id"].alias("root_cause_id"), F.transform(F.array_sort(F.collect_list("at")), lambda x: x["event_id"]).alias("chain"), F.array_sort(F.collect_set("tie")).alias("edges")
    )
    of = of.withColumn("edges", F.when(F.size("edges") > 0, F.col("edges")))
    own = df.join(seeds.select("event_id"), "event_id", "left_semi").withColumn("of_id", F.col("event_id"))
    seen = rollup(df).select("fingerprint", F.col("count").alias("recurrence"), "first_seen", "last_seen")
    parts = F.split("category", r"\.")
    path = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    return own.join(of, "of_id", "left").join(seen, "fingerprint", "left").select("event_id", "severity", "message", "context", "root_cause_id", "chain", "edges", "recurrence", "first_seen", "last_seen", F.when(F.col("category").isNotNull(), path).alias("category_path"))
