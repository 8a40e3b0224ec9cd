"""Chat formatting: preference pairs with the common first turns rendered once as the prompt.

Conversations are tables of turns. A pair names a chosen and a rejected conversation. One that is in more than PAIRS pairs is
met by these in several tasks, with a copy for each. The longest common prefix of
their turns (equal role and text, from the first on) is the prompt; what follows in each is its completion. A rendered
pair is one row, so a conversation's turns come together in one row first. Each rendered completion comes with the spans (start and end in characters) of its assistants' texts
with their end marks: what is inside is learned, all else is masked.

Turns are put in order by `turn`, ties by role and text, nulls first, and exact copies of a turn count once. Null
roles and texts count as empty. Pairs of equal conversations have empty completions. Pairs that name a conversation
without turns are left out. Other columns of the turns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Pairs of one conversation that meet it in one task, about.
PAIRS = 1000


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 1), role, text: turns in order without copies or nulls."""
    rows = df.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.col(turn).alias("__turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("__turn", "role", "text"))).drop("__turn")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def whole(df: DataFrame) -> DataFrame:
    """conv_id and its turns in order."""
    return df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))


def format_pairs(turns: DataFrame, pairs: DataFrame, learn: str = "assistant") -> DataFrame:
    """pairs (chosen_id, rejected_id) -> these with prompt_turns int, prompt, chosen, rejected string, chosen_spans, rejected_spans array<struct<start,end>>."""
    pairs = pairs.select("chosen_id", "rejected_id").where("chosen_id IS NOT NULL AND rejected_id IS NOT NULL").distinct()
    of = whole(turns)
    parts = {own: pairs.groupBy(own).agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("__parts")).where("__parts > 1") for own in ("chosen_id", "rejected_id")}

    def meet(rows: DataFrame, own: str, other: str, name: str) -> DataFrame:
        n = F.coalesce("__parts", F.lit(1))
        dealt = rows.join(parts[own], own, "left").withColumn("__part", F.pmod(F.xxhash64(other), n).cast("int")).drop("__parts")
        copies = of.withColumnsRenamed({"conv_id": own, "turns": name}).join(parts[own], own, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), n - 1))).drop("__parts")
        return dealt.join(copies, [own, "__part"]).drop("__part")

    both = meet(meet(pairs, "chosen_id", "rejected_id", "c"), "rejected_id", "chosen_id", "r")
    least = F.least(F.size("c"), F.size("r"))
    differ = F.filter(F.sequence(F.lit(1), least), lambda i: (F.element_at("c", i)["role"] != F.element_at("r", i)["role"]) | (F.element_at("c", i)["text"] != F.element_at("r", i)["text"]))
    both = both.withColumn("prompt_turns", F.when(F.size(differ) > 0, F.array_min(differ) - 1).otherwise(least).cast("int"))

    def render(turns: Column) -> Column:
        return F.array_join(F.transform(turns, lambda t: rendered(t["role"], t["text"])), "")

    def spans(turns: Column) -> Column:
        empty = F.lit(None).cast("struct<at:int,spans:array<struct<start:int,end:int>>>")
        zero = F.coalesce(empty, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")))

        def step(a: Column, t: Column) -> Column:
            start, end = a["at"] + F.length(t["role"]) + 5, a["at"] + F.length(rendered(t["role"], t["text"]))
            own = F.when(t["role"] == learn, F.array(F.struct(start.cast("int").alias("start"), (end - 1).cast("int").alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
            return F.struct(end.cast("int").alias("at"), F.concat(a["spans"], own).alias("spans"))

        return F.aggregate(turns, zero, step, lambda a: a["spans"])

    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    return both.select(
        "chosen_id", "rejected_id", "prompt_turns", render(F.slice("c", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        render(rest(F.col("c"))).alias("chosen"), render(rest(F.col("r"))).alias("rejected"), spans(rest(F.col("c"))).alias("chosen_spans"), spans(rest(F.col("r"))).alias("rejected_spans"),
    )
