"""Column functions: severities, redaction, stack normalisation, classification, fingerprints, encryption, clamping."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultspan.schema import HIDDEN, RANKS, RULES, SECRETS, SEVERITIES, Rule


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def severity_rank(severity: str | Column) -> Column:
    out = F.lit(None).cast("int")
    for s in SEVERITIES:
        out = F.when(col(severity) == s, RANKS[s]).otherwise(out)
    return out


def parsed_severity(severity: str | Column) -> Column:
    """Unknown and missing severities are errors."""
    return F.when(col(severity).isin(SEVERITIES), col(severity)).otherwise("error")


def built(df: DataFrame, severity: str | None = None) -> DataFrame:
    """Events with what a builder fills in: an error unless told otherwise, not resolved; with a severity (error, warn, info), all are of that one."""
    given = F.col("severity") if "severity" in df.columns else F.lit(None).cast("string")
    resolved = F.col("resolved_at") if "resolved_at" in df.columns else F.lit(None).cast("timestamp")
    return df.withColumns({"severity": F.lit(severity) if severity else F.coalesce(given, F.lit("error")), "resolved_at": resolved})


def epoch_ms(ts: str | Column) -> Column:
    return F.unix_millis(col(ts))


def tags_text(tags: str | Column) -> Column:
    return F.array_join(col(tags), " ")


def promoted(context: str | Column) -> dict[str, Column]:
    """Columns of the context's hot keys."""
    get = lambda k, t: F.get_json_object(col(context), f"$.{k}").cast(t)
    return {"ctx_request_id": get("request_id", "string"), "ctx_git_commit": get("git_commit", "string"), "ctx_pid": get("pid", "int"), "ctx_duration_ms": get("duration_ms", "int")}


def short_commit(commit: str | Column) -> Column:
    return F.when(F.length(col(commit)) >= 7, F.substring(col(commit), 1, 7))


def with_keys(context: str | Column, defaults: dict[str, Column]) -> Column:
    """Add keys that an object of JSON doesn't have, but for nulls; what it has stays as it is written, other than objects too."""
    c = col(context)
    keys = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    extra = F.to_json(F.struct(*(F.when(~F.array_contains(keys, k), v).alias(k) for k, v in defaults.items())))
    own = F.trim(c)
    spliced = F.concat(F.regexp_replace(own, r"\s*\}$", ""), F.when(F.size(keys) > 0, ",").otherwise(""), F.substring(extra, 2, 1 << 30))
    is_object = own.startswith("{") & F.coalesce(F.try_parse_json(c).isNotNull(), F.lit(False))
    return F.when(extra == "{}", c).when(c.isNull(), extra).when(is_object, spliced).otherwise(c)


def with_defaults(df: DataFrame, hostname: Column, defaults: dict[str, Column], allowed_env: list[str] | None = None, env: Column | None = None) -> DataFrame:
    """Fill a missing hostname and add context keys that the event doesn't have; what it has stays as it is written, other than object contexts too, empty ones stay null."""
    if env is not None:
        defaults = defaults | {"env": F.when(F.size(kept := F.map_filter(env, lambda k, v: k.isin(allowed_env or []))) > 0, kept)}
    return df.withColumn("hostname", F.coalesce("hostname", hostname)).withColumn("context", with_keys("context", defaults))


def redacted(text: str | Column, custom: list[str] | None = None) -> Column:
    """Builtin patterns, then custom ones: the first group and those from the second on stay, what is between them is hidden."""
    out = col(text)
    for p in SECRETS + list(custom or []):
        n = re.compile(p).groups
        out = F.regexp_replace(out, p, ("$1" if n else "") + HIDDEN + "".join(f"${i}" for i in range(2, n + 1)))
    return out


def redacted_json(text: str | Column, custom: list[str] | None = None) -> Column:
    """Redact the string values, not the keys, of any JSON text; what isn't JSON stays."""
    patterns = [re.compile(p) for p in SECRETS + list(custom or [])]

    @F.pandas_udf("string")
    def walk(texts: pd.Series) -> pd.Series:
        import json

        def hide(m: re.Match) -> str:
            g = m.groups("")
            return (g[0] if g else "") + HIDDEN + "".join(g[1:])

        def clean(x):
            if isinstance(x, str):
                for p in patterns:
                    x = p.sub(hide, x)
                return x
            if isinstance(x, dict):
                return {k: clean(v) for k, v in x.items()}
            return [clean(v) for v in x] if isinstance(x, list) else x

        def one(t):
            try:
                return None if t is None else json.dumps(clean(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return t

        return texts.map(one)

    return walk(col(text))


def stack_norm(stack: str | Column) -> Column:
    """Every numeric character as N, line ends as newlines, no newline at the end."""
    lines = F.regexp_replace(col(stack), "\r\n", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n$", ""), r"\p{N}", "N")


def redacted_event(df: DataFrame, custom: list[str] | None = None) -> DataFrame:
    """Message, exception, stack, context and metadata; tags, root cause and error code are left."""
    return df.withColumns({c: redacted(c, custom) for c in ("message", "exception", "stacktrace") if c in df.columns} | {c: redacted_json(c, custom) for c in ("context", "metadata") if c in df.columns})


def checked(rules: list[Rule]) -> list[Rule]:
    for r in rules:
        if r.kind not in ("error_code", "exception", "keyword", "regex"):
            raise ValueError(f"rule {r.id}: unknown kind {r.kind}")
        if r.kind == "regex":
            try:
                re.compile(r.value)
            except re.error as e:
                raise ValueError(f"rule {r.id}: {e}") from e
    return rules


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a JSON file, an array of {id, kind: {ErrorCode|Exception|MessageKeyword|MessageRegex: value}, canonical, tags}; a bad pattern is told with its rule's id."""
    kinds = {"ErrorCode": "error_code", "Exception": "exception", "MessageKeyword": "keyword", "MessageRegex": "regex"}
    rows = spark.read.schema("id string, kind map<string,string>, canonical string, tags array<string>").json(path, multiLine=True).collect()
    return checked([Rule(r.id, kinds.get(k, k), v, r.canonical, tuple(r.tags or ())) for r in rows for k, v in (r.kind or {"none": ""}).items()])


def classified(custom: list[Rule] | None = None, error_code: str = "error_code", exception: str = "exception", message: str = "message") -> Column:
    """struct(category, rule_id, tags): by error code, else by exception, else by message; the first rule in order at each; custom rules come first."""
    rules = checked(list(custom or []) + RULES)

    def fits(r: Rule) -> Column:
        if r.kind == "error_code":
            return F.col(error_code) == r.value
        if r.kind == "exception":
            return F.col(exception) == r.value
        if r.kind == "keyword":
            return F.lower(message).contains(r.value.lower())
        return F.col(message).rlike(r.value)

    def result(r: Rule) -> Column:
        return F.struct(F.lit(r.category).alias("category"), F.lit(r.id).alias("rule_id"), F.array(*map(F.lit, r.tags)).cast("array<string>").alias("tags"))

    staged = [r for kinds in (("error_code",), ("exception",), ("keyword", "regex")) for r in rules if r.kind in kinds]
    none = F.struct(F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("rule_id"), F.array(F.lit("unclassified")).alias("tags"))
    return F.coalesce(*(F.when(fits(r), result(r)) for r in staged), none)


def classified_event(df: DataFrame, custom: list[Rule] | None = None) -> DataFrame:
    """Fill a missing category and append the rule's tags; events with a category stay."""
    c, none = classified(custom), F.array().cast("array<string>")
    return df.withColumn("__c", F.when(F.col("category").isNull(), c)).withColumns({"tags": F.concat(F.coalesce("tags", none), F.coalesce("__c.tags", none)), "category": F.coalesce("category", "__c.category")}).drop("__c")


def canonical_category(df: DataFrame, aliases: DataFrame, category: str = "category") -> DataFrame:
    """One hop from alias to canonical name; others stay. The alias table is part of the taxonomy and sent only if Spark finds it small."""
    names = aliases.select(F.col("alias").alias("__alias"), F.col("canonical").alias("__canonical")).dropDuplicates(["__alias"])
    return df.join(names, F.col(category) == F.col("__alias"), "left").withColumn(category, F.coalesce("__canonical", category)).drop("__alias", "__canonical")


def fingerprint(message: str = "message", exception: str = "exception", stack: str = "stacktrace", category: str = "category") -> Column:
    """SHA-256 of message, exception, the first five lines of the normalised stack, and category, missing parts left out."""
    first = F.array_join(F.slice(F.split(stack_norm(stack), "\n"), 1, 5), "\n")
    return F.sha2(F.concat_ws("\x1f", message, exception, first, category), 256)


def encrypted(text: str | Column, key: Column) -> Column:
    """An envelope with nonce, AES-GCM text and tag in Base64; a missing key fails."""
    return F.when(col(text).isNotNull(), F.to_json(F.struct(F.base64(F.aes_encrypt(col(text), key, F.lit("GCM"))).alias("__enc"))))


def decrypted(text: str | Column, key: Column | None) -> Column:
    """Other than envelopes stay; without the right key an envelope reads "<encrypted>"."""
    inner = F.get_json_object(col(text), "$.__enc")
    plain = F.lit(None).cast("string") if key is None else F.try_aes_decrypt(F.unbase64(inner), key, F.lit("GCM")).cast("string")
    return F.when(inner.isNull(), col(text)).otherwise(F.coalesce(plain, F.lit('"<encrypted>"')))


def week_label(ts: str | Column) -> Column:
    """%Y-W%W: weeks begin on Monday, those before the first Monday of the year are 00."""
    week = F.floor((F.dayofyear(col(ts)) - 1 + 7 - F.weekday(col(ts))) / 7)
    return F.concat(F.date_format(col(ts), "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def clamped(text: str | Column, n: int) -> Column:
    return F.substring(col(text), 1, n)


def clamped_severity(severity: str | Column) -> Column:
    return F.when(col(severity) == "warn", "warn").otherwise("error")


def clamped_context(context: str | Column, keys: int = 20, depth: int = 2, text: int = 500, items: int = 10, total: int = 4000, more: dict[str, Column] | None = None) -> Column:
    """Bound an arbitrary JSON object: keys kept by object, objects and arrays inside it to `depth`, text and array lengths, and its whole size; nulls go, others than objects are null.

    With `more`, its values are set afterwards, nulls taken out, and others than objects count as empty ones.
    """
    names = list(more or {})

    @F.pandas_udf("string")
    def walk(texts: pd.Series, *values: pd.Series) -> pd.Series:
        import json

        def cut(x, level):
            if isinstance(x, str):
                return x[:text]
            if isinstance(x, (dict, list)) and level > depth:
                return None
            if isinstance(x, list):
                return [y for v in x[:items] if (y := cut(v, level + 1)) is not None]
            if isinstance(x, dict):
                out = {}
                for k, v in x.items():
                    if len(out) >= keys:
                        break
                    if (y := cut(v, level + 1)) is not None:
                        out[k] = y
                return out
            return x

        def written(x):
            return json.dumps(x, ensure_ascii=False, separators=(",", ":"))

        def one(t, *set_to):
            try:
                x = json.loads(t) if t is not None else None
            except ValueError:
                x = None
            if not isinstance(x, dict):
                if not names:
                    return None
                out = {}
            else:
                out = cut(x, 0)
                if len(written(out)) > total:
                    out = {"_truncated": True}
            for k, v in zip(names, set_to, strict=True):
                if v is None:
                    out.pop(k, None)
                else:
                    out[k] = v
            return written(out)

        return pd.Series([one(*r) for r in zip(texts, *values, strict=True)], dtype=object)

    return walk(col(context), *(more or {}).values())


def sampled(df: DataFrame, rate: float, key: str = "event_id") -> DataFrame:
    """A share of the events that is the same at every run."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(rate * 1_000_000))


def new_event_id(*parts: str) -> Column:
    """The same id for the same content, so that a replay is no new event; random without parts."""
    return F.concat(F.lit("evt-"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)) if parts else F.expr("uuid()")


def first_match(*functions: Callable[[DataFrame], Column]) -> Callable[[DataFrame], Column]:
    """Rules of one's own, in order of registration: the first that isn't null wins."""
    return lambda df: F.coalesce(*(f(df) for f in functions))
