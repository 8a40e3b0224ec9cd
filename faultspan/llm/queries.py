"""One query for each operator, over its whole table: name -> function(spark, sf_dir)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, byte_ppm, decontaminate, language_id, ngram_join, periodic, preference, simhash, toxicity, url_filter, vantage, warc_zip, whitening
from .common import remainder, saved, shared_dir

RANKS = "byte_bpe_multi_50k.tiktoken"
RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = byte_ppm.fit(docs.where(remainder("doc_id", 7) != 2))
    return byte_ppm.score(docs, model).withColumn("held_out", remainder("doc_id", 7) == 2)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    weights = url_filter.fit(url_filter.labelled_by_rules(pages, RULES))
    return url_filter.judge(pages, RULES, weights).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).drop("text")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc")


def preference_pairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and pairs made of the conversations themselves.

    Conversations that begin with one and the same turn: the one with the smallest id is chosen over each other one.
    Every conversation is also chosen over its echo, in which the last assistant turn repeats the turn before it. An echo's
    id is -1 - conv_id, or, where there are ids below 0, as far below the least of them.
    """
    least = min(0, turns.agg(F.min("conv_id")).collect()[0][0] or 0)
    echo_id = F.lit(2 * least - 1).cast("bigint") - F.col("conv_id")
    last = turns.where("role = 'assistant' AND place > 1").groupBy("conv_id").agg(F.max("place").alias("place"))
    before = turns.select("conv_id", (F.col("place") + 1).alias("place"), F.col("text").alias("said"))
    echoed = last.join(before, ["conv_id", "place"]).select("conv_id", "place", "said")
    ids = echoed.select("conv_id", F.lit(True).alias("has"))
    echo = turns.join(ids, "conv_id").drop("has").join(echoed, ["conv_id", "place"], "left").select(echo_id.alias("conv_id"), "place", "role", F.coalesce("said", "text").alias("text"))
    first = turns.where("place = 1").select("conv_id", F.sha2(F.concat_ws("\x1f", "role", "text"), 256).alias("first"))
    heads = first.groupBy("first").agg(F.min("conv_id").alias("chosen_id"))
    same = first.join(heads, "first").where("conv_id > chosen_id").select("chosen_id", F.col("conv_id").alias("rejected_id"))
    own = ids.select(F.col("conv_id").alias("chosen_id"), echo_id.alias("rejected_id"))
    return turns.select("conv_id", "place", "role", "text").unionByName(echo), same.unionByName(own)


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, pairs = preference_pairs(saved(preference.turns_of(table(spark, sf_dir, "conversations")), "turns"))
    return preference.format_pairs(turns, pairs)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.where(remainder("doc_id", 3) != 1), labels.where(remainder("doc_id", 3) != 1))
    return model.predict(docs).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(remainder("doc_id", 4) != 2))
    return model.predict(docs.select("doc_id", "text")).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op10_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.search(table(spark, sf_dir, "embeddings"), F.expr("id % 20 = 0"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: of every tenth document by h, the crc32 of its id, the words from a place on repeat those of a period there; others stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, h in enumerate(batch.column("h").to_pylist()):
                if h % 10 or not texts[i] or not (w := re.findall(r"[^\x20\x09-\x0D]+", texts[i])):
                    continue
                g, n = h // 10, len(w)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                texts[i] = " ".join(w[:a] + (w[a : a + p] * (-(-(n - a) // p)))[: n - a])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h")
    return docs.select("doc_id", "text", h).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.runs(with_repeats(table(spark, sf_dir, "documents")))
    more = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    # the first of equals is the one with the smallest start, then period
    order = lambda x, y: F.when(more(x, y) > 0, -1).when(more(x, y) < 0, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(F.signum(x["period"] - y["period"]).cast("int"))
    best = F.get(F.array_sort("runs", order), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


QUERIES = {f.__name__: f for f in (op1_byte_ppm, op2_url_filter, op3_byte_bpe, op4_decontaminate, op5_ngram_join, op6_warc_zip, op7_preference, op8_toxicity, op9_language_id, op10_vantage, op11_simhash, op12_whitening, op13_periodic)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: Base 32 of a hexadecimal digest x: its bits, four by each digit, five to each letter.
_BITS = "array_to_string(list_transform(string_split(x, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '')"
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: CASE WHEN substr(bits, i * 5 + j + 1, 1) = '1' THEN 1 << (4 - j) ELSE 0 END))::BIGINT, 1)), '')"
ORACLE_SQL: dict[str, str] = {
    "op5_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)), l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
 SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id""",
    "op6_warc_zip": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages), b AS (SELECT x, max(page_id) AS best FROM p GROUP BY x), d AS (SELECT p.*, best, {_BITS} AS bits FROM p JOIN b USING (x))
 SELECT page_id, strlen(h) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM d""",
}
