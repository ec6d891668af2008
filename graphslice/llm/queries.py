"""One query for each operator, over its whole table, and SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphslice.llm import (
    license_scan, manifest, mixing, near_dup, nearest, packing, periodic, quality, secrets, sharding, topk, toxicity, urls,
)
from graphslice.llm.oracle import ORACLE as ORACLE

Query = Callable[[SparkSession, str], DataFrame]

#: Host labels of the listed pages, and the rules the query's contract names.
LISTED_LABELS = ("spam-farm", "cheap-pills", "free-bets", "casino-win", "ads-track", "adult-x")
RULES = (
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_license_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def tokenizer_paths() -> tuple[str, str]:
    """The tokenizer, and its vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), *tokenizer_paths())
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


def op4_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.Duplicates(table(spark, sf_dir, "documents")).classes()


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op5_log_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs.select("doc_id", "text"), quality.fit(docs, trusted_ids(table(spark, sf_dir, "labels"))))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op6_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return topk.search(docs, docs.where("doc_id % 100 = 0"))


def op8_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    grown = F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", grown)


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("key")


def listed_pages(pages: DataFrame) -> DataFrame:
    """The list: URLs of pages on hosts with a label that is known for spam.

    It writes each URL in a spelling of its own, so that only the canonical form finds the page.
    """
    labels = F.split(urls.host_of(F.col("url")), r"\.")
    listed = pages.where(F.arrays_overlap(labels, F.array(*map(F.lit, LISTED_LABELS))))
    plain = urls.canonical(F.col("url"))
    sign = F.when(F.contains(plain, F.lit("?")), "&").otherwise("/?")
    return listed.select(F.concat(F.lit("HTTP://WWW."), plain, sign, F.lit("utm_source=list#seen")).alias("url"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, listed_pages(pages), RULES)


def op11_midstate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some texts are found in lower case; the manifest tells which."""
    text = F.col("text")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = F.when(tampered, manifest.lower_ascii(text)).otherwise(text)
    return manifest.Manifest(table(spark, sf_dir, "documents"), found).verify()


def op12_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = nearest.Index(table(spark, sf_dir, "embeddings"))
    found = index.search(index.rows.where("vec_id % 20 = 0"), 20)
    return found.select("query_id", "rank", "vec_id", "score")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a periodic tail in every tenth document, as the query's contract says."""
    drawn = F.crc32(F.col("doc_id").cast("string"))
    ninth = F.floor(drawn / 10)
    start = lambda n: ninth % n
    period = lambda n: 1 + F.floor((n - start(n)) / (3 + ninth % 8))
    tail = periodic.with_tail(F.col("text"), start, period)
    return docs.select("doc_id", F.when(drawn % 10 == 0, tail).otherwise(F.col("text")).alias("text"))


def op13_dyadic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(planted(table(spark, sf_dir, "documents")))
    # A comparison that sorts first what is longest, then starts first, then has the least period.
    first = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.array_min(first)
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(listed, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed").select(
        "doc_id",
        "n_runs",
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("(-1000 * best.l) div best.p").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_compression_toxicity": op1_compression_toxicity,
    "op2_license_patience": op2_license_patience,
    "op3_nnls_packing": op3_nnls_packing,
    "op4_probminhash_dedup": op4_probminhash_dedup,
    "op5_log_ratio_rules": op5_log_ratio_rules,
    "op6_sainte_lague_mix": op6_sainte_lague_mix,
    "op7_block_max_wand": op7_block_max_wand,
    "op8_histogram_sort": op8_histogram_sort,
    "op9_secret_forest": op9_secret_forest,
    "op10_url_filter": op10_url_filter,
    "op11_midstate_manifest": op11_midstate_manifest,
    "op12_collision_counting": op12_collision_counting,
    "op13_dyadic_runs": op13_dyadic_runs,
}
