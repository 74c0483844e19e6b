"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import search
from .bpe import round_trip
from .html import extract
from .licenses import scan as scan_licenses
from .mixing import mix_plan
from .neardup import near_duplicates
from .pieces import round_trip as piece_round_trip
from .quality import quality
from .resample import resample
from .secrets import scan
from .spelling import spelling_variants
from .substring import dedup_substrings
from .tokencount import section_tokens


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(_read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(_read(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract(_read(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_read(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(
        F.transform(c, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ","
    )
    of = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        of("assign"),
        of("access"),
        of("hex"),
        F.sha2(listed(F.filter("findings", lambda f: f["kind"] != "model")), 256).alias("base_sha256"),
        listed("findings").alias("spans"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_read(spark, sf_dir, "documents"))
    shown = lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))
    return found.select(
        "doc_id",
        "n_blocks",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["name"]))), ",").alias("names"),
        F.array_join(F.transform("licenses", shown), ",").alias("spans"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(_read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(round_trip(_read(spark, sf_dir, "documents")))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_read(spark, sf_dir, "embeddings"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_round_trip(_read(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents"))


def bpe_digests(coded: DataFrame) -> DataFrame:
    """Digests of ids and of the text that was decoded from them."""
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_quality_rules, op3_substrings, op4_html, op5_secrets, op6_licenses, op7_mixing, op8_bpe, op9_ann, op10_neardup,
        op11_resample, op12_pieces, op13_spelling,
    )
}
