"""The pN_ queries; each takes (spark, sf_dir) and covers its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import p1_copies, p2_packing, p3_versions, p4_body, p5_quality, p6_budget, p7_leaks, p8_encode, p9_mixture, p10_residue
from .common import Durable, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy but the first of its class of equal words or equal fields."""
    return p1_copies.repeated(table(spark, sf_dir, "documents"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with words, its class and the copies of the class."""
    return p1_copies.copies(table(spark, sf_dir, "documents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that fit a block, by the plan stand whole in one, and were cut by the earlier packing."""
    return p2_packing.needlessly_cut(table(spark, sf_dir, "token_runs"), table(spark, sf_dir, "packed_blocks"))


def p2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs packed anew into blocks of the capacity of the earlier packing."""
    capacity = p2_packing.capacity_of(table(spark, sf_dir, "packed_blocks"))
    return p2_packing.blocks(table(spark, sf_dir, "token_runs"), capacity)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version but the first of its group; of copies only the first takes part."""
    work = Durable(spark)
    got = p3_versions.groups(p1_copies.firsts(table(spark, sf_dir, "documents"), work), threshold=0.5, work=work, split=None)
    return got.select(F.col("root").alias("first_id"), F.col("id").alias("doc_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of captured pages outside the main body."""
    return p4_body.outside(table(spark, sf_dir, "web_captures"))


def p4_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each captured page with its main body only."""
    return p4_body.bodies(table(spark, sf_dir, "web_captures"))


def _hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the source as the host whose lines may recur."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"))


def _common(spark: SparkSession, sf_dir: str) -> set[str]:
    return p5_quality.common_words(table(spark, sf_dir, "common_words"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly not natural prose."""
    return p5_quality.not_prose(_hosted(spark, sf_dir), _common(spark, sf_dir))


def p5_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality statistics of every document."""
    return p5_quality.statistics(table(spark, sf_dir, "documents"), _common(spark, sf_dir))


def p6_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, once."""
    return p6_budget.document_tokens(table(spark, sf_dir, "documents"), table(spark, sf_dir, "token_runs"))


def p6_token_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of runs and of texts by source, language and domain."""
    return p6_budget.cube(p6_budget.document_tokens(table(spark, sf_dir, "documents"), table(spark, sf_dir, "token_runs")))


def p6_run_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of runs alone by source, language and domain."""
    return p6_budget.cube(p6_budget.document_tokens(table(spark, sf_dir, "documents"), table(spark, sf_dir, "token_runs"), None))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks.items(*(table(spark, sf_dir, f"domain_{t}") for t in ("surface", "application", "recall")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and evaluation item it leaks."""
    return p7_leaks.leaks(table(spark, sf_dir, "documents"), _items(spark, sf_dir))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked stretches, in characters of the original text."""
    return p7_leaks.leak_spans(table(spark, sf_dir, "documents"), _items(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return p8_encode.encode(table(spark, sf_dir, "documents"))


def p9_mixture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return p9_mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares by source."""
    return p9_mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the classifier of the mixture places labelled documents that it was not fitted on."""
    sources = sorted(r.source for r in table(spark, sf_dir, "mix_targets").toLocalIterator() if r.source is not None)
    return p9_mixture.held_out(table(spark, sf_dir, "documents"), sources)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of template residue, filler, errors or script notices."""
    return p10_residue.residue(_hosted(spark, sf_dir), _common(spark, sf_dir)).select("doc_id")


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that remain without them."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "n_chars").join(p10_found(spark, sf_dir), "doc_id", "left_anti")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "p" and k[1:2].isdigit() and callable(v)}
