"""Documents: construction, counts, provenance fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T


def documents(raw: DataFrame) -> DataFrame:
    """The document row of each record with text: ids, hashes and sizes; blank texts are skipped."""
    return raw.where(~T.is_blank("text")).select(
        "doc_id", T.stable_id("source", "source_uri").alias("stable_id"), T.content_hash("text").alias("content_hash"),
        F.octet_length("text").alias("byte_length"), F.length("text").alias("char_count"), T.estimated_tokens("text").alias("estimated_tokens"),
        "source", "source_role", "source_group", "source_type", "license",
    )


def counts(docs: DataFrame) -> DataFrame:
    """Documents, bytes and estimated tokens in all and by role, license and group; null is ``unspecified``."""
    cols = ["source_role", "license", "source_group"]
    named = docs.select("byte_length", "estimated_tokens", *(F.coalesce(c, F.lit("unspecified")).alias(c) for c in cols))
    # One pass; the sets expand each row by four narrow copies that pre-aggregate in place.
    sets = named.groupingSets([[], *([c] for c in cols)], *cols).agg(
        F.grouping_id().alias("g"), F.count("*").alias("documents"), F.sum("byte_length").alias("bytes"), F.sum("estimated_tokens").alias("tokens")
    )
    kind = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "source_role").when(F.col("g") == 5, "license").otherwise("source_group")
    return sets.select(kind.alias("kind"), F.coalesce(*cols, F.lit("*")).alias("value"), "documents", "bytes", "tokens")


def source_stats(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents and bytes of each configured source, also of those without any."""
    got = docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum("byte_length").alias("bytes"))
    return sources.select("source").distinct().join(got, "source", "left").na.fill(0)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, hash) of a table, whatever the order of its rows; what a manifest records of a stage."""
    h = F.xxhash64(*(F.col(c) for c in sorted(df.columns))).cast("decimal(38,0)")
    r = df.agg(F.count("*"), F.coalesce(F.sum(h), F.lit(0))).first()
    return int(r[0]), int(r[1]) % (1 << 64)
