"""Deduplication with first-seen-wins semantics: exact, normalized and MinHash/LSH near copies.

A document goes exactly if an earlier *retained* one matches it, so the kept documents are the
lexicographically first maximal independent set, not one of each connected component.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..session import join_hot, keep

PRIME = 2147483647
PERMS, BANDS = 64, 16


def family(perms: int = PERMS) -> tuple[np.ndarray, np.ndarray]:
    """The affine maps modulo PRIME; stated by a rule, so that SQL can repeat them."""
    i = np.arange(perms, dtype=object)
    return ((1103515245 * (i + 1)) % PRIME).astype(np.int64), ((12345 * (i + 7) * 2654435) % PRIME).astype(np.int64)


def similarity(a: Column, b: Column, perms: int = PERMS) -> Column:
    """Share of equal positions of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / perms


_SPACE = re.compile("[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_WORD = re.compile(r"\w+")


def signature(text: str, shingle: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each map the least value over the 28-bit hashes of the text's word shingles.

    A text without tokens has its normalized text as one shingle.
    """
    w = _WORD.findall(text.lower())
    grams = {" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else {_SPACE.sub(" ", text).strip(" ").lower()}
    h = np.array([int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in grams], np.int64)
    low = np.full(len(a), PRIME, np.int64)
    for k in range(0, len(h), 4096):  # a long text needs no more memory than a short one
        low = np.minimum(low, ((h[k : k + 4096, None] * a + b) % PRIME).min(axis=0))
    return low


def signatures(docs: DataFrame, shingle: int = 5, perms: int = PERMS) -> DataFrame:
    """(doc_id, text_hash, norm_hash, sig) of the documents whose text is not null."""
    a, b = family(perms)
    base = docs.where("text is not null").select("doc_id", "text", T.content_hash("text").alias("text_hash"), T.content_hash(T.dedup_key("text")).alias("norm_hash"))

    def each(batches):
        for batch in batches:
            sig = [signature(t, shingle, a, b) for t in batch.column(1).to_pylist()]
            flat = pa.array(np.concatenate(sig) if sig else np.zeros(0, np.int64))
            ends = pa.array(np.arange(0, len(flat) + 1, perms, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "text_hash", "norm_hash", "sig"])

    return base.mapInArrow(each, "doc_id long, text_hash string, norm_hash string, sig array<bigint>")


def band_keys(sig: Column, perms: int = PERMS, bands: int = BANDS) -> Column:
    """A 64-bit key of each band and its rows."""
    rows = max(1, perms // bands)
    return F.transform(F.sequence(F.lit(0), F.lit(perms // rows - 1)), lambda b: F.xxhash64(b, F.array_join(F.slice(sig, b * rows + 1, rows), ",")))


def buckets(signed: DataFrame, perms: int = PERMS) -> DataFrame:
    """(key, doc_id), once a document and key."""
    return signed.select("doc_id", F.explode(F.array_distinct(band_keys(F.col("sig"), perms))).alias("key"))


def candidate_pairs(signed: DataFrame, threshold: float, perms: int = PERMS) -> DataFrame:
    """(a, b, sim) with a < b of documents that share a band, similar at least by the threshold.

    A report over the pairs themselves; decisions use ``decide``, which never expands a bucket.
    """
    keyed = buckets(signed, perms)
    left, right = keyed.withColumnRenamed("doc_id", "a"), keyed.withColumnRenamed("doc_id", "b")
    pairs = left.join(right, "key").where("a < b").select("a", "b").distinct()
    sig = signed.select("doc_id", "sig")
    met = pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
    return met.select("a", "b", similarity(F.col("sa"), F.col("sb"), perms).alias("sim")).where(F.col("sim") >= threshold)


def decide(docs: DataFrame, near: bool = True, threshold: float = 0.85, perms: int = PERMS, shingle: int = 5) -> DataFrame:
    """(doc_id, status, match_id): kept, or exact_duplicate, normalized_duplicate or near_duplicate of a retained document.

    Texts of one normalized form are decided by their first.  In each round a bucket's members meet
    only its least undecided one.  A document that is least in all its buckets is kept; those it
    matches go.  A hot bucket costs its members once a round; only removed members are compared with
    the retained ones of their bucket.  Ties of similarity go to the smallest id.
    """
    every = signatures(docs, shingle, perms)
    every = keep(every if near else every.withColumn("sig", F.lit(None).cast("array<bigint>")))
    # Texts of one normalized form have one signature, so the first of them is decided for all.
    classes = keep(every.groupBy("norm_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members")))
    signed = keep(every.join(classes.select("doc_id"), "doc_id", "left_semi").select("doc_id", "sig"))
    by = lambda name: signed.select(F.col("doc_id").alias(name), F.col("sig").alias(f"sig_{name}"))
    close = F.coalesce(similarity(F.col("sig_a"), F.col("sig_b"), perms), F.lit(0.0))
    lone = signed.select("doc_id")
    kept, gone, keyed = None, None, None
    if near:
        keyed = buckets(signed.where("sig is not null"), perms)
        shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        # A key of one document compares nothing.
        keyed = keep(keyed.join(shared.select("key"), "key", "left_semi"))
        lone = lone.join(keyed.select("doc_id").distinct(), "doc_id", "left_anti")
        open_ = keyed
        while not open_.isEmpty():
            least = open_.groupBy("key").agg(F.min("doc_id").alias("a"))
            led = keep(open_.join(least, "key").select("doc_id", "a").distinct())
            now = keep(led.groupBy("doc_id").agg(F.min("a").alias("a")).where("a = doc_id").select("doc_id"))
            pairs = led.where("a < doc_id").withColumnRenamed("doc_id", "b").join(now.withColumnRenamed("doc_id", "a"), "a", "left_semi")
            out = keep(pairs.join(by("a"), "a").join(by("b"), "b").where(close >= threshold).select(F.col("b").alias("doc_id")).distinct())
            kept = now if kept is None else kept.unionByName(now)
            gone = out if gone is None else gone.unionByName(out)
            open_ = keep(open_.join(now.unionByName(out), "doc_id", "left_anti"))
    kept = keep(lone if kept is None else lone.unionByName(kept))
    # Matches of the removed: with the retained members of their buckets only.
    none = signed.select(F.col("doc_id").alias("b"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("double").alias("sim")).limit(0)
    matched = none
    if gone is not None:
        stay = keyed.join(kept, "doc_id", "left_semi").withColumnRenamed("doc_id", "a")
        pairs = keyed.join(gone, "doc_id", "left_semi").withColumnRenamed("doc_id", "b").join(stay, "key").where("a < b").select("a", "b").distinct()
        met = pairs.join(by("a"), "a").join(by("b"), "b").withColumn("sim", close).where(F.col("sim") >= threshold)
        matched = met.groupBy("b").agg(F.max_by(F.struct("a", "sim"), F.struct("sim", -F.col("a"))).alias("m")).select("b", "m.a", "m.sim")
    decided = kept.select("doc_id", F.lit(None).cast("long").alias("match")).unionByName(matched.select(F.col("b").alias("doc_id"), F.col("a").alias("match")))
    decided = decided.join(classes, "doc_id").join(every.select("doc_id", F.col("text_hash").alias("first_text")), "doc_id")
    decided = decided.select("norm_hash", F.col("doc_id").alias("first"), "match", "first_text", F.col("members").alias("weight"))
    met = join_hot(every.select("doc_id", "norm_hash", "text_hash"), decided, "norm_hash", "weight")
    return met.select(
        "doc_id",
        F.when(F.col("match").isNotNull(), "near_duplicate").when(F.col("doc_id") == F.col("first"), "kept").when(F.col("text_hash") == F.col("first_text"), "exact_duplicate").otherwise("normalized_duplicate").alias("status"),
        F.when(F.col("match").isNotNull(), F.col("match")).when(F.col("doc_id") != F.col("first"), F.col("first")).alias("match_id"),
    )


def report(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("status").agg(F.count("*").alias("n"))
