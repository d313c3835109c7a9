"""Evaluation examples, and their overlap with the corpus by exact hash and by word n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as T

NGRAM = 13
MANDATORY_KINDS = ("surface", "application", "recall")


def examples(surface: DataFrame, application: DataFrame, recall: DataFrame, form: str | None = "NFKC") -> DataFrame:
    """One row an example: ids, kind, text by the fallback rule, prompt, answer, and both hashes.

    The text is the text field, else the filled prompt-like fields and the answer joined by line
    feeds; examples without any text are dropped.
    """

    def rows(t: DataFrame, task: str, kind: str, text, prompt, answer):
        return t.select(F.concat(F.lit(task + ":"), "id").alias("example_id"), F.lit(task).alias("task_id"), F.lit(kind).alias("kind"), text.alias("raw"), prompt.alias("prompt"), answer.alias("answer"))

    none = F.lit(None).cast("string")
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    out = (
        rows(surface, "domain_surface", "surface", F.col("text"), none, none)
        .unionByName(rows(application, "domain_application", "application", F.concat_ws("\n", "question", "answer"), full("question"), full("answer")))
        .unionByName(rows(recall, "domain_recall", "recall", F.concat_ws("\n", "prompt", "answer"), full("prompt"), full("answer")))
    )
    out = out.where(~T.is_blank("raw")).withColumn("text", T.normalize("raw", form))
    return out.select("example_id", "task_id", "kind", "prompt", "answer", "text", T.content_hash("raw").alias("raw_hash"), T.content_hash("text").alias("hash"))


def example_counts(ex: DataFrame) -> DataFrame:
    return ex.groupBy("task_id", "kind").agg(F.count("*").alias("n"), F.count("answer").alias("with_answer"))


def missing_kinds(ex: DataFrame) -> DataFrame:
    """The coverage gate: mandatory kinds without an example."""
    want = ex.sparkSession.createDataFrame([(k,) for k in MANDATORY_KINDS], "kind string")
    return want.join(ex.select("kind"), "kind", "left_anti")


def coverage(ex: DataFrame) -> DataFrame:
    """(kind, n, covered) of the mandatory kinds and of general examples, of which there must be one at least."""
    want = ex.sparkSession.createDataFrame([(k,) for k in (*MANDATORY_KINDS, "general")], "kind string")
    n = ex.groupBy("kind").agg(F.count("*").alias("n"))
    return want.join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0).cast("long")).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("covered"))


def exact(docs: DataFrame, ex: DataFrame) -> DataFrame:
    """(doc_id, example_id) with equal normalized text.  ``docs`` has doc_id and clean_text.

    The examples are a registered, fixed set, so they are the side that is sent.
    """
    return docs.select("doc_id", T.content_hash("clean_text").alias("hash")).join(F.broadcast(ex.select("example_id", "hash")), "hash").select("doc_id", "example_id")


def ngram_index(ex: DataFrame, size: int = NGRAM) -> DataFrame:
    """(example_id, size, gram, total): hashed n-grams of each example's own effective size."""
    base = ex.select("example_id", T.word_tokens("text").alias("w"))
    base = base.select("example_id", T.let(F.col("w"), lambda w: F.struct(T.effective_ngram(w, size).alias("size"), F.transform(T.ngrams(w, T.effective_ngram(w, size)), lambda x: F.xxhash64(x)).alias("g"))).alias("s"))
    return base.where("s.size > 0").select("example_id", F.col("s.size").alias("size"), F.size("s.g").alias("total"), F.explode("s.g").alias("gram"))


def overlaps(docs: DataFrame, ex: DataFrame, size: int = NGRAM, threshold: float = 0.2) -> DataFrame:
    """(doc_id, example_id, size, hits, score) of the pairs whose overlap reaches the threshold.

    Pairs of equal text are not flagged again.  Only n-grams of sizes that examples use are built, as
    64-bit hashes; they meet the index by broadcast, so the corpus is not shuffled by n-gram.
    """
    index = ngram_index(ex, size)
    sizes = sorted(r.size for r in index.select("size").distinct().collect())

    def of_size(w, k: int):
        return F.when(F.size(w) < k, F.array().cast("array<struct<size:int,gram:bigint>>")).otherwise(
            F.transform(F.array_distinct(F.transform(T.windows(w, k), lambda g: F.xxhash64(g))), lambda h: F.struct(F.lit(k).alias("size"), h.alias("gram")))
        )

    every = T.let(T.word_tokens("clean_text"), lambda w: F.flatten(F.array(*(of_size(w, k) for k in sizes)))) if sizes else F.array().cast("array<struct<size:int,gram:bigint>>")
    # Outer, because the optimizer would compute the array once more to see whether it is empty.
    grams = docs.select("doc_id", F.explode_outer(every).alias("s")).select("doc_id", "s.size", "s.gram").where("gram is not null")
    hits = grams.join(F.broadcast(index), ["size", "gram"]).groupBy("doc_id", "example_id", "size", "total").agg(F.count("*").alias("hits"))
    scored = hits.withColumn("score", F.col("hits") / F.col("total")).where(F.col("score") >= threshold)
    return scored.join(exact(docs, ex), ["doc_id", "example_id"], "left_anti").select("doc_id", "example_id", "size", "hits", "score")


def flags(docs: DataFrame, ex: DataFrame, size: int = NGRAM, threshold: float = 0.2) -> DataFrame:
    """Every match: exact first, then by score and example id within a document."""
    e = exact(docs, ex).select("doc_id", "example_id", F.lit("exact").alias("match_type"), F.lit(1.0).alias("score"))
    return e.unionByName(overlaps(docs, ex, size, threshold).select("doc_id", "example_id", F.lit("ngram").alias("match_type"), "score"))


def ordered(found: DataFrame, most: int | None = None) -> DataFrame:
    """``found`` with ``place``: within a document exact matches first, then by falling score and example id.

    With ``most``, the first so many of each document, as a report shows them.
    """
    order = W.partitionBy("doc_id").orderBy("match_type", F.desc("score"), "example_id")
    out = found.withColumn("place", F.row_number().over(order))
    return out if most is None else out.where(F.col("place") <= most)


def totals(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(source_role, documents, flagged, matches) by role, and over all roles as ``*``."""
    n = found.groupBy("doc_id").agg(F.count("*").alias("k"))
    met = docs.select("doc_id", F.coalesce("source_role", F.lit("unspecified")).alias("role")).join(n, "doc_id", "left")
    by = met.groupingSets([["role"], []], "role").agg(F.count("*").alias("documents"), F.count("k").alias("flagged"), F.coalesce(F.sum("k"), F.lit(0).cast("long")).alias("matches"), F.grouping("role").alias("all"))
    return by.select(F.when(F.col("all") == 1, "*").otherwise(F.col("role")).alias("source_role"), "documents", "flagged", "matches")


def enforce(found: DataFrame, mode: str = "remove", override: bool = False) -> None:
    """The stage fails where matches need an override that was not given."""
    if mode == "require_override" and not override and not found.isEmpty():
        raise ValueError("documents match evaluation examples; give an override to keep them")


def status(docs: DataFrame, found: DataFrame, mode: str = "remove") -> DataFrame:
    """(doc_id, status, match_count) of the documents that remain; ``require_override`` keeps all and marks them."""
    n = found.groupBy("doc_id").agg(F.count("*").alias("match_count"))
    if mode == "remove":
        return docs.join(n, "doc_id", "left_anti").select("doc_id", F.lit("clean").alias("status"), F.lit(0).cast("long").alias("match_count"))
    met = docs.join(n, "doc_id", "left")
    return met.select("doc_id", F.when(F.col("match_count").isNull(), "clean").otherwise("contaminated_retained").alias("status"), F.coalesce("match_count", F.lit(0).cast("long")).alias("match_count"))


def match_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("example_id").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("matches"))
