"""Problem 6: the tokens of each document, and totals by source, language and domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .bpe import TOKENIZERS, encoder
from .common import arrow_map


def language(c: Column) -> Column:
    """The main language tag in lower case; null, blank and undetermined are ``und``."""
    tag = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z]+)", 1))
    return F.when(F.coalesce(tag, F.lit("")) == "", "und").otherwise(tag)


def label(c: Column) -> Column:
    """A role or group in one spelling; null and blank are ``unspecified``."""
    bare = F.lower(F.trim(c))
    return F.when(F.coalesce(bare, F.lit("")) == "", "unspecified").otherwise(bare)


def run_tokens(token_runs: DataFrame) -> DataFrame:
    """(doc_id, run_tokens, run_role, run_group): each document once, by its latest run that has tokens.

    A document whose runs are all null or empty counts 0 tokens.
    """
    n = F.greatest(F.coalesce(F.size("token_ids"), F.lit(0)), F.lit(0))
    order = F.struct((n > 0).alias("has"), F.coalesce("tokenized_at", F.lit("1900-01-01").cast("timestamp")).alias("at"), "run_id")
    return token_runs.groupBy("doc_id").agg(
        F.max_by(n.cast("long"), order).alias("run_tokens"),
        F.max("source_role").alias("run_role"),
        F.max("source_group").alias("run_group"),
    )


def text_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with text replaced by its exact number of tokens; null and empty texts have 0."""
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "text_tokens long"])

    def each(batch):
        e = encoder(path)
        at = batch.schema.get_field_index("text")
        return {c: batch.column(batch.schema.get_field_index(c)) for c in rest} | {"text_tokens": [e.count(t) for t in batch.column(at).to_pylist()]}

    return arrow_map(docs, each, schema)


def document_tokens(docs: DataFrame, token_runs: DataFrame, path: str | None = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, source, lang, domain, run_tokens[, text_tokens]) of every document of either table.

    ``run_tokens`` is null where a document has no run.  A document known by its run only has source
    ``unknown``, language ``und`` and no text.  The domain is role/group, of the document and else of
    its run.  ``path`` None leaves the texts unread.
    """
    own = docs.select("doc_id", "source", "lang", "source_role", "source_group", *(["text"] if path else []))
    if path:
        own = text_tokens(own, path)
    met = own.join(run_tokens(token_runs), "doc_id", "full")
    domain = F.concat_ws("/", label(F.coalesce("source_role", "run_role")), label(F.coalesce("source_group", "run_group")))
    return met.select(
        "doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), language(F.col("lang")).alias("lang"), domain.alias("domain"), "run_tokens",
        *([F.coalesce("text_tokens", F.lit(0).cast("long")).alias("text_tokens")] if path else []),
    )


def cube(tokens: DataFrame) -> DataFrame:
    """Documents and tokens by every subset of source, language and domain; ``*`` stands for all.

    Rows are summed by the full key before the cube, so it expands a few rows for each slice.
    """
    sums = [c for c in ("run_tokens", "text_tokens") if c in tokens.columns]
    base = tokens.groupBy("source", "lang", "domain").agg(
        F.count("*").alias("docs"), F.count("run_tokens").alias("docs_with_run"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums)
    )
    wide = base.cube("source", "lang", "domain").agg(F.sum("docs").alias("docs"), F.sum("docs_with_run").alias("docs_with_run"), *(F.sum(c).alias(c) for c in sums))
    return wide.select(*(F.coalesce(c, F.lit("*")).alias(c) for c in ("source", "lang", "domain")), "docs", "docs_with_run", *sums)
