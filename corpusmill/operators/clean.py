"""Cleaning: normalization, quality reasons, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T


@dataclass(frozen=True)
class CleanConfig:
    unicode_form: str | None = "NFKC"
    min_chars: int = 200
    max_chars: int | None = None
    language: str | None = "en"
    min_alphabetic_ratio: float = 0.25
    max_duplicate_line_ratio: float = 0.60
    min_latin_ratio: float = 0.80
    # Phrases of site notices.
    boilerplate: tuple[str, ...] = ("enable javascript", "cookie policy", "all rights reserved")


def quality_reasons(clean: Column, ratio: Column, config: CleanConfig) -> Column:
    """Every reason to reject a normalized text, in fixed order; all comparisons are strict."""

    def reasons(s: Column) -> Column:
        text, dup = s["text"], s["dup"]
        low = F.lower(text)
        phrases = [F.contains(low, F.lit(p.lower())) for p in config.boilerplate]
        tests = [("too_short", F.length(text) < config.min_chars)]
        if config.max_chars is not None:
            tests.append(("too_long", F.length(text) > config.max_chars))
        tests += [
            ("low_alphabetic_ratio", T.alphabetic_ratio(text) < config.min_alphabetic_ratio),
            ("high_duplicate_line_ratio", dup > config.max_duplicate_line_ratio),
        ]
        if phrases:
            tests.append(("boilerplate_phrase", F.greatest(*phrases) if len(phrases) > 1 else phrases[0]))
        if config.language == "en":
            tests.append(("language_filter", T.latin_ratio(text) < config.min_latin_ratio))
        return F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests)))

    return T.let(F.struct(clean.alias("text"), ratio.alias("dup")), reasons)


def clean(docs: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """``docs`` with ``clean_text``, ``line_count``, ``dup_ratio``, ``controls_removed`` and ``reasons``.

    The duplicate-line ratio is measured before repeated lines go.  The Unicode form is computed
    once and carried as a column.  Blank texts are skipped.
    """
    base = docs.where(~T.is_blank("text"))
    form = T.unicode_form("text", config.unicode_form) if config.unicode_form else F.col("text")
    base = base.withColumn("_form", form)
    base = base.withColumns(
        {"line_count": F.size(T.lines("_form")), "dup_ratio": T.duplicate_line_ratio("_form"), "controls_removed": T.count_controls("_form"), "clean_text": T.normalize("_form", None)}
    ).drop("_form")
    return base.withColumn("reasons", quality_reasons(F.col("clean_text"), F.col("dup_ratio"), config))


def kept(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(F.size("reasons") == 0)


def discard_counts(cleaned: DataFrame) -> DataFrame:
    """Documents by reason; a document counts under each of its reasons."""
    return cleaned.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def rejected_samples(cleaned: DataFrame, order: str = "doc_id", n: int = 20) -> DataFrame:
    """The first rejected documents in corpus order, with a preview."""
    return cleaned.where(F.size("reasons") > 0).orderBy(order).limit(n).select(order, F.array_join("reasons", ",").alias("reasons"), F.substring("clean_text", 1, 240).alias("preview"))
