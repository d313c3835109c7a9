"""Token runs: byte tokenizer, replay mixing, train/validation split, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

EOS, PAD, IGNORE = 1, 0, -100
#: Ordered prefix sums run in so many parts of the order, then over the parts' sums: more with more
#: rows, at most so many as a list of cut points may have.
PARTS, PART_ROWS, MOST_PARTS = 64, 1 << 18, 4096


def prefix_sum(df: DataFrame, value: str, order: str, out: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows before in ``order`` (unique, numeric).

    Two levels, so no task holds all rows: ranges of the order are summed, the few sums are added up,
    and each range adds up its own rows.
    """
    if parts is None:
        parts = min(MOST_PARTS, max(PARTS, df.count() // PART_ROWS))
    cuts = df.select(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    cuts = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else None
    # The number of cut points at or below a row's position.
    part = F.lit(0) if cuts is None else F.size(F.filter(cuts, lambda c: c <= F.col(order)))
    df = df.withColumn("_part", part)
    sums = df.groupBy("_part").agg(F.sum(value).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("_s")
    inner = F.coalesce(F.sum(value).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return df.join(F.broadcast(sums), "_part").withColumn(out, F.col("_before") + inner).drop("_part", "_before")


def latest_runs(token_runs: DataFrame) -> DataFrame:
    """One run a document: the first stored that has tokens; roles and groups without nulls."""
    held = token_runs.where(F.size("token_ids") > 0)
    first = held.groupBy("doc_id").agg(F.min("run_id").alias("run_id"))
    label = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("unspecified")).alias(c)
    return held.join(first, ["doc_id", "run_id"], "left_semi").select("doc_id", label("source_role"), label("source_group"), "token_ids", F.size("token_ids").cast("long").alias("n"))


def totals(runs: DataFrame) -> DataFrame:
    """Tokens by role and by group."""
    sets = runs.groupingSets([["source_role"], ["source_group"]], "source_role", "source_group").agg(F.grouping_id().alias("g"), F.sum("n").alias("tokens"), F.count("*").alias("runs"))
    return sets.select(F.when(F.col("g") == 1, "source_role").otherwise("source_group").alias("kind"), F.coalesce("source_role", "source_group").alias("value"), "tokens", "runs")


def replay_select(runs: DataFrame, ratio: float, domain: str = "domain", replay: str = "replay_general") -> DataFrame:
    """All domain runs, then replay runs in order until the next would exceed the target, the first always.

    The target is round(D * r / (1 - r)), half to even, of the D domain tokens.
    """
    target = runs.where(F.col("source_role") == domain).agg(F.bround(F.coalesce(F.sum("n"), F.lit(0)) * F.lit(ratio) / F.lit(1 - ratio)).cast("long")).first()[0]
    own = runs.where(F.col("source_role") == domain).withColumn("_set", F.lit(0))
    if ratio <= 0:
        return own.drop("_set")
    other = prefix_sum(runs.where(F.col("source_role") == replay), "n", "doc_id", "_before")
    # Once a run does not fit, none after it is taken: the prefix of the fitting ones is the rule.
    fits = (F.col("_before") == 0) | ((F.col("_before") + F.col("n") <= target) & (F.col("_before") < target))
    return own.drop("_set").unionByName(other.where(fits).drop("_before"))


def split_key(doc_id: Column, seed: int) -> Column:
    """The order of the split: a stated hash in place of a random shuffle, 52 bits as a number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), doc_id.cast("string"))), 1, 13), 16, 10).cast("long")


def split(runs: DataFrame, ratio: float, length: int, min_blocks: int = 1, seed: int = 13) -> DataFrame:
    """``runs`` with ``split``: validation documents by hash order until the target is reached.

    The target is max(min_blocks * length, round(total * ratio)), held within 1 and total - 1; one
    document at least stays for training.
    """
    total, docs = runs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if ratio <= 0 or min_blocks == 0 or docs == 0:
        return runs.withColumn("split", F.lit("train"))
    want = max(1, min(total - 1, max(min_blocks * length, round(total * ratio))))
    keyed = runs.select("doc_id", "n", split_key(F.col("doc_id"), seed).alias("h"))
    before = prefix_sum(keyed, "n", "h", "_before")
    rows = before.withColumn("_one", F.lit(1).cast("long"))
    last = keyed.agg(F.max("h")).first()[0]
    chosen = rows.where((F.col("_before") < want) & (F.col("h") < last)).select("doc_id", F.lit("validation").alias("split"))
    return runs.join(chosen, "doc_id", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def split_single(runs: DataFrame, ratio: float, length: int, min_blocks: int = 1) -> DataFrame:
    """Each run cut into a training prefix and a validation suffix."""
    n = F.col("n")
    want = F.greatest(F.lit(1).cast("long"), F.least(n - 1, F.greatest(F.lit(min_blocks * length).cast("long"), F.bround(n * F.lit(ratio)).cast("long"))))
    return runs.withColumns({"train_ids": F.slice("token_ids", F.lit(1), (n - want).cast("int")), "validation_ids": F.slice("token_ids", (n - want + 1).cast("int"), want.cast("int"))})


def pack(runs: DataFrame, length: int, drop_remainder: bool = False, order: str = "doc_id", prefix: str = "train") -> DataFrame:
    """Consecutive blocks of ``length`` over all runs in order, with role and group counts.

    Tokens are never exploded: a run gives each block it meets one slice.
    """
    total = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Only lengths are ordered and summed; the tokens meet their start afterwards.
    placed = runs.join(prefix_sum(runs.select(order, "n"), "n", order, "start").select(order, "start"), order)
    first, last = F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("n") - 1) / length)
    spans = placed.select("doc_id", "source_role", "source_group", "token_ids", "start", "n", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * length, F.col("start"))
    end = F.least((F.col("block") + 1) * length, F.col("start") + F.col("n"))
    parts = spans.select(
        "block", "doc_id", "source_role", "source_group", begin.alias("at"), (end - begin).alias("n"),
        F.slice("token_ids", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int")).alias("ids"),
    )
    if drop_remainder:
        parts = parts.where(F.col("block") < total // length)

    def counts(role: str) -> Column:
        names = F.array_sort(F.array_distinct(F.transform("p", lambda x: x[role])))
        entries = F.transform(names, lambda k: F.struct(k.alias("key"), F.aggregate(F.filter("p", lambda x: x[role] == k), F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("value")))
        return F.to_json(F.map_from_entries(entries))

    # A block holds at most ``length`` tokens, so its parts are bounded.
    rows = parts.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "doc_id", "source_role", "source_group", "n", "ids"))).alias("p"))
    rows = rows.withColumn("ids", F.flatten(F.transform("p", lambda x: x["ids"])))
    pad = F.lit(length) - F.size("ids")
    return rows.select(
        F.format_string(f"{prefix}_%010d", "block").alias("block_id"), F.lit(prefix).alias("split"),
        F.concat(F.col("ids").cast("array<bigint>"), F.array_repeat(F.lit(PAD).cast("bigint"), pad)).alias("input_ids"),
        F.concat(F.transform("ids", lambda x: F.lit(1)), F.array_repeat(F.lit(0), pad)).cast("array<tinyint>").alias("attention_mask"),
        F.concat(F.col("ids").cast("array<bigint>"), F.array_repeat(F.lit(IGNORE).cast("bigint"), pad)).alias("labels"),
        F.size("ids").cast("long").alias("original_length"), pad.cast("long").alias("padding_length"),
        counts("source_role").alias("source_roles_json"), counts("source_group").alias("source_groups_json"),
        F.to_json(F.array_sort(F.array_distinct(F.transform("p", lambda x: x["doc_id"].cast("string"))))).alias("doc_ids_json"),
    )


def pack_stats(blocks: DataFrame, length: int) -> DataFrame:
    got = blocks.groupBy("split").agg(F.count("*").alias("blocks"), F.sum("original_length").alias("content"), F.sum("padding_length").alias("padding"))
    return got.withColumn("capacity", F.col("blocks") * length).withColumn("padding_ratio", F.round(F.try_divide(F.col("padding"), F.col("capacity")), 6))
