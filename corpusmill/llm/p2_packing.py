"""Problem 2: runs of tokens into blocks of fixed capacity, little padding, no needless cuts.

The plan works on the histogram of lengths: best fit, longest first, over groups of equal blocks
and counts of equal items, so its cost depends on the capacity and not on the number of documents.
Items then take the planned slots by joining on their rank within their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import Durable

EOS, PAD, IGNORE = 1, 0, -100
#: Items that are ranked together at most, about: a frequent length is ranked in as many parts as
#: it takes, so that it is no one task, and one count a part is all that reaches the driver.
PART_ROWS = 1 << 18


def runs_of(token_runs: DataFrame) -> DataFrame:
    """(doc_id, token_ids, n): of each document its latest run that is not null or empty.

    Only ids, times and lengths are compared; the tokens follow by a join on the run's id.
    """
    n = F.size("token_ids")
    held = token_runs.where((n > 0) & F.col("doc_id").isNotNull() & F.col("run_id").isNotNull())
    last = held.groupBy("doc_id").agg(F.max(F.struct(F.coalesce("tokenized_at", F.lit("1900-01-01").cast("timestamp")).alias("at"), "run_id")).alias("m"))
    return held.join(last.select(F.col("m.run_id").alias("run_id")), "run_id", "left_semi").select("doc_id", "token_ids", n.alias("n"))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, rank_from, rank_to, block_from, offset) for items of at most the capacity.

    An item of the length with rank r in [rank_from, rank_to) stands in block
    block_from + r - rank_from at the offset.  Best fit, longest length first: equal items go to the
    fullest group of equal blocks that still takes them, else to new blocks.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # space left -> [(first block, blocks)]
    blocks = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            space = min((s for s in open_ if s >= length), default=None)
            if space is None:
                fit = capacity // length
                first, many = blocks, -(-left // fit)
                blocks += many
                open_.setdefault(capacity, []).append((first, many))
                space = capacity
            first, many = open_[space].pop()
            if not open_[space]:
                del open_[space]
            take = min(many, left)
            slots.append((length, rank, rank + take, first, capacity - space))
            if take < many:
                open_.setdefault(space, []).append((first + take, many - take))
            if space > length:
                open_.setdefault(space - length, []).append((first, take))
            rank, left = rank + take, left - take
    return slots


def items(runs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, begin, length): whole runs; only a run longer than a block is cut, into full pieces and a rest."""
    pieces = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))
    cut = runs.select("doc_id", "n", F.explode(pieces).alias("piece"))
    begin = F.col("piece") * capacity
    return cut.select("doc_id", "piece", begin.alias("begin"), F.least(F.lit(capacity), F.col("n") - begin).cast("int").alias("length"))


def slots(runs: DataFrame, capacity: int, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, piece, begin, length, block, offset) of every piece of every run.

    ``runs`` has doc_id (unique) and n, the run's length; runs of length 0 or null have no slot.
    """
    spark = runs.sparkSession
    each = items(runs.where("n > 0"), capacity)
    # At most ``capacity`` counts, then one a part, reach the driver, however many the documents.
    histogram = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.count("*").alias("n")).collect()}
    cut = spark.createDataFrame([(k, -(-n // part_rows)) for k, n in sorted(histogram.items()) if n > part_rows], "length int, parts int")
    each = each.join(F.broadcast(cut), "length", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    frequent = [k for k, n in histogram.items() if n > part_rows]
    before, sums = [], {}
    counted = each.where(F.col("length").isin(frequent)).groupBy("length", "part").agg(F.count("*").alias("n")).collect() if frequent else []
    for length, part, n in sorted((r["length"], r["part"], r["n"]) for r in counted):
        before.append((length, part, sums.get(length, 0)))
        sums[length] = sums.get(length, 0) + n
    starts = spark.createDataFrame(before, "length int, part int, before long")
    by_length: dict[int, list] = {}
    for length, *slot in plan(histogram, capacity):
        by_length.setdefault(length, []).append(tuple(slot))
    planned = spark.createDataFrame(list(by_length.items()), "length int, slots array<struct<rank_from: long, rank_to: long, block_from: long, offset: int>>")
    ranked = each.withColumn("r", F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(F.broadcast(starts), ["length", "part"], "left").withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("r"))
    met = ranked.join(F.broadcast(planned), "length")
    met = met.withColumn("slot", F.filter("slots", lambda s: (F.col("rank") >= s["rank_from"]) & (F.col("rank") < s["rank_to"]))[0])
    return met.select("doc_id", "piece", "begin", "length", (F.col("slot.block_from") + F.col("rank") - F.col("slot.rank_from")).alias("block"), F.col("slot.offset").alias("offset"))


def blocks(token_runs: DataFrame, capacity: int, work: Durable | None = None) -> DataFrame:
    """Packed blocks: block_id, input_ids, attention_mask, labels, original_length, padding_length, doc_ids.

    Repeated runs of a document are packed once; null and empty runs not at all.
    """
    runs = runs_of(token_runs)
    placed = slots(runs.select("doc_id", "n"), capacity)
    cut = runs.join(placed, "doc_id").select("block", "offset", "doc_id", F.slice("token_ids", F.col("begin") + 1, F.col("length")).alias("ids"))
    # A block holds at most its capacity in tokens, so its pieces are few and bounded.
    full = cut.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    n = F.size("ids")
    pad = lambda value: F.array_repeat(F.lit(value), F.lit(capacity) - n)
    return full.select("block", ids.alias("ids"), F.array_distinct(F.transform("p", lambda x: x["doc_id"])).alias("doc_ids")).select(
        F.col("block").alias("block_id"),
        F.concat(F.col("ids").cast("array<bigint>"), pad(PAD).cast("array<bigint>")).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), pad(0)).cast("array<tinyint>").alias("attention_mask"),
        F.concat(F.col("ids").cast("array<bigint>"), pad(IGNORE).cast("array<bigint>")).alias("labels"),
        n.cast("long").alias("original_length"),
        (F.lit(capacity) - n).cast("long").alias("padding_length"),
        "doc_ids",
    )


def capacity_of(packed: DataFrame) -> int | None:
    return packed.agg(F.max(F.size("input_ids"))).first()[0]


def needlessly_cut(token_runs: DataFrame, packed: DataFrame) -> DataFrame:
    """(doc_id) of the documents that the plan places whole but an earlier packing cut.

    The planned slot of a document states the length it has whole.  A block of the earlier packing
    is taken apart at the ends of documents; where it lists a document and none of its parts is that
    document's run, by length and 64-bit hash, the run is looked for at every place of the block, as
    it may stand behind a piece without an end.  Where it stands nowhere, the block holds only a
    piece of it.
    """
    capacity = capacity_of(packed)
    if capacity is None:
        return token_runs.select("doc_id").limit(0)
    runs = runs_of(token_runs).select("doc_id", "n", F.xxhash64(F.col("token_ids").cast("array<bigint>")).alias("hash"))
    whole = slots(runs.select("doc_id", "n"), capacity).where("piece = 0").select("doc_id", F.col("length").alias("planned"))
    whole = runs.join(whole, "doc_id").where("planned = n").select("doc_id", "n", "hash")
    used = F.coalesce("original_length", F.size("input_ids") - F.col("padding_length"), F.size("input_ids"))
    ids = F.slice("input_ids", 1, F.greatest(used, F.lit(0)).cast("int"))
    ends = F.filter(F.transform("ids", lambda x, i: F.when(x == EOS, i + 1)), lambda i: i.isNotNull())
    ends = F.array_distinct(F.concat(ends, F.array(F.size("ids"))))
    starts = F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    parts = F.zip_with("starts", "ends", lambda a, b: F.xxhash64(F.slice("ids", a + 1, b - a)))
    blocks_ = packed.select("doc_ids_json", ids.alias("ids")).withColumn("block", F.xxhash64("ids"))
    held = (
        blocks_.withColumn("ends", ends).withColumn("starts", starts)
        .select("block", "doc_ids_json", parts.alias("parts"))
        .select("block", F.explode(F.from_json("doc_ids_json", "array<string>")).alias("doc"), "parts")
        .select("block", F.expr("try_cast(doc as bigint)").alias("doc_id"), "parts")
    )
    # The few that no part answers, written down, so that their size decides how the blocks meet them.
    open_ = held.join(whole, "doc_id").where(~F.array_contains("parts", F.col("hash"))).select("block", "doc_id", "n", "hash").distinct()
    open_ = Durable(packed.sparkSession).keep(open_, "open")
    places = F.sequence(F.lit(1), F.size("ids") - F.col("n") + 1)
    stands = (F.size("ids") >= F.col("n")) & F.exists(places, lambda p: F.xxhash64(F.slice("ids", p, F.col("n"))) == F.col("hash"))
    return blocks_.select("block", "ids").join(open_, "block").where(~F.when(F.size("ids") < F.col("n"), False).otherwise(stands)).select("doc_id").distinct()
