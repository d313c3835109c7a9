"""Evaluation analytics: scores, aggregates, noise floors, deltas and policies."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T

PROXY_PREFIX = "simple_statistical_baseline: "


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def byte_entropy(text: Column) -> Column:
    """struct(nll, perplexity, token_count) of the bytes of a text; an empty one has 0, 1, 0."""

    @F.arrow_udf("nll double, perplexity double, token_count long")
    def entropy(v: pa.Array) -> pa.Array:
        import numpy as np

        nll, n = [], []
        for t in v.to_pylist():
            data = (t or "").encode()
            c = np.bincount(np.frombuffer(data, np.uint8)) if data else np.zeros(0)
            p = c[c > 0] / max(len(data), 1)
            nll.append(float(-(p * np.log(p)).sum()) + 0.0), n.append(len(data))
        nll = np.array(nll)
        return pa.StructArray.from_arrays([pa.array(nll), pa.array(np.exp(nll)), pa.array(n, pa.int64())], ["nll", "perplexity", "token_count"])

    return entropy(text)


def proxy_prediction(prompt: Column) -> Column:
    """The statistical stand-in for generation: a fixed prefix and the first sixteen words."""
    return F.concat(F.lit(PROXY_PREFIX), F.array_join(F.slice(F.filter(F.split(prompt, f"{T.SPACE}+"), lambda x: x != ""), 1, 16), " "))


def exact_match(prediction: Column, answer: Column) -> Column:
    a = T.answer_key(answer)
    return F.when((a != "") & (T.answer_key(prediction) == a), 1.0).otherwise(0.0)


def token_f1(pairs: DataFrame, key: str, prediction: str, answer: str) -> DataFrame:
    """(key, f1): overlap of the multisets of normalized tokens; 0 if either side has none."""

    def counted(c: str, name: str):
        tokens = F.filter(F.split(T.answer_key(c), " "), lambda x: x != "")
        return pairs.select(key, F.explode(tokens).alias("tok")).groupBy(key, "tok").agg(F.count("*").alias(name))

    met = counted(prediction, "p").join(counted(answer, "a"), [key, "tok"], "full").na.fill(0, ["p", "a"])
    sums = met.groupBy(key).agg(F.sum(F.least("p", "a")).alias("o"), F.sum("p").alias("p"), F.sum("a").alias("a"))
    return pairs.select(key).join(sums, key, "left").select(key, F.coalesce(F.when(F.col("o") > 0, 2 * F.col("o") / (F.col("p") + F.col("a"))), F.lit(0.0)).alias("f1"))


def weighted_perplexity(rows: DataFrame) -> DataFrame:
    """Token-weighted mean loss and its exponential; 0 and 1 without tokens."""
    good = rows.where((F.col("metric_name") == "nll") & finite(F.col("value")))
    tokens = F.coalesce(F.sum("token_count"), F.lit(0))
    nll = F.coalesce(F.try_divide(F.sum(F.col("value") * F.col("token_count")), F.sum("token_count").cast("double")), F.lit(0.0))
    return good.agg(tokens.alias("token_count"), nll.alias("nll")).withColumn("perplexity", F.exp("nll"))


def metric_means(rows: DataFrame) -> DataFrame:
    return rows.where(finite(F.col("value"))).groupBy("suite", "kind", "metric_name").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def benchmark_pivot(rows: DataFrame) -> DataFrame:
    """One row with the named cells of the benchmark."""
    cells = [("surface", "perplexity"), ("surface", "nll"), ("recall", "exact_match"), ("recall", "token_f1"), ("application", "exact_match"), ("application", "token_f1")]
    cell = lambda k, m: F.avg(F.when((F.col("kind") == k) & (F.col("metric_name") == m), F.col("value")))
    general = F.avg(F.when((F.col("suite") == "general") & (F.col("metric_name") == "perplexity"), F.col("value"))).alias("general_perplexity")
    return rows.where(finite(F.col("value"))).agg(*(cell(k, m).alias(f"{k}_{m}") for k, m in cells), general, F.countDistinct("example_id").alias("samples"))


def repeat_stats(rows: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, standard error, least and most of each metric."""
    got = rows.where(finite(F.col("value"))).groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.min("value").alias("least"), F.max("value").alias("most")
    )
    return got.withColumn("se", F.col("sd") / F.sqrt("n"))


#: Draws that are made at once, and values of one block; a draw within a block takes two bytes.
DRAWS, VALUES = 1 << 18, 1 << 16
_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def _md5_block(state: list, words: list) -> list:
    """The MD5 state after one block of sixteen words, which are numbers or arrays of numbers of 32 bits."""
    a, b, c, d = state
    for k in range(64):
        if k < 16:
            f, at = d ^ (b & (c ^ d)), k
        elif k < 32:
            f, at = c ^ (d & (b ^ c)), (5 * k + 1) % 16
        elif k < 48:
            f, at = b ^ c ^ d, (3 * k + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * k % 16
        turn = _TURNS[k // 16][k % 4]
        f = f + a + (words[at] + np.uint32(_SINES[k]))
        a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
    return [x + y for x, y in zip(state, (a, b, c, d))]


def draws(prefix: bytes, first: int, last: int) -> np.ndarray:
    """Of each i in [first, last), the number of the first seven hexadecimal digits of md5(prefix + i), many at once."""
    out, at = np.empty(max(0, last - first), np.int64), first
    with np.errstate(over="ignore"):
        while at < last:
            digits = len(str(at))
            i = np.arange(at, min(last, 10**digits, at + 8192), dtype=np.uint32 if last < 1 << 32 else np.uint64)
            length = len(prefix) + digits
            text = prefix + bytes(digits) + b"\x80" + bytes(-(length + 9) % 64) + (8 * length).to_bytes(8, "little")
            words = [np.array([x], np.uint32) for x in np.frombuffer(text, "<u4")]
            rest = i
            for place in range(length - 1, len(prefix) - 1, -1):
                rest, digit = rest // 10, rest
                words[place // 4] = words[place // 4] | ((digit - rest * 10 + 48).astype(np.uint32) << np.uint32(8 * (place % 4)))
            state = [np.array([x], np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
            for k in range(0, len(words), 16):
                state = _md5_block(state, words[k : k + 16])
            out[at - first : at - first + len(i)] = state[0].byteswap() >> np.uint32(4)
            at += len(i)
    return out


def _drawn(seed: int, values: int):
    """From (metric, n, b, start, end): what the draws of the numbers from start to end hit, by blocks of values."""

    def each(batches):
        names = ["metric", "block", "b", "hits"]
        for batch in batches:
            for metric, n, b, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                j = np.sort(draws(f"{seed}:{metric}:{b}:".encode(), start, end) % n)
                block = j // values
                ends = np.flatnonzero(np.diff(block, append=-1)) + 1
                hits = [x.tobytes() for x in np.split((j % values).astype("<u2"), ends[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array([metric] * len(ends)), pa.array(block[ends - 1]), pa.array([b] * len(ends), pa.int32()), pa.array(hits, pa.binary())], names)

    return each


def _summed(values: pa.Table, drawn: pa.Table) -> pa.Table:
    """(metric, b, total) of one block: the sum of its values as often as each resample hits them."""
    v = np.zeros(values.num_rows)
    v[values.column("at").to_numpy()] = values.column("value").to_numpy()
    total = [float(v[np.frombuffer(x.as_py(), "<u2")].sum()) for x in drawn.column("hits")]
    return pa.table({"metric": drawn.column("metric"), "b": drawn.column("b"), "total": pa.array(total, pa.float64())})


def bootstrap(rows: DataFrame, samples: int = 200, seed: int = 9186, size: int = DRAWS, values: int = VALUES) -> DataFrame:
    """(metric, n, low, high, half_width): percentile interval of the mean over resampled values.

    ``rows`` has metric, value, example_id and evaluated_at.  Values are numbered within a metric in
    parts by hash, so no task ranks a whole metric.  No draw is a row: a resample's draws are made
    ``size`` at a time from the count of values alone, and their numbers within each block of
    ``values`` values go to the task that has this block.  One value, or no samples, gives a point.
    """
    good = rows.where(finite(F.col("value")) & F.col("metric").isNotNull()).withColumn("part", F.coalesce(F.substring(F.md5("example_id"), 1, 2), F.lit("none")))
    inside = F.row_number().over(W.partitionBy("metric", "part").orderBy(*(F.asc_nulls_last(c) for c in ("example_id", "evaluated_at", "value"))))
    point = good.groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    if samples <= 0:
        return point.select("metric", "n", F.col("mean").alias("low"), F.col("mean").alias("high"), F.lit(0.0).alias("half_width"))
    parts = good.groupBy("metric", "part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("metric").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = good.withColumn("k", inside).join(parts.withColumn("before", before), ["metric", "part"]).withColumn("i", F.col("before") + F.col("k") - 1)
    blocks = numbered.select("metric", F.floor(F.col("i") / values).alias("block"), F.pmod("i", F.lit(values)).alias("at"), "value")
    jobs = point.select("metric", "n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("b")).select("metric", "n", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(size))).alias("start"))
    # A stated number of tasks: these rows are few and small, so they would be merged into one.
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    jobs = jobs.repartition(tasks, "metric", "b", "start").select("metric", "n", "b", "start", F.least(F.col("start") + size, F.col("n")).alias("end"))
    drawn = jobs.mapInArrow(_drawn(seed, values), "metric string, block long, b int, hits binary")
    keys = ["metric", "block"]
    sums = blocks.groupBy(*keys).cogroup(drawn.groupBy(*keys)).applyInArrow(_summed, "metric string, b int, total double")
    # As many sums as samples a metric: bounded by the parameter.
    got = sums.groupBy("metric", "b").agg(F.sum("total").alias("total")).groupBy("metric").agg(F.sort_array(F.collect_list("total")).alias("m"))
    at = lambda q: F.element_at("m", int(q * (samples - 1)) + 1) / F.col("n")
    met = point.join(got, "metric").withColumns({"low": F.when(F.col("n") > 1, at(0.025)).otherwise(F.col("mean")), "high": F.when(F.col("n") > 1, at(0.975)).otherwise(F.col("mean"))})
    return met.select("metric", "n", "low", "high", ((F.col("high") - F.col("low")) / 2).alias("half_width"))


def noise_floors(stats: DataFrame, boot: DataFrame, configured: dict[str, float] | None = None) -> DataFrame:
    """(metric, floor, degenerate): the largest of standard error, half width and configured floor."""
    spark = stats.sparkSession
    conf = spark.createDataFrame(list((configured or {}).items()), "metric string, configured double")
    met = stats.select("metric", "se").join(boot.select("metric", "n", "half_width"), "metric", "full").join(F.broadcast(conf), "metric", "left")
    floor = F.greatest(F.coalesce("se", F.lit(0.0)), F.coalesce("half_width", F.lit(0.0)), F.coalesce("configured", F.lit(0.0)))
    return met.select("metric", floor.alias("floor"), ((F.coalesce("n", F.lit(0)) < 2) & F.col("configured").isNull()).alias("degenerate"))


def alert_policy(boot: DataFrame, required: bool = True, configured: bool = False) -> DataFrame:
    """One row: whether alerts may fire, and why."""
    got = boot.agg(F.count("*").alias("metrics"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    status = (
        F.when(F.lit(not required), "noise_floor_not_required").when(F.col("metrics") == 0, "blocked")
        .when((F.col("most") < 2) & F.lit(not configured), "insufficient_calibration_data").otherwise("calibrated")
    )
    return got.select(status.alias("status"), status.isin("noise_floor_not_required", "calibrated").alias("alerts_allowed"))


def deltas(base: DataFrame, other: DataFrame) -> DataFrame:
    """(metric, base, checkpoint, delta) over all metrics of either side; null where one is missing."""
    return base.select("metric", F.col("mean").alias("base")).join(other.select("metric", F.col("mean").alias("checkpoint")), "metric", "full").withColumn("delta", F.col("checkpoint") - F.col("base"))
