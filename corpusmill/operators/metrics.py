"""The append-only metric facts: latest values, series, stream points, alerts, rankings, layers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .evaluation import finite


def metadata(c: str) -> Column:
    """A JSON map; broken or empty JSON is an empty object."""
    return F.coalesce(F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key by id."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct("value", "step", "created_at", "unit"), "id").alias("m")).select(*keys, "m.*")


def step_series(rows: DataFrame, *keys: str) -> DataFrame:
    """The last value of each key and step; one row a point, so a long series is no single row."""
    good = rows.where(F.col("step").isNotNull() & finite(F.col("value")))
    return good.groupBy(*keys, "step").agg(F.max_by("value", "id").alias("value"))


def stream_points(rows: DataFrame, run: str, domain: str, general: str, fraction: float = 0.02, stop_fraction: float = 0.05, floor: float = 0.0) -> DataFrame:
    """(run, step, domain_gain, general_loss, threshold): movements against the run's first step.

    Missing values stay missing: a step without one of the two metrics has no such movement.
    """
    series = step_series(rows.where(F.col("name").isin(domain, general)), run, "name")
    wide = series.groupBy(run, "step").agg(F.max(F.when(F.col("name") == domain, F.col("value"))).alias("d"), F.max(F.when(F.col("name") == general, F.col("value"))).alias("g"))
    # The reference is one row a run: an aggregate, not a window over the run.
    ref = wide.groupBy(run).agg(F.min_by(F.struct(F.col("d").alias("d0"), F.col("g").alias("g0")), "step").alias("r"))
    met = wide.join(ref, run).select(run, "step", "d", "g", "r.*")
    return met.select(
        run, "step", (F.col("d0") - F.col("d")).alias("domain_gain"), (F.col("g") - F.col("g0")).alias("general_loss"),
        F.greatest(F.lit(floor), F.abs("g0") * fraction).alias("threshold"), F.greatest(F.lit(floor), F.abs("g0") * stop_fraction).alias("stop_threshold"),
        F.col("g0").alias("reference"),
    )


#: Sources of points: a noisy stream during training, and single measurements that count at once.
STREAM, CHECKPOINT = "train_eval_stream", "checkpoint_eval"


def alerts(points: DataFrame, run: str, persistence: int = 2, floor: float = 0.02, overfitting: float = 0.5) -> DataFrame:
    """(run, code, kind, severity, step, source, value, threshold, persistence): warnings and stops of each point.

    A loss above the noise floor that reaches a threshold (``threshold`` to warn, ``stop_threshold``
    to stop) is an alert, on the stream only once it has held for ``persistence`` of its points in a
    row; points of checkpoints fire at once and leave the count as it is.  An ``overfitting_score``
    of ``overfitting`` or more is an alert of its own.  Points without ``source`` are of the stream;
    a run's points are the steps of one training run, and the windows are over them.
    """
    if "source" not in points.columns:
        points = points.withColumn("source", F.lit(STREAM))
    loss, none = F.col("general_loss"), F.lit(None).cast("double")
    by = W.partitionBy(run).orderBy("step")

    def crossed(code: str, severity: str, threshold) -> DataFrame:
        up = F.coalesce((loss > floor) & (loss >= F.coalesce(threshold, F.lit(0.0))), F.lit(False))
        stream = points.where(F.col("source") == STREAM).withColumn("up", up).withColumn("island", F.sum((~F.col("up")).cast("int")).over(by)).where("up")
        stream = stream.withColumn("persistence", F.row_number().over(W.partitionBy(run, "island").orderBy("step"))).where(F.col("persistence") >= persistence)
        single = points.where((F.col("source") != STREAM) & up).withColumn("persistence", F.lit(1))
        columns = (run, F.lit(code).alias("code"), F.lit("forgetting").alias("kind"), F.lit(severity).alias("severity"), "step", "source", loss.alias("value"), threshold.alias("threshold"), "persistence")
        return stream.select(*columns).unionByName(single.select(*columns))

    out = crossed("forgetting_warning", "warning", F.col("threshold"))
    if "stop_threshold" in points.columns:
        out = out.unionByName(crossed("forgetting_stop", "stop", F.col("stop_threshold")))
    if "overfitting_score" in points.columns:
        over = points.where(F.col("overfitting_score") >= overfitting).select(
            run, F.lit("domain_overfitting_warning").alias("code"), F.lit("domain_overfitting").alias("kind"), F.lit("warning").alias("severity"), "step", "source",
            F.col("overfitting_score").alias("value"), F.lit(overfitting).alias("threshold"), none.cast("int").alias("persistence"),
        )
        out = out.unionByName(over)
    return out


def earliest_alerts(found: DataFrame, run: str) -> DataFrame:
    """(run, kind, step): the first alert of each kind."""
    return found.groupBy(run, "kind").agg(F.min("step").alias("step"))


def early_stop(series: DataFrame, run: str, most: float = 0.05, patience: int = 1, min_steps: int = 1) -> DataFrame:
    """(run, stop_step): the first step at or after ``min_steps`` whose rise over the first value exceeds ``most`` for ``patience`` points in a row."""
    by = W.partitionBy(run).orderBy("step")
    d = series.withColumn("delta", F.col("value") - F.first("value").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("up", F.col("delta") > most)
    d = d.withColumn("island", F.sum((~F.col("up")).cast("int")).over(by)).where("up").withColumn("count", F.row_number().over(W.partitionBy(run, "island").orderBy("step")))
    return d.where((F.col("count") >= patience) & (F.col("step") >= min_steps)).groupBy(run).agg(F.min("step").alias("stop_step"))


def recommend(points: DataFrame, found: DataFrame, run: str) -> DataFrame:
    """(run, status, step, source, score): the best point of each run that no stop alert names.

    Points of checkpoints are the candidates where a run has any, else all; the best has the highest
    ``recommendation_score`` (missing counts as 0), ties go to the earlier step.  A run of which every
    candidate is stopped has the status no_safe_checkpoint.
    """
    stops = found.where("severity = 'stop'").select(run, "step").distinct().withColumn("stopped", F.lit(True))
    score = F.coalesce("recommendation_score", F.lit(0.0))
    single = F.col("source") == CHECKPOINT
    met = points.join(stops, [run, "step"], "left").withColumn("key", F.when(F.col("stopped").isNull(), F.struct(score.alias("s"), (-F.col("step")).alias("t"))))
    row = F.struct("step", "source", "recommendation_score")
    best = lambda which: F.max_by(row, F.when(which, F.col("key")))
    got = met.groupBy(run).agg(F.max(single).alias("any"), best(single).alias("c"), best(F.lit(True)).alias("a"))
    m = got.select(run, F.when(F.col("any"), F.col("c")).otherwise(F.col("a")).alias("m"))
    return m.select(run, F.when(F.col("m").isNull(), "no_safe_checkpoint").otherwise("recommended").alias("status"), "m.step", "m.source", F.col("m.recommendation_score").alias("score"))


def rank(runs: DataFrame) -> DataFrame:
    """Ranks by gain, then retention, both falling, then tokens; missing last.  One row a run."""
    order = W.orderBy(F.desc_nulls_last("gain"), F.desc_nulls_last("retention"), F.asc_nulls_last("tokens"), F.asc("run"))
    return runs.withColumn("rank", F.row_number().over(order))


# What two runs must share for their comparison to be of a matched budget.
BUDGET = (
    "model_id model_revision sequence_length max_steps steps_completed realized_train_tokens train_batch_size gradient_accumulation_steps eval_task_paths contamination_policy"
).split()


def matched_budget(a: DataFrame, b: DataFrame, keys: list[str], checks: list[str] = BUDGET, advisory: str = "learning_rate") -> DataFrame:
    """Each check's null-safe equality of two run tables, whether all hold, and whether the advisory does.

    Both have a row a key.  The advisory is reported and does not count.
    """
    met = a.alias("a").join(b.alias("b"), keys)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")).alias(c) for c in [*checks, advisory]]
    return met.select(*keys, *same).withColumn("all_matched", F.expr(" and ".join(checks))).withColumnRenamed(advisory, f"same_{advisory}")


def floor_of(floors: DataFrame, names: list[str], largest: bool = False):
    """The noise floor by names in order of preference: the first that is there, else 0; or the largest, else null.

    ``floors`` has metric and floor, a row a metric; the result is one row with ``floor``.
    """
    by_name = [F.max(F.when(F.col("metric") == n, F.col("floor"))) for n in names]
    if largest:
        return floors.agg((F.greatest(*by_name) if len(by_name) > 1 else by_name[0]).alias("floor"))
    return floors.agg(F.coalesce(*by_name, F.lit(0.0)).alias("floor"))


def differential(a: DataFrame, b: DataFrame, floors: DataFrame, other_floors: DataFrame | None = None) -> DataFrame:
    """(metric, differential, floor, within_noise) of two tables of deltas; the larger floor of the two runs counts."""
    every = floors.select("metric", "floor")
    if other_floors is not None:
        every = every.unionByName(other_floors.select("metric", "floor"))
    every = every.groupBy("metric").agg(F.max("floor").alias("floor"))
    met = a.select("metric", F.col("delta").alias("x")).join(b.select("metric", F.col("delta").alias("y")), "metric").join(every, "metric", "left")
    return met.select("metric", (F.col("x") - F.col("y")).alias("differential"), "floor", (F.abs(F.col("x") - F.col("y")) <= F.col("floor")).alias("within_noise"))


def value_slug(value) -> str:
    """A value of a configuration in a variant's name: case, digits, dots and hyphens stay."""
    text = "-".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)
    return re.sub("[^A-Za-z0-9.-]+", "-", text).strip("-") or "value"


def expand_sweep(spark, axes: dict[str, list]) -> DataFrame:
    """Every combination of the axes' values in product order, named ``key=value__key=value`` by the keys' last parts."""
    out, names = None, [k.split(".")[-1] for k in axes]
    for k, (name, values) in enumerate(zip(names, axes.values())):
        kind = "long" if all(isinstance(v, int) for v in values) else "double" if all(isinstance(v, (int, float)) for v in values) else "string"
        text = [v if kind != "string" else str(v) for v in values]
        one = spark.createDataFrame([(i, v, f"{name}={value_slug(w)}") for i, (v, w) in enumerate(zip(text, values))], f"_{k} int, `{name}` {kind}, _s{k} string")
        out = one if out is None else out.join(F.broadcast(one), F.lit(True))
    at = range(len(names))
    out = out.withColumn("variant", F.concat_ws("__", *(f"_s{k}" for k in at))).withColumn("ordinal", F.row_number().over(W.orderBy(*(f"_{k}" for k in at))))
    return out.drop(*(f"_{k}" for k in at), *(f"_s{k}" for k in at))


# --- layers ----------------------------------------------------------------------------------

# Module names by family.
ATTENTION = ("q_proj", "k_proj", "v_proj", "o_proj", "out_proj")
MLP = ("gate_proj", "up_proj", "down_proj", "fc1", "fc2")
EMBEDDING, HEAD = ("embed_tokens", "wte"), ("lm_head",)
_LAYER = r"(?:^|\.)(?:layers|h|blocks|block)\.(\d+)(?:\.|$)"


def l2(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(finite(n), n)


def module_metadata(name: str) -> list[Column]:
    """Columns layer_index, module, family, matrix_type and label of a parameter's name."""
    c = F.col(name)
    parts = F.split(c, r"\.")
    layer = F.expr(f"try_cast(nullif(regexp_extract({name}, r'{_LAYER}', 1), '') as int)")
    known = F.filter(parts, lambda p: p.isin(*ATTENTION, *MLP, *EMBEDDING, *HEAD))
    rest = F.filter(parts, lambda p: ~p.isin("weight", "bias", "default"))
    module = F.coalesce(F.get(known, 0), F.try_element_at(rest, F.lit(-1)), F.lit("unknown"))
    family = (
        F.when(module.isin(*ATTENTION) | F.contains(c, F.lit("self_attn")), "attention").when(module.isin(*MLP) | F.contains(c, F.lit("mlp")), "mlp")
        .when(module.isin(*EMBEDDING), "embedding").when(module.isin(*HEAD), "head").otherwise("other")
    )
    matrix = (
        F.when(F.contains(c, F.lit(".lora_A.")), "lora_A").when(F.contains(c, F.lit(".lora_B.")), "lora_B")
        .when(F.endswith(c, F.lit(".bias")), "bias").when(F.endswith(c, F.lit(".weight")), "weight").otherwise("parameter")
    )
    label = F.when(layer.isNotNull(), F.format_string("L%02d %s %s", layer, family, module)).otherwise(F.concat_ws(" ", family, module))
    return [layer.alias("layer_index"), module.alias("module"), family.alias("family"), matrix.alias("matrix_type"), label.alias("label")]


def matches_pattern(pattern: Column, name: Column) -> Column:
    """Whether whole segments of the name are the pattern: ``layers.2`` is not in ``layers.20``."""
    return F.contains(F.concat(F.lit("."), name, F.lit(".")), F.concat(F.lit("."), pattern, F.lit(".")))


def layer_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("label").alias("labels"), F.max("movement").alias("max_movement"), F.sum("movement").alias("sum_movement"))


def layer_compare(rows: DataFrame) -> DataFrame:
    """First and last movement of each label; a single row starts at 0."""
    got = rows.groupBy("label").agg(F.min_by("movement", "step").alias("first"), F.max_by("movement", "step").alias("last"), F.countDistinct("step").alias("steps"))
    return got.withColumn("first", F.when(F.col("steps") > 1, F.col("first")).otherwise(0.0)).withColumn("change", F.col("last") - F.col("first"))


def layer_warnings(rows: DataFrame, share: float = 0.5, ratio: float = 1.0, gradient: float = 1000.0) -> DataFrame:
    """(code, step, label, value): a dominant module of at least three moving, large ratios, large gradients."""
    moving = rows.where(F.col("movement") > 0)
    by_step = moving.groupBy("step").agg(F.count("*").alias("n"), F.sum("movement").alias("total"), F.max_by(F.struct("label", "movement"), F.struct("movement", "label")).alias("m"))
    dominant = by_step.where((F.col("n") >= 3) & (F.col("m.movement") / F.col("total") >= share)).select(F.lit("dominant_update_module").alias("code"), "step", "m.label", (F.col("m.movement") / F.col("total")).alias("value"))
    large = rows.where(F.col("ratio") > ratio).select(F.lit("large_update_to_weight_ratio").alias("code"), "step", "label", F.col("ratio").alias("value"))
    grads = rows.where(F.col("gradient") > gradient).select(F.lit("large_gradient_norm").alias("code"), "step", "label", F.col("gradient").alias("value"))
    return dominant.unionByName(large).unionByName(grads)


def memory_estimate(models: DataFrame) -> DataFrame:
    """Bytes of weights, gradients, optimizer, activations and all by mode, and whether they are over the budget.

    ``models`` has model_id, mode, adapter, fp32, targets, rank, length and batch, and may have
    budget_gb; without a budget nothing is over it.
    """
    size = F.regexp_extract("model_id", r"(\d+(?:\.\d+)?)\s*([bBmM])", 1)
    unit = F.lower(F.regexp_extract("model_id", r"(\d+(?:\.\d+)?)\s*([bBmM])", 2))
    params = F.coalesce((F.when(size != "", size).cast("double") * F.when(unit == "b", 1e9).otherwise(1e6)).cast("long"), F.lit(600_000_000).cast("long"))
    width = F.when(F.col("fp32"), 4).otherwise(2)
    lora = F.col("adapter").isin("lora", "qlora")
    part = F.when(F.col("mode") == "full_finetune_small", 1.0).when(F.col("mode") == "partial_unfreeze", 0.05).when(
        lora, F.least(F.greatest(F.greatest("targets", F.lit(1)) / 16 * (F.col("rank") / 4096), F.lit(0.0005)), F.lit(0.02))
    ).otherwise(0.0)
    base = models.withColumns({"parameters": params, "width": width}).withColumn("trainable", (F.col("parameters") * part).cast("long"))
    budget = F.col("budget_gb").cast("double") if "budget_gb" in models.columns else F.lit(None).cast("double")
    out = base.select(
        "model_id", "mode", "parameters", "trainable",
        F.when(F.col("adapter") == "qlora", (F.col("parameters") * 0.5).cast("long")).otherwise(F.col("parameters") * F.col("width")).alias("weight_bytes"),
        (F.col("trainable") * F.col("width")).alias("gradient_bytes"), (F.col("trainable") * 8).alias("optimizer_bytes"),
        (F.col("length") * F.col("batch") * 4096 * F.col("width") * 4).cast("long").alias("activation_bytes"), budget.alias("budget_gb"),
    )
    total = F.col("weight_bytes") + F.col("gradient_bytes") + F.col("optimizer_bytes") + F.col("activation_bytes")
    return out.withColumn("total_bytes", total).withColumn("over_budget", F.coalesce(F.col("total_bytes") > F.col("budget_gb") * (1 << 30), F.lit(False)))


def train_stats(steps: DataFrame, run: str) -> DataFrame:
    """(run, steps, last_loss, mean_loss, token_loss, tokens, tokens_per_second) of the steps of each run.

    ``steps`` has step, loss, tokens and seconds.  ``token_loss`` weighs each step by its tokens;
    steps without a loss or tokens count for neither.
    """
    known = F.col("loss").isNotNull() & (F.col("tokens") > 0)
    out = steps.groupBy(run).agg(
        F.count("*").alias("steps"), F.max_by("loss", F.when(F.col("loss").isNotNull(), F.col("step"))).alias("last_loss"), F.avg("loss").alias("mean_loss"),
        F.sum(F.when(known, F.col("loss") * F.col("tokens"))).alias("_w"), F.sum(F.when(known, F.col("tokens"))).alias("_n"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("_s"),
    )
    return out.withColumns({"token_loss": F.try_divide("_w", F.col("_n")), "tokens_per_second": F.try_divide("tokens", F.col("_s"))}).drop("_w", "_n", "_s")


# --- parameter pairs, scores, labels ---------------------------------------------------------


def lora_pairs(tensors: DataFrame) -> DataFrame:
    """(prefix, a, b, scaling) of the parameters whose names differ only in lora_A and lora_B.

    ``tensors`` has name, rows, cols, values (row by row) and scaling.
    """
    part = lambda side: tensors.where(F.contains("name", F.lit(f".lora_{side}."))).select(
        F.regexp_extract("name", rf"^(.*)\.lora_{side}\.", 1).alias("prefix"), F.struct("rows", "cols", "values").alias(side.lower()), "scaling"
    )
    return part("A").join(part("B").drop("scaling"), "prefix")


def lora_delta_norm(pairs: DataFrame, exact_elements: int = 5_000_000) -> DataFrame:
    """(prefix, norm): the norm of B A times the scaling; above the limit the product of the norms.

    The product is a join of coordinates on the inner index, so no task holds a matrix.
    """
    size = F.col("b.rows").cast("long") * F.col("a.cols")
    small = pairs.where(size <= exact_elements)
    cells = lambda c: F.posexplode(f"{c}.values").alias("p", "v")
    a = small.select("prefix", F.col("a.cols").alias("w"), cells("a")).select("prefix", F.floor(F.col("p") / F.col("w")).alias("k"), (F.col("p") % F.col("w")).alias("j"), F.col("v").cast("double").alias("x"))
    b = small.select("prefix", F.col("b.cols").alias("w"), cells("b")).select("prefix", F.floor(F.col("p") / F.col("w")).alias("i"), (F.col("p") % F.col("w")).alias("k"), F.col("v").cast("double").alias("y"))
    product = a.join(b, ["prefix", "k"]).groupBy("prefix", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("z"))
    exact = product.groupBy("prefix").agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("n"))
    bound = pairs.where(size > exact_elements).select("prefix", (l2(F.col("a.values")) * l2(F.col("b.values"))).alias("n"))
    return exact.unionByName(bound).join(pairs.select("prefix", "scaling"), "prefix").select("prefix", (F.col("n") * F.col("scaling")).alias("norm"))


def reference_rows(now: DataFrame, reference: DataFrame) -> DataFrame:
    """(name, weight_norm, reference_norm, update_norm, ratio) of each parameter against its first state.

    Both have name and ``values``, the elements in order; ``update_norm`` is the norm of the
    difference.  Null without a reference of the same length; the ratio also where its norm is 0.
    """
    met = now.select("name", "values").join(reference.select("name", F.col("values").alias("first")), "name", "left")
    apart = F.when(F.size("values") == F.size("first"), F.zip_with("values", "first", lambda x, y: x.cast("double") - y.cast("double")))
    out = met.select("name", l2(F.col("values")).alias("weight_norm"), F.when(F.col("first").isNotNull(), l2(F.col("first"))).alias("reference_norm"), F.when(apart.isNotNull(), l2(apart)).alias("update_norm"))
    return out.withColumn("ratio", F.try_divide("update_norm", F.col("reference_norm")))


def scored(points: DataFrame, floor: float = 0.0, default_floor: float = 0.02, allowed: bool = True) -> DataFrame:
    """``points`` with forgetting_score, overfitting_score, recommendation_score and interpretation.

    ``points`` has domain_gain, general_loss, reference and qa_delta.  A movement counts only above
    the larger of the two floors.
    """
    least = max(floor, default_floor)
    loss, gain = F.col("general_loss"), F.col("domain_gain")
    meaningful = F.coalesce(loss > least, F.lit(False))
    scale = F.when(F.coalesce(F.col("reference"), F.lit(0.0)) != 0, F.greatest(F.abs("reference"), F.lit(1e-9))).otherwise(1.0)
    forgetting = F.when(F.coalesce(loss > 0, F.lit(False)), F.greatest(F.lit(0.0), loss - least) / scale).otherwise(0.0)
    over = F.when(~F.coalesce(gain > least, F.lit(False)), 0.0).when(F.coalesce(F.col("qa_delta") < -least, F.lit(False)), 1.0).when(F.coalesce(F.abs("qa_delta") <= least, F.lit(False)), 0.5).otherwise(0.0)
    pos = lambda c: F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)))
    out = points.withColumns({"forgetting_score": forgetting, "overfitting_score": over})
    return out.withColumns({
        "recommendation_score": pos(gain) - pos(loss) - F.col("overfitting_score") * F.greatest(pos(gain), F.lit(1.0)),
        "interpretation": F.when(meaningful, "forgetting_warning" if allowed else "diagnostic_general_loss").when(F.col("overfitting_score") > 0, "domain_overfitting_watch").otherwise("within_noise_or_improving"),
    })


def slug(c: Column, most: int = 40) -> Column:
    """A run's name: lower case, all but letters and digits as single hyphens, none at the ends, cut; ``run`` if nothing stays."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(flat, 1, most), F.lit("")), F.lit("run"))


def metric_label(c: Column) -> Column:
    """A name for a metric: all but ASCII letters, digits, dots, underscores and hyphens as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9_.-]+", "_"), "^_+|_+$", "")


def realized(runs: DataFrame) -> DataFrame:
    """Tokens seen and cost of each run: steps x length x batch x accumulation, hours x rate."""
    return runs.select("run", (F.col("steps") * F.col("length") * F.col("batch") * F.col("accumulation")).alias("train_tokens"), (F.col("seconds") / 3600 * F.col("rate")).alias("cost"))


def mini_eval(rows: DataFrame, most: float = 50.0) -> DataFrame:
    """(suite, loss, perplexity): token-weighted loss; the perplexity is infinite from a loss of ``most``."""
    good = rows.where((F.col("metric_name") == "nll") & finite(F.col("value")) & (F.col("token_count") > 0))
    got = good.groupBy("suite").agg((F.sum(F.col("value") * F.col("token_count")) / F.sum("token_count")).alias("loss"))
    return got.withColumn("perplexity", F.when(F.col("loss") >= most, F.lit(float("inf"))).otherwise(F.exp("loss")))
