"""Every registered query of the corpus and evaluation pipeline.

Each takes (spark, sf_dir), reads whole tables, and has its statement in ``oracle.py``.  Corpus order
is ``doc_id``.  Cleaning in the SQL-checked queries uses the Unicode form that DuckDB has, NFC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import clean as C, corpus
from ..session import keep, spread, table

QUERIES: dict = {}
SQL_CLEAN = C.CleanConfig(unicode_form="NFC")


def query(f):
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


@query
def q_ingest_documents(spark, sf_dir):
    return corpus.documents(docs(spark, sf_dir))


@query
def q_ingest_counts(spark, sf_dir):
    return corpus.counts(corpus.documents(docs(spark, sf_dir)))


@query
def q_source_stats(spark, sf_dir):
    return corpus.source_stats(corpus.documents(docs(spark, sf_dir)), table(spark, sf_dir, "mix_targets"))


@query
def q_line_stats(spark, sf_dir):
    d = docs(spark, sf_dir).where(~T.is_blank("text"))
    return d.select("doc_id", F.size(T.lines("text")).alias("line_count"), F.round(T.duplicate_line_ratio("text"), 6).alias("dup_ratio"))


@query
def q_char_ratios(spark, sf_dir):
    d = docs(spark, sf_dir).where(F.col("text").isNotNull())
    return d.select("doc_id", F.round(T.alphabetic_ratio("text"), 6).alias("alphabetic_ratio"), F.round(T.latin_ratio("text"), 6).alias("latin_ratio"))


@query
def q_normalize_text(spark, sf_dir):
    c = C.clean(docs(spark, sf_dir), SQL_CLEAN)
    return c.select("doc_id", "controls_removed", F.length("clean_text").alias("chars"), F.md5("clean_text").alias("hash"))


@query
def q_quality_reasons(spark, sf_dir):
    c = C.clean(docs(spark, sf_dir), SQL_CLEAN)
    return c.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query
def q_discard_counts(spark, sf_dir):
    return C.discard_counts(C.clean(docs(spark, sf_dir), SQL_CLEAN))


@query
def q_rejected_samples(spark, sf_dir):
    return C.rejected_samples(C.clean(docs(spark, sf_dir), SQL_CLEAN))


@query
def q_clean_compatibility(spark, sf_dir):
    """Cleaning with the default compatibility form; DuckDB has none, so tests hold it against Python."""
    c = C.clean(docs(spark, sf_dir))
    return c.select("doc_id", "line_count", F.length("clean_text").alias("chars"), F.array_join("reasons", ",").alias("reasons"))


@query
def q_html_text(spark, sf_dir):
    return table(spark, sf_dir, "web_captures").where(F.col("text").isNotNull()).select("capture_id", F.md5(T.html_text("text")).alias("hash"))


@query
def q_shingle_counts(spark, sf_dir):
    d = docs(spark, sf_dir).where(F.col("text").isNotNull()).withColumn("w", T.word_tokens("text"))
    return d.select("doc_id", F.size("w").alias("words"), F.size(T.shingles(F.col("w"), 5)).alias("shingles"))


# --- deduplication ---------------------------------------------------------------------------

from ..operators import contamination as K, dedup as D  # noqa: E402

NEAR = 0.6


def _texts(spark, sf_dir):
    return docs(spark, sf_dir).where(~T.is_blank("text")).select("doc_id", "text", "source", "source_role")


@query
def q_minhash_signature(spark, sf_dir):
    s = D.signatures(_texts(spark, sf_dir))
    return s.select("doc_id", F.md5(F.array_join("sig", ",")).alias("sig"))


@query
def q_lsh_candidates(spark, sf_dir):
    return D.candidate_pairs(D.signatures(_texts(spark, sf_dir)), 0.0).select("a", "b", F.round("sim", 6).alias("sim"))


@query
def q_near_dup_pairs(spark, sf_dir):
    return D.candidate_pairs(D.signatures(_texts(spark, sf_dir)), NEAR).select("a", "b", F.round("sim", 6).alias("sim"))


@query
def q_exact_dedup(spark, sf_dir):
    return D.decide(_texts(spark, sf_dir), near=False)


@query
def q_dedup_decisions(spark, sf_dir):
    return D.decide(_texts(spark, sf_dir), threshold=NEAR).select("doc_id", "status")


@query
def q_dedup_report(spark, sf_dir):
    return D.report(D.decide(_texts(spark, sf_dir), threshold=NEAR))


# --- contamination ---------------------------------------------------------------------------


def _examples(spark, sf_dir):
    return keep(K.examples(*(table(spark, sf_dir, f"domain_{t}") for t in ("surface", "application", "recall")), form="NFC"))


def _cleaned(spark, sf_dir):
    """The stage's output as the next stages read it: written once, not computed by each of them."""
    return keep(C.clean(docs(spark, sf_dir), SQL_CLEAN).select("doc_id", "clean_text", "source_role"))


@query
def q_eval_examples(spark, sf_dir):
    return _examples(spark, sf_dir).select("example_id", "task_id", "kind", "prompt", "answer", "raw_hash", "hash")


@query
def q_eval_counts(spark, sf_dir):
    return K.example_counts(_examples(spark, sf_dir))


@query
def q_eval_coverage(spark, sf_dir):
    return K.coverage(_examples(spark, sf_dir))


@query
def q_contam_exact(spark, sf_dir):
    """The examples' texts stand among the documents, so that equal texts exist."""
    ex = _examples(spark, sf_dir)
    d = _cleaned(spark, sf_dir).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("doc_id"), "clean_text")
    return K.exact(d.unionByName(ex.select(F.concat(F.lit("item:"), "example_id").alias("doc_id"), F.col("text").alias("clean_text"))), ex)


@query
def q_contam_ordered(spark, sf_dir):
    """The five first matches of each document in the order of a report."""
    found = K.ordered(K.flags(_cleaned(spark, sf_dir), _examples(spark, sf_dir)), most=5)
    return found.select("doc_id", "place", "example_id", "match_type", F.round("score", 6).alias("score"))


@query
def q_contam_totals(spark, sf_dir):
    d = _cleaned(spark, sf_dir)
    return K.totals(d, K.flags(d, _examples(spark, sf_dir)))


@query
def q_contam_ngram(spark, sf_dir):
    o = K.overlaps(_cleaned(spark, sf_dir), _examples(spark, sf_dir))
    return o.select("doc_id", "example_id", "size", "hits", F.round("score", 6).alias("score"))


@query
def q_contam_short(spark, sf_dir):
    """Twenty words, so that most examples fall back to their own length."""
    o = K.overlaps(_cleaned(spark, sf_dir), _examples(spark, sf_dir), size=20)
    return o.select("doc_id", "example_id", "size", "hits", F.round("score", 6).alias("score"))


@query
def q_contam_status(spark, sf_dir):
    d = _cleaned(spark, sf_dir)
    return K.status(d, K.flags(d, _examples(spark, sf_dir)), "require_override")


@query
def q_contam_report(spark, sf_dir):
    return K.match_counts(K.flags(_cleaned(spark, sf_dir), _examples(spark, sf_dir)))


# --- tokens ----------------------------------------------------------------------------------

from ..operators import tokens as N  # noqa: E402

LENGTH = 512


def _runs(spark, sf_dir):
    return N.latest_runs(table(spark, sf_dir, "token_runs"))


@query
def q_byte_tokens(spark, sf_dir):
    d = docs(spark, sf_dir).where(F.col("text").isNotNull()).withColumn("ids", F.concat(T.byte_tokens("text"), F.array(F.lit(1))))
    return d.select("doc_id", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query
def q_tokens_by_role(spark, sf_dir):
    return N.totals(_runs(spark, sf_dir))


@query
def q_replay_select(spark, sf_dir):
    return N.replay_select(_runs(spark, sf_dir), 0.2).select("doc_id", "source_role", "n")


@query
def q_split_assign(spark, sf_dir):
    return N.split(_runs(spark, sf_dir), 0.05, LENGTH).select("doc_id", "split")


@query
def q_single_doc_split(spark, sf_dir):
    s = N.split_single(_runs(spark, sf_dir).where("n > 1"), 0.25, 8)
    return s.select("doc_id", F.size("train_ids").alias("train"), F.size("validation_ids").alias("validation"), F.element_at("validation_ids", 1).alias("first"))


@query
def q_pack_blocks(spark, sf_dir):
    b = N.pack(_runs(spark, sf_dir), LENGTH)
    return b.select("block_id", F.md5(F.array_join("input_ids", ",")).alias("ids"), "original_length", "padding_length", "source_roles_json", "doc_ids_json")


@query
def q_pack_stats(spark, sf_dir):
    return N.pack_stats(N.pack(_runs(spark, sf_dir), LENGTH), LENGTH)


@query
def q_pack_scan(spark, sf_dir):
    """The reader of stored blocks: one split, three columns."""
    b = table(spark, sf_dir, "packed_blocks").where("split = 'validation'").select("input_ids", "attention_mask", "labels")
    return b.select(F.md5(F.array_join("input_ids", ",")).alias("ids"), F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("content"), F.size(F.filter("labels", lambda x: x == -100)).alias("ignored"))


# --- evaluation ------------------------------------------------------------------------------

from ..operators import evaluation as E, metrics as M  # noqa: E402

BOOTSTRAPS, SEED = 20, 9186
#: The draws of the reference, for the queries ending in _200; those with fewer are the ones SQL repeats.
REFERENCE_BOOTSTRAPS = 200


def _results(spark, sf_dir):
    return table(spark, sf_dir, "eval_results").withColumn("metric", F.concat_ws(".", "task_id", "metric_name"))


def _pairs(spark, sf_dir):
    """Answers of the application task against those of the recall task with the same number."""
    number = F.regexp_extract("id", r"_(\d+)$", 1).alias("n")
    a = table(spark, sf_dir, "domain_application").select(number, F.coalesce("answer", F.lit("")).alias("prediction"))
    return a.join(table(spark, sf_dir, "domain_recall").select(number, F.coalesce("answer", F.lit("")).alias("answer")), "n")


@query
def q_byte_perplexity(spark, sf_dir):
    d = docs(spark, sf_dir).where(F.col("text").isNotNull()).select("doc_id", E.byte_entropy(F.col("text")).alias("e"))
    return d.select("doc_id", F.round("e.nll", 6).alias("nll"), F.round("e.perplexity", 6).alias("perplexity"), "e.token_count")


@query
def q_overall_perplexity(spark, sf_dir):
    return E.weighted_perplexity(_results(spark, sf_dir)).select("token_count", F.round("nll", 6).alias("nll"), F.round("perplexity", 6).alias("perplexity"))


@query
def q_metric_means(spark, sf_dir):
    return E.metric_means(_results(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query
def q_benchmark_pivot(spark, sf_dir):
    p = E.benchmark_pivot(_results(spark, sf_dir))
    return p.select(*(F.round(c, 6).alias(c) for c in p.columns))


@query
def q_exact_match(spark, sf_dir):
    r = table(spark, sf_dir, "domain_recall")
    own = E.exact_match(F.concat(F.lit(" "), F.upper("answer"), F.lit("!")), F.col("answer"))
    return r.select("id", E.exact_match(E.proxy_prediction(F.coalesce("prompt", F.lit(""))), F.coalesce("answer", F.lit(""))).alias("proxy"), F.coalesce(own, F.lit(0.0)).alias("own"))


@query
def q_token_f1(spark, sf_dir):
    return E.token_f1(_pairs(spark, sf_dir), "n", "prediction", "answer").withColumn("f1", F.round("f1", 6))


@query
def q_lexical_drift(spark, sf_dir):
    return _pairs(spark, sf_dir).select("n", F.round(T.lexical_drift("prediction", "answer"), 6).alias("drift"))


@query
def q_drift_summary(spark, sf_dir):
    p = _pairs(spark, sf_dir).select(T.lexical_drift("prediction", "answer").alias("d"), T.repetition_ratio("prediction").alias("r"))
    return p.agg(F.round(F.avg("d"), 6).alias("mean_drift"), F.round(F.max("r"), 6).alias("max_repetition"))


@query
def q_repetition(spark, sf_dir):
    d = docs(spark, sf_dir).where(F.col("text").isNotNull())
    return d.select("doc_id", F.round(T.repetition_ratio("text"), 6).alias("repetition"))


@query
def q_repeat_stats(spark, sf_dir):
    s = E.repeat_stats(_results(spark, sf_dir))
    return s.select("metric", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "se", "least", "most")))


def _intervals(spark, sf_dir, samples):
    b = E.bootstrap(_results(spark, sf_dir), samples, SEED)
    return b.select("metric", "n", *(F.round(c, 6).alias(c) for c in ("low", "high", "half_width")))


@query
def q_bootstrap_ci(spark, sf_dir):
    return _intervals(spark, sf_dir, BOOTSTRAPS)


@query
def q_bootstrap_ci_200(spark, sf_dir):
    return _intervals(spark, sf_dir, REFERENCE_BOOTSTRAPS)


def _floors(spark, sf_dir, samples=BOOTSTRAPS):
    r = _results(spark, sf_dir)
    return E.noise_floors(E.repeat_stats(r), E.bootstrap(r, samples, SEED), {"domain_surface.nll": 0.05})


@query
def q_noise_floors(spark, sf_dir):
    return _floors(spark, sf_dir).withColumn("floor", F.round("floor", 6))


@query
def q_noise_floors_200(spark, sf_dir):
    return _floors(spark, sf_dir, REFERENCE_BOOTSTRAPS).withColumn("floor", F.round("floor", 6))


@query
def q_alert_policy(spark, sf_dir):
    return E.alert_policy(E.bootstrap(_results(spark, sf_dir), 0))


def _deltas(spark, sf_dir):
    """The validation split stands for the base, the other for the checkpoint."""
    r = _results(spark, sf_dir).where(E.finite(F.col("value")))
    mean = lambda split: r.where(F.col("split") == split).groupBy("metric").agg(F.avg("value").alias("mean"))
    return E.deltas(mean("validation"), mean("eval"))


@query
def q_checkpoint_deltas(spark, sf_dir):
    return _deltas(spark, sf_dir).select("metric", *(F.round(c, 6).alias(c) for c in ("base", "checkpoint", "delta")))


def _differential(spark, sf_dir, samples):
    d = _deltas(spark, sf_dir)
    half = d.withColumn("delta", F.col("delta") / 2)
    x = M.differential(d, half, _floors(spark, sf_dir, samples))
    return x.select("metric", F.round("differential", 6).alias("differential"), F.round("floor", 6).alias("floor"), "within_noise")


@query
def q_differential(spark, sf_dir):
    return _differential(spark, sf_dir, BOOTSTRAPS)


@query
def q_differential_200(spark, sf_dir):
    return _differential(spark, sf_dir, REFERENCE_BOOTSTRAPS)


# --- metric facts ----------------------------------------------------------------------------

DOMAIN, GENERAL, RUN = "domain_surface_perplexity", "general_perplexity", "config_hash"


def _metrics(spark, sf_dir):
    return table(spark, sf_dir, "metric_rows")


@query
def q_metric_scan(spark, sf_dir):
    m = _metrics(spark, sf_dir).withColumn("m", M.metadata("metadata_json"))
    return m.select("id", "stage", "name", F.try_element_at("m", F.lit("device")).alias("device"), F.size("m").alias("keys"))


@query
def q_latest_metrics(spark, sf_dir):
    return M.latest(_metrics(spark, sf_dir), "stage", "name").withColumn("value", F.round("value", 6))


@query
def q_step_series(spark, sf_dir):
    return M.step_series(_metrics(spark, sf_dir), RUN, "stage", "name").withColumn("value", F.round("value", 6))


def _points(spark, sf_dir):
    return M.stream_points(_metrics(spark, sf_dir), RUN, DOMAIN, GENERAL)


@query
def q_stream_points(spark, sf_dir):
    return _points(spark, sf_dir).select(RUN, "step", *(F.round(c, 6).alias(c) for c in ("domain_gain", "general_loss", "threshold")))


def _scored_points(spark, sf_dir):
    """Points with their scores; every fifth step counts as a checkpoint's, of which alone answers were measured."""
    p = _points(spark, sf_dir).withColumn("source", F.when(F.col("step") % 5 == 0, M.CHECKPOINT).otherwise(M.STREAM))
    return M.scored(p.withColumn("qa_delta", F.when(F.col("source") == M.CHECKPOINT, F.col("step") % 3 / 50.0 - 0.03)))


@query
def q_alerts(spark, sf_dir):
    x = M.alerts(_scored_points(spark, sf_dir), RUN)
    return x.select(RUN, "code", "kind", "severity", "step", "source", F.round("value", 6).alias("value"), F.round("threshold", 6).alias("threshold"), "persistence")


@query
def q_early_stop(spark, sf_dir):
    return M.early_stop(M.step_series(_metrics(spark, sf_dir).where(F.col("name") == "train_loss"), RUN), RUN, patience=2, min_steps=10)


@query
def q_recommend(spark, sf_dir):
    p = _scored_points(spark, sf_dir)
    return M.recommend(p, M.alerts(p, RUN), RUN).withColumn("score", F.round("score", 6))


@query
def q_train_stats(spark, sf_dir):
    """Losses of the training steps; a step's tokens are its rate over two seconds, where the rate was recorded."""
    s = M.step_series(_metrics(spark, sf_dir).where(F.col("stage") == "train"), RUN, "name").where(F.col("name").isin("train_loss", "tokens_per_second"))
    value = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    steps = s.groupBy(RUN, F.floor(F.col("step") / 50).alias("step")).agg(value("train_loss").alias("loss"), F.floor(value("tokens_per_second") * 2).alias("tokens"))
    x = M.train_stats(steps.withColumn("seconds", F.when(F.col("tokens").isNotNull(), 2.0)), RUN)
    return x.select(RUN, "steps", "tokens", *(F.round(c, 6).alias(c) for c in ("last_loss", "mean_loss", "token_loss", "tokens_per_second")))


def _run_table(spark, sf_dir):
    """A row a run: the latest of some metrics."""
    m = _metrics(spark, sf_dir).where(E.finite(F.col("value")))
    last = lambda n: F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("id")))
    return m.groupBy(F.col(RUN).alias("run")).agg(
        F.max("step").alias("steps"), last(DOMAIN).alias("domain"), last(GENERAL).alias("general"), last("raw_token_count").alias("tokens"), last("learning_rate").alias("lr")
    )


@query
def q_run_ranking(spark, sf_dir):
    r = _run_table(spark, sf_dir).select("run", (-F.col("domain")).alias("gain"), (-F.col("general")).alias("retention"), "tokens")
    return M.rank(r).select("run", "rank", F.round("gain", 6).alias("gain"))


@query
def q_matched_budget(spark, sf_dir):
    """Every run against the first; what the metrics do not hold follows from the run's name."""
    part = lambda k: F.conv(F.substring("run", k, 1), 16, 10).cast("int")
    r = _run_table(spark, sf_dir).select(
        "run", F.when(part(1) < 12, "a").otherwise("b").alias("model_id"), F.lit("main").alias("model_revision"), F.when(part(2) < 12, 1024).alias("sequence_length"),
        (F.ceil(F.col("steps") / 2000) * 2000).alias("max_steps"), "steps", F.round(F.col("tokens") / 200000).alias("realized_train_tokens"), (part(3) % 2).alias("train_batch_size"),
        F.lit(4).alias("gradient_accumulation_steps"), F.array(F.lit("t")).alias("eval_task_paths"), F.when(part(4) < 8, "warn").alias("contamination_policy"), F.col("lr").alias("learning_rate"),
    ).withColumn("steps_completed", F.floor(F.col("steps") / 2000)).drop("steps")
    first = r.agg(F.min_by(F.struct(*r.columns), "run").alias("m")).select("m.*").drop("run")
    every = r.select("run").join(F.broadcast(first), F.lit(True))
    return M.matched_budget(r, every, ["run"])


@query
def q_floor_lookup(spark, sf_dir):
    f = keep(_floors(spark, sf_dir, BOOTSTRAPS))
    names = ["no.such.metric", "domain_recall.token_f1", "domain_application.token_f1"]
    x = M.floor_of(f, names).select(F.lit("first").alias("rule"), "floor").unionByName(M.floor_of(f, names, largest=True).select(F.lit("largest").alias("rule"), "floor"))
    x = x.unionByName(M.floor_of(f, names[:1]).select(F.lit("first of none").alias("rule"), "floor")).unionByName(M.floor_of(f, names[:1], largest=True).select(F.lit("largest of none").alias("rule"), "floor"))
    return x.withColumn("floor", F.round("floor", 6))


@query
def q_sweep_expand(spark, sf_dir):
    return M.expand_sweep(spark, {"adapter.rank": [2, 4], "adapter.targets": ["Q_proj all", "MLP/down"], "training.lr": [0.001, 0.0005]})


@query
def q_memory_estimate(spark, sf_dir):
    rows = [("Demo-0.6B", "adapter", "lora", False, 4, 8, 128, 1, None), ("Demo-4B", "adapter", "qlora", False, 7, 16, 1024, 2, 2.0), ("demo-350M", "full_finetune_small", "none", True, 0, 0, 512, 4, 5.0), ("unnamed", "partial_unfreeze", "none", False, 0, 0, 256, 1, 1.0)]
    return M.memory_estimate(spark.createDataFrame(rows, "model_id string, mode string, adapter string, fp32 boolean, targets int, rank int, length int, batch int, budget_gb double"))


# --- layers ----------------------------------------------------------------------------------


def _layers(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("norm", M.l2(F.col("embedding")) * (F.col("vec_id") % 11 + 1))
    return e.select(F.concat(F.lit("L"), F.col("label")).alias("label"), (F.col("vec_id") % 7).alias("step"), F.col("norm").alias("movement"), (F.col("norm") / 8).alias("ratio"), (F.col("norm") * 125).alias("gradient"), "vec_id")


@query
def q_layer_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(M.l2(F.col("embedding")), 6).alias("norm"))


@query
def q_layer_summary(spark, sf_dir):
    s = M.layer_summary(_layers(spark, sf_dir))
    return s.select("rows", "labels", F.round("max_movement", 6).alias("max_movement"), F.round("sum_movement", 4).alias("sum_movement"))


def _steps(spark, sf_dir):
    return _layers(spark, sf_dir).groupBy("label", "step").agg(F.max("movement").alias("movement"), F.max("ratio").alias("ratio"), F.max("gradient").alias("gradient"))


@query
def q_layer_compare(spark, sf_dir):
    c = M.layer_compare(_steps(spark, sf_dir))
    return c.select("label", "steps", F.round("first", 4).alias("first"), F.round("last", 4).alias("last"), (F.round("change", 4) + 0.0).alias("change"))


@query
def q_layer_warnings(spark, sf_dir):
    return M.layer_warnings(_steps(spark, sf_dir), share=0.1).withColumn("value", F.round("value", 6))


@query
def q_heatmap(spark, sf_dir):
    p = _steps(spark, sf_dir).groupBy("label").pivot("step", list(range(7))).agg(F.max("movement"))
    return p.select("label", *(F.round(str(k), 6).alias(f"step_{k}") for k in range(7)))


@query
def q_module_metadata(spark, sf_dir):
    parts = ["self_attn.q_proj.weight", "mlp.down_proj.lora_A.default.weight", "input_norm.weight", "mlp.fc1.bias"]
    suffix = F.element_at(F.array(*(F.lit(p) for p in parts)), (F.col("vec_id") % 4 + 1).cast("int"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("model.layers."), F.col("label"), F.lit("."), suffix).alias("name"))
    return e.select("vec_id", "name", *M.module_metadata("name"), M.matches_pattern(F.lit("layers.1"), F.col("name")).alias("in_layer_1"))


@query
def q_lora_delta_norm(spark, sf_dir):
    """Pairs of neighbouring vectors as 8 x 8 matrices A and B."""
    e = table(spark, sf_dir, "embeddings")
    side = F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B")
    name = F.concat(F.lit("layers."), F.floor(F.col("vec_id") / 2).cast("string"), F.lit(".q_proj.lora_"), side, F.lit(".weight"))
    t = e.select(name.alias("name"), F.lit(8).alias("rows"), F.lit(8).alias("cols"), F.col("embedding").alias("values"), F.lit(2.0).alias("scaling"))
    return M.lora_delta_norm(M.lora_pairs(t)).withColumn("norm", F.round("norm", 5))


@query
def q_reference_rows(spark, sf_dir):
    """Vectors against a first state that is rotated by one place, scaled, of zeros, or missing."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").alias("values"))
    turned = F.concat(F.slice("values", 2, 100_000), F.slice("values", 1, 1))
    times = lambda k: F.transform("values", lambda x: x * k)
    first = e.where("name % 5 > 0").select("name", F.when(F.col("name") % 5 == 1, turned).when(F.col("name") % 5 == 2, times(F.lit(0.5))).when(F.col("name") % 5 == 3, times(F.lit(0.0))).otherwise(F.col("values")).alias("values"))
    return M.reference_rows(e, first).select("name", *(F.round(c, 4).alias(c) for c in ("weight_norm", "reference_norm", "update_norm", "ratio")))


@query
def q_point_scores(spark, sf_dir):
    p = _points(spark, sf_dir).select(RUN, "step", "domain_gain", "general_loss", "reference", (F.col("step") % 5 / 50.0 - 0.04).alias("qa_delta"))
    x = M.scored(p)
    return x.select(RUN, "step", "interpretation", *(F.round(c, 4).alias(c) for c in ("forgetting_score", "overfitting_score", "recommendation_score")))


@query
def q_earliest_alert(spark, sf_dir):
    return M.earliest_alerts(M.alerts(_scored_points(spark, sf_dir), RUN), RUN)


def _qa_delta(spark, sf_dir, samples):
    """The mean of the deltas of the question-answering metrics, and the largest of their floors."""
    qa = F.col("metric").isin("domain_recall.token_f1", "domain_application.token_f1")
    d = _deltas(spark, sf_dir).where(qa).agg(F.avg("delta").alias("delta"))
    f = _floors(spark, sf_dir, samples).where(qa).agg(F.greatest(F.coalesce(F.max("floor"), F.lit(0.0)), F.lit(0.02)).alias("floor"))
    return d.join(F.broadcast(f), F.lit(True)).select(F.round("delta", 6).alias("delta"), F.round("floor", 6).alias("floor"))


@query
def q_qa_delta(spark, sf_dir):
    return _qa_delta(spark, sf_dir, BOOTSTRAPS)


@query
def q_qa_delta_200(spark, sf_dir):
    return _qa_delta(spark, sf_dir, REFERENCE_BOOTSTRAPS)


@query
def q_names(spark, sf_dir):
    """Names as they come, with other signs around them, over forty characters, and of signs only."""
    m = _metrics(spark, sf_dir).select("stage", "name").distinct()
    m = m.select("stage", "name", F.explode(F.array(F.concat_ws(" / ", "stage", F.upper("name")), F.concat(F.lit("__Étage."), "stage", F.lit("-"), "name", F.lit(" (mean)_")), F.repeat("name", 3), F.lit(" !/ "))).alias("text"))
    return m.select("stage", "name", "text", M.slug(F.col("text")).alias("slug"), M.metric_label(F.col("text")).alias("label"))


@query
def q_realized_tokens(spark, sf_dir):
    r = _run_table(spark, sf_dir).where("steps is not null")
    x = M.realized(r.select("run", "steps", F.lit(1024).alias("length"), F.lit(2).alias("batch"), F.lit(4).alias("accumulation"), (F.col("steps") * 1.5).alias("seconds"), F.lit(2.0).alias("rate")))
    return x.withColumn("cost", F.round("cost", 6))


@query
def q_mini_eval(spark, sf_dir):
    x = M.mini_eval(_results(spark, sf_dir))
    return x.select("suite", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"))


@query
def q_surface_examples(spark, sf_dir):
    """The first eight examples of the surface kind in order of their id, as a training loop looks at them."""
    return _examples(spark, sf_dir).where(F.col("kind").isin("surface", "general")).orderBy("example_id").limit(8).select("example_id", "hash")


# --- funnel ----------------------------------------------------------------------------------


@query
def q_funnel(spark, sf_dir):
    """Documents that remain after each preparation stage."""
    raw = docs(spark, sf_dir)
    cleaned = keep(C.clean(raw, SQL_CLEAN).select("doc_id", "clean_text", "reasons"))
    good = cleaned.where(F.size("reasons") == 0).select("doc_id", F.col("clean_text").alias("text"))
    decided = keep(D.decide(good, threshold=NEAR))
    left = decided.where("status = 'kept'").select("doc_id")
    rest = cleaned.join(left, "doc_id", "left_semi").select("doc_id", "clean_text")
    clear = K.status(rest, K.flags(rest, _examples(spark, sf_dir)))
    runs = _runs(spark, sf_dir).join(clear.select("doc_id"), "doc_id", "left_semi")
    stages = [("1 ingest", raw), ("2 text", cleaned), ("3 clean", good), ("4 dedup", left), ("5 contamination", clear), ("6 tokenize", runs)]
    out = None
    for name, df in stages:
        one = df.agg(F.count("*").alias("documents")).select(F.lit(name).alias("stage"), "documents")
        out = one if out is None else out.unionByName(one)
    return out
