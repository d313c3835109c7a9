"""Deduplication, contamination, tokens, metrics: fixtures, invariants, repartitioning."""

import random
from datetime import datetime

import pytest

from pyspark.sql import functions as F

from corpusmill.operators import contamination as K, corpus, dedup as D, evaluation as E, metrics as M, tokens as N



def test_first_seen_wins_not_components(spark):
    """a~b, b~c, a not~c keeps a and c."""
    w = [f"w{k}" for k in range(90)]
    a, b, c = " ".join(w[:60]), " ".join(w[12:72]), " ".join(w[24:84])
    d = spark.createDataFrame([(1, a), (2, b), (3, c), (4, a), (5, a.upper()), (6, "")], "doc_id long, text string")
    s = {r.doc_id: r.sig for r in D.signatures(d, shingle=5).collect()}
    sim = lambda x, y: sum(p == q for p, q in zip(s[x], s[y])) / D.PERMS
    threshold = max(sim(1, 3) + 0.01, min(sim(1, 2), sim(2, 3)) - 0.001)
    got = {r.doc_id: (r.status, r.match_id) for r in D.decide(d, threshold=threshold).collect()}
    if min(sim(1, 2), sim(2, 3)) >= threshold:
        assert got[2][0] == "near_duplicate" and got[3][0] == "kept"
    assert got[1] == ("kept", None) and got[4] == ("exact_duplicate", 1) and got[5] == ("normalized_duplicate", 1) and got[6][0] == "kept"


def test_decisions_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(40)) for _ in range(20)]
    texts = [t if rng.random() < 0.5 else t + " tail" for t in base * 3]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = [{(r.doc_id, r.status) for r in D.decide(d.repartition(n), threshold=0.6).collect()} for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == len(texts)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, clean_text string")


def test_contamination(spark):
    item = " ".join(f"t{k}" for k in range(20))
    ex = K.examples(
        spark.createDataFrame([("s1", item), ("s2", ""), ("s3", None)], "id string, text string"),
        spark.createDataFrame([("a1", "alpha beta gamma delta", "")], "id string, question string, answer string"),
        spark.createDataFrame([("r1", None, "one two")], "id string, prompt string, answer string"),
    )
    assert {r.example_id for r in ex.collect()} == {"domain_surface:s1", "domain_application:a1", "domain_recall:r1"}
    assert K.missing_kinds(ex).count() == 0
    d = docs(spark, [(1, item), (2, "x " + item + " y"), (3, "say alpha beta gamma delta now"), (4, "clean text"), (5, "one two"), (6, None), (7, "")])
    got = {(r.doc_id, r.example_id.split(":")[1], r.match_type) for r in K.flags(d, ex).collect()}
    assert got == {(1, "s1", "exact"), (2, "s1", "ngram"), (3, "a1", "ngram"), (5, "r1", "exact")}
    assert {r.doc_id for r in K.status(d, K.flags(d, ex)).collect()} == {4, 6, 7}
    assert {r.doc_id: r.status for r in K.status(d, K.flags(d, ex), "require_override").collect()}[2] == "contaminated_retained"


RUN = "run_id long, doc_id long, source_role string, source_group string, token_ids array<int>, tokenized_at timestamp"


def runs(spark, lengths, roles=None):
    rows = [(k, k, (roles or ["domain"] * len(lengths))[k - 1], "g", list(range(2, n + 1)) + [1], datetime(2025, 1, 1)) for k, n in enumerate(lengths, 1)]
    return N.latest_runs(spark.createDataFrame(rows, RUN))


def test_golden_split_and_blocks(spark):
    """281 tokens, blocks of 128, a quarter for validation: 2 training blocks and 1."""
    r = runs(spark, [281])
    s = N.split_single(r, 0.25, 128).first()
    assert len(s.train_ids) == 153 and len(s.validation_ids) == 128 and list(s.train_ids) + list(s.validation_ids) == list(r.first().token_ids)
    assert -(-153 // 128) == 2


@pytest.mark.parametrize("drop", [False, True])
def test_packing_equals_concatenation(spark, drop):
    lengths = [5, 1, 17, 8, 3, 30, 2]
    r = runs(spark, lengths)
    flat = [t for row in sorted(r.collect(), key=lambda x: x.doc_id) for t in row.token_ids]
    b = sorted(N.pack(r.repartition(3), 8, drop).collect(), key=lambda x: x.block_id)
    got = [t for x in b for t in x.input_ids[: x.original_length]]
    assert got == (flat[: len(flat) // 8 * 8] if drop else flat)
    assert all(len(x.input_ids) == 8 for x in b) and all(x.padding_length == 0 for x in b[:-1])


def test_split_is_disjoint_and_replay_stops(spark):
    r = runs(spark, [10] * 30)
    s = {x.doc_id: x.split for x in N.split(r, 0.2, 8).collect()}
    assert len(s) == 30 and 1 <= sum(v == "validation" for v in s.values()) < 30
    assert {x.split for x in N.split(r, 0.0, 8).collect()} == {"train"}
    mixed = runs(spark, [10, 6, 6, 6, 1], ["domain"] + ["replay_general"] * 4)
    assert {x.doc_id for x in N.replay_select(mixed, 0.5).collect()} == {1, 2}
    assert {x.doc_id for x in N.replay_select(mixed, 0.0).collect()} == {1}


def test_prefix_sum(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 9)) for k in rng.sample(range(10_000), 500)]
    d = spark.createDataFrame(rows, "k long, v long").repartition(6)
    got = {r.k: r.s for r in N.prefix_sum(d, "v", "k", "s", parts=7).collect()}
    at, want = 0, {}
    for k, v in sorted(rows):
        want[k] = at
        at += v
    assert got == want


def test_evaluation_numbers(spark):
    import math

    rows = spark.createDataFrame([("nll", 1.0, 10), ("nll", 3.0, 30), ("nll", None, 5), ("nll", float("nan"), 5)], "metric_name string, value double, token_count long")
    r = E.weighted_perplexity(rows).first()
    assert r.nll == 2.5 and math.isclose(r.perplexity, math.exp(2.5))
    r = E.weighted_perplexity(rows.limit(0)).first()
    assert (r.nll, r.perplexity) == (0.0, 1.0)
    t = spark.createDataFrame([("",), ("aab",), (None,)], "t string").select(E.byte_entropy(F.col("t")).alias("e")).collect()
    assert t[0].e.perplexity == 1.0 and math.isclose(t[1].e.nll, -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)))
    boot = spark.createDataFrame([("m", 1)], "metric string, n long")
    assert E.alert_policy(boot).first().status == "insufficient_calibration_data" and E.alert_policy(boot, configured=True).first().alerts_allowed
    assert E.alert_policy(boot.limit(0)).first().status == "blocked"


METRIC = "id long, created_at string, stage string, step long, name string, value double, unit string, config_hash string, metadata_json string"


def metric_rows(spark, general):
    return spark.createDataFrame([(k, "t", "s", k, "g", v, None, "r", "{}") for k, v in enumerate(general)], METRIC)


def test_alert_persistence(spark):
    def steps(values):
        p = M.stream_points(metric_rows(spark, values), "config_hash", "d", "g")
        return {r.step for r in M.alerts(p, "config_hash", 2).collect()}

    assert steps([100.0, 105.0, 100.0]) == set()
    assert steps([100.0, 105.0, 105.0]) == {2}


def test_alerts_of_checkpoints_and_recommendation(spark):
    rows = [("r", 1, M.STREAM, 0.5, 3.0, 0.0, 0.1), ("r", 2, M.CHECKPOINT, 0.5, 3.0, 0.0, 0.2), ("r", 3, M.STREAM, 0.5, 6.0, 0.0, 0.9), ("r", 4, M.CHECKPOINT, 0.5, 6.0, 1.0, 0.8), ("r", 5, M.STREAM, 0.5, 6.0, 0.0, 0.9),
            ("s", 1, M.CHECKPOINT, 0.1, 9.0, 0.0, 0.3), ("t", 1, M.STREAM, 0.1, 0.0, 0.0, None), ("t", 2, M.STREAM, 0.1, 0.0, 0.0, -0.5)]
    p = spark.createDataFrame(rows, "run string, step long, source string, domain_gain double, general_loss double, overfitting_score double, recommendation_score double")
    p = p.withColumn("threshold", F.lit(2.0)).withColumn("stop_threshold", F.lit(5.0))
    found = M.alerts(p, "run", 2)
    got = {(r.run, r.step, r.code, r.persistence) for r in found.collect()}
    # The checkpoint between two points of the stream neither adds to their count nor ends it.
    assert got == {("r", 2, "forgetting_warning", 1), ("r", 3, "forgetting_warning", 2), ("r", 4, "forgetting_warning", 1), ("r", 5, "forgetting_warning", 3), ("r", 4, "forgetting_stop", 1), ("r", 5, "forgetting_stop", 2),
                   ("r", 4, "domain_overfitting_warning", None), ("s", 1, "forgetting_warning", 1), ("s", 1, "forgetting_stop", 1)}
    assert {(r.run, r.kind): r.step for r in M.earliest_alerts(found, "run").collect()} == {("r", "forgetting"): 2, ("r", "domain_overfitting"): 4, ("s", "forgetting"): 1}
    best = {r.run: (r.status, r.step, r.score) for r in M.recommend(p, found, "run").collect()}
    assert best == {"r": ("recommended", 2, 0.2), "s": ("no_safe_checkpoint", None, None), "t": ("recommended", 1, None)}


def test_contamination_stage_fails_without_override(spark):
    found = spark.createDataFrame([(1, "e", "exact", 1.0)], "doc_id long, example_id string, match_type string, score double")
    K.enforce(found, "require_override", True), K.enforce(found, "remove"), K.enforce(found.limit(0), "require_override")
    with pytest.raises(ValueError):
        K.enforce(found, "require_override")


def test_early_stop_and_ranking(spark):
    s = spark.createDataFrame([("r", 0, 1.0), ("r", 1, 1.2), ("r", 2, 1.0), ("r", 3, 1.2), ("r", 4, 1.3)], "run string, step long, value double")
    assert M.early_stop(s, "run", patience=2).first().stop_step == 4
    runs_ = spark.createDataFrame([("a", 0.2, None, 5), ("b", 2.0, 1.0, 9), ("c", None, 3.0, 1)], "run string, gain double, retention double, tokens long")
    assert [r.run for r in M.rank(runs_).orderBy("rank").collect()] == ["b", "a", "c"]


def test_counts_and_fingerprint(spark):
    d = spark.createDataFrame([(1, "some text", "s", "u", None, "g", "t", None), (2, None, "s", "u", "x", "g", "t", "l")], "doc_id long, text string, source string, source_uri string, source_role string, source_group string, source_type string, license string")
    rows = {(r.kind, r.value): r.documents for r in corpus.counts(corpus.documents(d)).collect()}
    assert rows == {("total", "*"): 1, ("source_role", "unspecified"): 1, ("license", "unspecified"): 1, ("source_group", "g"): 1}
    assert corpus.fingerprint(d) == corpus.fingerprint(d.repartition(3)) and corpus.fingerprint(d.limit(0)) == (0, 0)


def test_reference_bootstrap_equals_brute_force(spark, tmp_path):
    """The 200 draws of the reference, by the stated hash and indices, in each query that uses them."""
    from hashlib import md5

    from corpusmill.plans.catalogue import QUERIES

    rng = random.Random(8)
    rows = [(f"t{k % 2}", "m", rng.random(), f"t{k % 2}:e{k}", f"2024-01-{k % 28 + 1:02d}", "eval" if k % 3 else "validation") for k in range(60)]
    schema = "task_id string, metric_name string, value double, example_id string, evaluated_at string, split string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/eval_results.parquet")
    want, floors = {}, {}
    for task in ("t0", "t1"):
        mine = sorted(((md5(r[3].encode()).hexdigest()[:2], r[3], r[4], r[2]) for r in rows if r[0] == task))
        v = [r[3] for r in mine]
        n = len(v)
        means = sorted(sum(v[int(md5(f"9186:{task}.m:{b}:{i}".encode()).hexdigest()[:7], 16) % n] for i in range(n)) / n for b in range(200))
        low, high = means[int(0.025 * 199)], means[int(0.975 * 199)]
        mean = sum(v) / n
        se = (sum((x - mean) ** 2 for x in v) / (n - 1) / n) ** 0.5
        want[f"{task}.m"] = (n, pytest.approx(low, abs=2e-6), pytest.approx(high, abs=2e-6))
        floors[f"{task}.m"] = pytest.approx(max(se, (high - low) / 2), abs=2e-6)
    assert {r.metric: (r.n, r.low, r.high) for r in QUERIES["q_bootstrap_ci_200"](spark, str(tmp_path)).collect()} == want
    for name in ("q_noise_floors_200", "q_differential_200"):
        assert {r.metric: r.floor for r in QUERIES[name](spark, str(tmp_path)).collect()} == floors
    assert QUERIES["q_qa_delta_200"](spark, str(tmp_path)).first().floor == 0.02


@pytest.mark.parametrize("name", ["q_bootstrap_ci_200", "q_floor_lookup", "q_differential_200", "q_noise_floors", "q_qa_delta", "q_bootstrap_ci", "q_differential", "q_noise_floors_200", "q_qa_delta_200"])
def test_draws_are_never_broadcast(spark, tmp_path, monkeypatch, name):
    """F1 to F9: by the size of its files the side of the draws, a row a draw, seemed small enough to be sent to every task."""
    from corpusmill.plans import catalogue

    rows = [(f"t{k % 2}", "m", k % 7 / 7, f"e{k}", f"2024-01-{k % 28 + 1:02d}", "eval" if k % 3 else "validation") for k in range(60)]
    schema = "task_id string, metric_name string, value double, example_id string, evaluated_at string, split string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/eval_results.parquet")
    plans = []

    def walk(node, sent):
        kind = node.nodeName()
        if kind.startswith("AdaptiveSparkPlan"):
            return walk(node.initialPlan(), sent)
        sent = kind.startswith("BroadcastExchange") or sent and "Aggregate" not in kind and "InArrow" not in kind
        plans.append((kind, sent))
        for k in range(node.children().size()):
            walk(node.children().apply(k), sent)

    monkeypatch.setattr(catalogue, "keep", lambda df: df)
    walk(catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan(), False)
    assert any(kind == "Generate" for kind, _ in plans) and not [kind for kind, sent in plans if kind == "Generate" and sent]


def test_draws_equal_md5_and_blocks_do_not_matter(spark):
    """Blocks and batches far smaller than a metric, a message over one and two blocks of MD5, and missing keys in the order of SQL."""
    from hashlib import md5

    for prefix in (b"9186:t.m:7:", b"x" * 61, "é:".encode() * 40):
        for first, last in ((0, 1200), (2**32 - 3, 2**32 + 3)):
            assert E.draws(prefix, first, last).tolist() == [int(md5(prefix + str(i).encode()).hexdigest()[:7], 16) for i in range(first, last)]
    rows = [("m" * 70 if k % 4 else "one", k * 1.5, f"e{k % 50}" if k % 9 else None, None if k % 5 == 0 else str(k % 3)) for k in range(200)] + [("single", 4.0, "e", "1"), ("single", float("nan"), "e", "1"), (None, 4.0, "e", "1")]
    d = spark.createDataFrame(rows, "metric string, value double, example_id string, evaluated_at string")
    want = {}
    for metric in ("m" * 70, "one", "single"):
        mine = [r for r in rows if r[0] == metric and r[1] == r[1]]
        v = [r[1] for r in sorted(mine, key=lambda r: (r[2] is None, r[2] and md5(r[2].encode()).hexdigest()[:2], r[2] or "", r[3] is None, r[3] or "", r[1]))]
        n = len(v)
        means = sorted(sum(v[int(md5(f"5:{metric}:{b}:{i}".encode()).hexdigest()[:7], 16) % n] for i in range(n)) / n for b in range(40))
        want[metric] = (n, pytest.approx(means[0]), pytest.approx(means[38]))
    assert {r.metric: (r.n, r.low, r.high) for r in E.bootstrap(d, 40, 5, size=37, values=16).collect()} == want
    assert E.bootstrap(d.limit(0), 40).count() == 0
