"""Problem 9: documents of several sources, combined to target shares of tokens.

Every document belongs softly to the target sources, by the posterior of a classifier fitted on
labelled rows, of which its own label is the prior.  Nonnegative rates (how often a document is
used) are fitted by projected gradient so that the expected tokens of each domain meet its target in
least squares; rates are bounded by the repeats that are allowed.  The gradient is kept in its lazy
form: one number a source determines the rate of every document, so an iteration is one distributed
sum that returns a row of numbers.  As the targets are stated on labels, the rates of each label are
scaled until its tokens meet the target too.  Rates are made whole by hash order, to within one
document.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from .bpe import TOKENIZERS, encoder
from .common import Durable, arrow_map, bounded_sample, words

#: Labelled rows that the classifier is fitted on, at most, taken by hash order; hashed features.
SAMPLE_ROWS = 20_000
FEATURES = 1 << 12
ITERATIONS = 20
#: Relative error of the shares at which the fit ends.
TOLERANCE = 1e-4
#: Hash parts of a level, of which there are two: the whole documents that a source's fractions give
#: are counted by part, then within the part at the boundary, and only a part of that is sorted.
BITS = 9
#: How much a document's label says of its membership; the rest is the classifier's.
LABEL = 0.9


class _Features(dict):
    """Hashed feature by word, bounded."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1 << 20:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) % FEATURES
        return got


_FEATURE = _Features()


def features(text: str | None) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(_FEATURE.__getitem__, w), np.int64, len(w))


def posterior(model: np.ndarray, text: str | None) -> np.ndarray:
    """Of each source, by the classifier."""
    score = model[:, FEATURES] + model[:, features(text)].sum(axis=1)
    score = np.exp(score - score.max())
    return score / score.sum()


def fit_classifier(labelled: DataFrame, sources: list[str], rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Log likelihoods (source, feature) of a multinomial naive Bayes model, the prior in a last column.

    ``labelled`` has doc_id, source and text.
    """
    sample = bounded_sample(labelled, "doc_id", rows)
    at = {s: k for k, s in enumerate(sources)}

    def each(batch):
        m = np.zeros((len(sources), FEATURES + 1))
        for s, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if s in at:
                m[at[s], FEATURES] += 1
                np.add.at(m[at[s]], features(text), 1.0)
        cells = np.flatnonzero(m)
        return {"cell": cells, "n": m.ravel()[cells]}

    total = np.zeros((len(sources), FEATURES + 1))
    # One number a cell, whatever the number of tasks.
    for r in arrow_map(sample.select("source", "text"), each, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total.ravel()[r.cell] = r.n
    total[:, :FEATURES] = np.log(total[:, :FEATURES] + 0.5) - np.log((total[:, :FEATURES] + 0.5).sum(axis=1, keepdims=True))
    prior = total[:, FEATURES] + 1
    total[:, FEATURES] = np.log(prior / prior.sum())
    return total


def held_out(docs: DataFrame, sources: list[str], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(source, docs, right): how the classifier, fitted on four fifths of the labelled rows, places the others."""
    labelled = docs.where(F.col("source").isin(sources) & (F.length("text") > 0)).select("doc_id", "source", "text")
    other = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(5)) == 0
    model = docs.sparkSession.sparkContext.broadcast(fit_classifier(labelled.where(~other), sources, sample_rows))

    def each(batch):
        best = [sources[int(posterior(model.value, text).argmax())] for text in batch.column(1).to_pylist()]
        return {"source": batch.column(0), "best": best}

    placed = arrow_map(labelled.where(other).select("source", "text"), each, "source string, best string")
    return placed.groupBy("source").agg(F.count("*").alias("docs"), F.sum((F.col("best") == F.col("source")).cast("long")).alias("right"))


def memberships(docs: DataFrame, sources: list[str], path: str, sample_rows: int = SAMPLE_ROWS, label: float = LABEL) -> tuple[DataFrame, int]:
    """(doc_id, source, tokens, at, p) of the documents that can take part, and the tokens of all documents.

    ``p`` is the membership in each source: of a labelled document ``label`` of its own source and
    the rest by the classifier; one without a label has the posterior alone.  ``at`` is the place of
    its label, else of the likeliest source.  A document of a source that is no target takes no
    part, nor does one without tokens, such as null and empty texts.
    """
    spark = docs.sparkSession
    named = docs.where("doc_id is not null").select("doc_id", F.when(F.trim("source") == "", None).otherwise(F.col("source")).alias("source"), "text")
    model = spark.sparkContext.broadcast(fit_classifier(named.where(F.col("source").isin(sources)), sources, sample_rows))
    at = {s: k for k, s in enumerate(sources)}

    def each(batch):
        e, m = encoder(path), model.value
        ids, source, tokens, where, p = [], [], [], [], []
        for i, s, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            n = e.count(text)
            post = None
            if n and sources and (s in at or s is None):
                post = posterior(m, text)
                if s in at:
                    post *= 1 - label
                    post[at[s]] += label
            ids.append(i), source.append(s), tokens.append(n), p.append(post)
            where.append(None if post is None else at[s] if s in at else int(post.argmax()))
        return {"doc_id": ids, "source": source, "tokens": tokens, "at": where, "p": p}

    work = Durable(spark)
    counted = work.keep(arrow_map(named, each, "doc_id long, source string, tokens long, at int, p array<double>"), "memberships")
    total = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    return counted.where(F.col("p").isNotNull()), total


def _sums(members: DataFrame, lam: np.ndarray, caps: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected tokens by domain, their change by each multiplier, and by label the tokens used and there are.

    One pass over the memberships, of which a batch returns k * (k + 3) numbers.
    """
    k = len(lam)

    def each(batch):
        at, tokens = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(float)
        p = batch.column(2).flatten().to_numpy().reshape(-1, k)
        rate = (p @ lam) * scale[at]
        free = (rate > 0) & (rate < caps[at])
        rate = np.clip(rate, 0.0, caps[at])
        moved = (p * (tokens * scale[at] * free)[:, None]).T @ p
        got = np.concatenate([(tokens * rate) @ p, moved.ravel(), np.bincount(at, tokens * rate, k), np.bincount(at, tokens, k)])
        return {"cell": np.arange(len(got)), "n": got}

    total = np.zeros(k * (k + 3))
    for r in arrow_map(members.select("at", "tokens", "p"), each, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[r["cell"]] = r["n"]
    return total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k : 2 * k + k * k], total[2 * k + k * k :]


def fit_rates(members: DataFrame, targets: np.ndarray, caps: np.ndarray, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> np.ndarray:
    """One multiplier a source; a document's rate is its expected multiplier, between 0 and the cap of its label.

    Projected gradient on the squared error of the expected tokens, each step scaled by the
    curvature, which one pass returns beside the gradient: some steps do, however the domains
    overlap.  A step that does not lower the error is halved.
    """
    k = len(targets)
    lam, least, step = np.minimum(1.0, caps), np.inf, np.zeros(k)
    size = max(float(targets.sum()), 1.0)
    for _ in range(iterations if k else 0):
        e, moved, _, _ = _sums(members, lam, caps, np.ones(k))
        error = float(((targets - e) ** 2).sum())
        if error > least * (1 + 1e-12):
            step = step / 2
            lam = lam - step
            if np.abs(step).max() <= tolerance:
                return lam
            continue
        least = error
        gradient = moved.T @ (targets - e)
        curvature = moved.T @ moved
        step = np.linalg.solve(curvature + np.eye(k) * max(1e-6 * np.trace(curvature) / k, 1e-9), gradient)
        new = np.clip(lam + step, 0.0, caps.max())
        step, lam = new - lam, new
        if np.abs(step).max() <= tolerance or least <= (tolerance * size) ** 2:
            return lam
    return lam


def _at(values: np.ndarray):
    """The value at the row's ``at``."""
    return F.get(F.array(*(F.lit(float(v)) for v in values)), F.col("at")) if len(values) else F.lit(0.0)


def rates(lam: np.ndarray, caps: np.ndarray, scale: np.ndarray):
    """The rate of a document: its expected multiplier, scaled by its label, between 0 and its label's cap."""
    expected = sum((F.col("p")[k] * float(v) for k, v in enumerate(lam)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(expected * _at(scale), _at(caps)))


def fit_labels(members: DataFrame, lam: np.ndarray, targets: np.ndarray, caps: np.ndarray, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> np.ndarray:
    """One factor a label, by which its tokens meet the target as far as its cap allows."""
    k = len(targets)
    scale = np.ones(k)
    for _ in range(iterations if k else 0):
        _, _, e, h = _sums(members, lam, caps, scale)
        wanted = np.minimum(targets, h * caps)
        if np.all(np.abs(e - wanted) <= tolerance * np.maximum(wanted, 1.0)):
            break
        scale = np.where(e > 0, scale * np.clip(wanted / np.maximum(e, 1e-9), 0.0, 1e3), scale)
    return scale


def whole(placed: DataFrame) -> DataFrame:
    """``placed`` (doc_id, at, tokens, rate, cap, ...) with ``repeats``: rates made whole.

    Of each source, the fractions of rates add up to tokens that whole documents give in the order
    of a hash, to within one document.  The order is cut by two levels of parts; a level sends one
    row a part and source, 2 ** BITS times the sources at most.
    """
    u = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30))
    frac = F.col("rate") - F.floor("rate")
    rows = placed.withColumns({"u": u, "frac": frac, "gives": F.when(frac > 0, F.col("tokens")).otherwise(0)})
    need = rows.groupBy("at").agg(F.sum(F.col("tokens") * F.col("frac")).alias("need"))
    left = rows.join(F.broadcast(need), "at").withColumn("base", F.lit(0.0))
    done = []
    for level in (1, 2):
        left = left.withColumn("part", F.shiftright("u", 30 - BITS * level))
        order = W.partitionBy("at").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        sums = left.groupBy("at", "part").agg(F.sum("gives").alias("n"), F.first("base").alias("from"))
        sums = sums.select("at", "part", "n", (F.col("from") + F.coalesce(F.sum("n").over(order), F.lit(0))).alias("before"))
        met = left.join(F.broadcast(sums), ["at", "part"])
        inside = (F.col("before") + F.col("n") > F.col("need")) & (F.col("before") < F.col("need"))
        done.append(met.where(~inside).withColumn("more", (F.col("before") < F.col("need")) & (F.col("gives") > 0)).select(*placed.columns, "more"))
        left = met.where(inside).withColumn("base", F.col("before")).drop("part", "n", "before")
    order = W.partitionBy("at").orderBy("u", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("base") + F.sum("gives").over(order) - F.col("tokens") / 2
    done.append(left.withColumn("more", (upto <= F.col("need")) & (F.col("gives") > 0)).select(*placed.columns, "more"))
    every = done[0].unionByName(done[1]).unionByName(done[2])
    return every.withColumn("repeats", F.least(F.floor("rate") + F.col("more").cast("int"), F.col("cap")).cast("int")).drop("more")


def mix(
    docs: DataFrame, targets: DataFrame, total: int | None = None, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", sample_rows: int = SAMPLE_ROWS, label: float = LABEL
) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, tokens, repeats) and the shares by source.

    ``targets`` has source, target_share and max_repeats; its size is that of a list of sources.
    The size of the mixture is ``total`` tokens, by default all tokens of ``docs``.  Sources whose
    documents do not suffice at ``max_repeats`` give all they have; the shortfall is reported and not
    made up by others.  A document is never used more than its source's ``max_repeats`` times.
    ``source`` in the result is the likeliest target of a document without a label; ``soft_share``
    are the tokens of the mixture by membership instead of label.
    """
    spark = docs.sparkSession
    rows = sorted((r.source, float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.toLocalIterator() if r.source is not None)
    sources = [r[0] for r in rows]
    share, caps = np.array([r[1] for r in rows]), np.array([float(r[2]) for r in rows])
    members, all_tokens = memberships(docs, sources, path, sample_rows, label)
    size = all_tokens if total is None else total
    lam = fit_rates(members, share * size, caps)
    scale = fit_labels(members, lam, share * size, caps)
    placed = members.select("doc_id", "tokens", "at", "p", rates(lam, caps, scale).alias("rate"), _at(caps).alias("cap"))
    names = F.array(*(F.lit(s) for s in sources)) if sources else F.array(F.lit(None).cast("string"))
    used = whole(placed).where("repeats > 0").select("doc_id", F.get(names, F.col("at")).alias("source"), "tokens", "repeats", "p")
    used = Durable(spark).keep(used, "mixture")
    tokens = F.col("tokens") * F.col("repeats")
    soft = used.agg(*(F.coalesce(F.sum(tokens * F.col("p")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(len(sources)))).first() if sources else []
    by_label = used.groupBy("source").agg(F.count("*").alias("docs_used"), F.sum(tokens).alias("tokens_used"), F.max("repeats").alias("most_repeats"))
    have = members.groupBy(F.get(names, F.col("at")).alias("source")).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    listed = spark.createDataFrame([(*r, float(soft[k])) for k, r in enumerate(rows)], "source string, target_share double, max_repeats int, soft_tokens double")
    report = listed.join(F.broadcast(have), "source", "left").join(F.broadcast(by_label), "source", "left").na.fill(0)
    out = report.withColumn("target_tokens", F.col("target_share") * float(size)).withColumn("actual_share", F.col("tokens_used") / float(max(size, 1)))
    everything = W.partitionBy()
    out = out.withColumn("share_of_mixture", F.try_divide(F.col("tokens_used"), F.sum("tokens_used").over(everything)))
    return used.drop("p"), out.withColumn("soft_share", F.try_divide(F.col("soft_tokens"), F.sum("soft_tokens").over(everything))).drop("soft_tokens")
