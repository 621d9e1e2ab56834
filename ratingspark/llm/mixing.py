"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table gives each document a posterior over domains, so a
document belongs to several domains in parts. Rates r >= 0 are then fitted for which
the expected tokens of each domain, sum of r * tokens * posterior, meet the targets:
weighted least squares by projected gradient steps. Steps add up in one number for each domain and
are projected lazily, r = base * max(0, 1 - step of the source - posterior . steps);
where the targets can be met, these are the rates nearest to their base that meet them.

``op2_mixing`` and the pipeline mix two things at once. Sources are the values of the column ``source``,
which is given for each document, so that membership is whole; their target weights are the parameter
``weights``, by default the same for each source. The soft domains are languages (``lang`` of the rows that
``labels`` covers), with smoothed totals as targets. ``fit_sources`` meets both sets of totals,
and rates may fall below one. Sources may be as many as hosts: their rates are a stored table that is joined
to the documents; the driver holds sums by domain only.

The classifier is Bernoulli naive Bayes over words that a document holds or not. Its
``features`` words are those whose share of documents differs most between domains in
at most ``max_rows`` labelled rows (those of smallest hash). Posteriors, totals and rates
cover all documents and whole texts.

Only DataFrame expressions are used: there is one scan for the posteriors, whose small
rows are written once, and no shuffle of documents. Null and empty texts have no
tokens and the prior as posterior. Null domains are not learned. Without labelled rows
there are no domains and all rates are 1. Copies are drawn by id and text, so that rows of a null or
repeated id are drawn apart; rows equal in both get the same number.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.llm.common import SPACE, discard, documents, let, store

#: Expected domain totals count as met when all are within this share of their targets.
TOLERANCE = 1e-6


@dataclass(frozen=True)
class DomainModel:
    """Names of the domains, feature words, and for each domain a bias and a weight for each word."""

    names: list[str]
    words: list[str]
    bias: list[float]
    weights: list[list[float]]


def split_words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), SPACE + "+")


def fit_domains(docs: DataFrame, labelled: DataFrame, max_rows: int = 20_000, features: int = 192) -> DomainModel:
    """Fit on the rows of ``docs`` (doc_id, text) that ``labelled`` (doc_id, domain) gives a domain.

    An id with several domains counts for each.
    """
    known = labelled.filter("doc_id is not null and domain is not null").select("doc_id", F.col("domain").cast("string")) \
        .distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("domain", "text").persist()
    totals = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    names = sorted(totals)
    if not names:
        sample.unpersist()
        return DomainModel([], [], [], [])
    held = sample.select("domain", F.explode(F.array_distinct(split_words(F.col("text")))).alias("word")).filter("word <> ''")
    counts = held.groupBy("word").agg(*(F.count(F.when(F.col("domain") == name, 1)).alias(f"n{i}") for i, name in enumerate(names)))
    shares = [(F.col(f"n{i}") + 0.5) / (totals[name] + 1.0) for i, name in enumerate(names)]
    differ = F.greatest(*shares) - F.least(*shares) if len(names) > 1 else shares[0]
    chosen = counts.orderBy(differ.desc(), "word").limit(features).collect()
    sample.unpersist()
    n = sum(totals.values())
    bias, weights = [], []
    for i, name in enumerate(names):
        share = [(r[f"n{i}"] + 0.5) / (totals[name] + 1.0) for r in chosen]
        bias.append(math.log(totals[name] / n) + sum(math.log(1 - s) for s in share))
        weights.append([math.log(s / (1 - s)) for s in share])
    return DomainModel(names, [r["word"] for r in chosen], bias, weights)


def _numbers(values: list[float]) -> Column:
    return F.lit([float(v) for v in values]) if values else F.array().cast("array<double>")


def _weigh(places: Column, bias: float, weights: Column) -> Column:
    return F.aggregate(places, F.lit(bias), lambda total, i: total + F.element_at(weights, i))


def posteriors(docs: DataFrame, model: DomainModel, text: str = "text", temperature: float = 10.0) -> DataFrame:
    """Add ``n_tokens`` and ``posterior`` (in the order of ``model.names``) to ``docs``.

    Words of a text are not independent, so log odds are divided by ``temperature``.
    """
    words = F.lit(model.words) if model.words else F.array().cast("array<string>")

    def soft(logits: Column) -> Column:
        raised = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / temperature))
        return let(raised, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))

    def judge(found: Column) -> Column:
        places = F.transform(F.array_intersect(found, words), lambda w: F.array_position(words, w).cast("int"))
        logits = let(places, lambda at: F.array(*(
            _weigh(at, b, _numbers(w)) for b, w in zip(model.bias, model.weights)))) if model.names else None
        return F.struct(
            (F.size(found) - F.size(F.filter(found, lambda w: w == ""))).cast("long").alias("n_tokens"),
            (let(logits, soft) if model.names else F.array().cast("array<double>")).alias("posterior"))

    return docs.withColumn("_mixing", let(split_words(F.col(text)), judge)) \
        .select(*[F.col(c) for c in docs.columns], "_mixing.n_tokens", "_mixing.posterior")


def smoothed_targets(totals: list[float], power: float = 0.7) -> list[float]:
    """Targets with shares proportional to the totals raised to ``power``, scaled so that none shrinks."""
    weight = [t ** power if t > 0 else 0.0 for t in totals]
    scale = max((t / w for t, w in zip(totals, weight) if w), default=0.0)
    return [w * scale for w in weight]


def copies(rate_column: Column, *keys: Column) -> Column:
    """A whole number of copies whose mean over documents is the rate; a hash of ``keys`` (id and text) decides."""
    draw = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate_column) + (draw < rate_column - F.floor(rate_column)).cast("int")).cast("int")


def labelled_domains(spark: SparkSession, docs: DataFrame, sf_dir: str, domain: str = "lang") -> DataFrame:
    """(doc_id, domain) of the documents that the table ``labels`` covers."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    return docs.select("doc_id", F.col(domain).alias("domain")).join(labels, "doc_id", "left_semi")


@dataclass(frozen=True)
class SourceMixture:
    """Rates over sources and soft domains: base * max(0, 1 - step - posterior . steps).

    ``rates`` has a row for each source: its ``key``, ``source``, ``tokens``, ``target``, ``base``, ``step`` and the
    total ``now`` that the rates give it; ``steps``, ``targets`` and ``totals`` are those of the domains.
    """

    rates: DataFrame
    steps: list[float]
    targets: list[float]
    totals: list[float]
    rounds: int
    off_target: float
    met: bool


def source_key(source: Column) -> Column:
    """A text for each source; rows without one are a source of their own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def source_rate(posterior: Column, steps: list[float]) -> Column:
    """The rate of a row that is joined to its source's ``base`` and ``step``."""
    moved = F.aggregate(F.zip_with(posterior, _numbers(steps), lambda p, s: p * s), F.col("step"), lambda a, b: a + b)
    return F.col("base") * F.greatest(F.lit(0.0), F.lit(1.0) - moved)


def _place_sources(members: DataFrame, n_domains: int, weights: dict[str, float] | None, power: float,
                   targets: list[float] | None) -> tuple[DataFrame, list[float]]:
    """The stored table of sources with targets and first rates, and the targets of the domains.

    A source's share is in proportion to ``weights`` (None: the same for each that holds tokens). Rows without a source,
    and sources without a weight, keep their share of the tokens.
    """
    if any(not (w >= 0 and math.isfinite(w)) for w in (weights or {}).values()):
        raise ValueError("weights of sources are finite and not negative")
    p = [F.col("posterior")[i] for i in range(n_domains)]
    found = members.groupBy(source_key(F.col("source")).alias("key")).agg(
        F.first(F.col("source").cast("string")).alias("source"), F.sum("n_tokens").cast("double").alias("tokens"),
        *(F.sum(F.col("n_tokens") * x).alias(f"n{i}") for i, x in enumerate(p)))
    if weights is None:
        given = found.withColumn("weight", F.when((F.col("key") != "") & (F.col("tokens") > 0), 1.0))
    else:
        asked = members.sparkSession.createDataFrame([("=" + name, name, float(w)) for name, w in weights.items()], "key string, name string, weight double")
        given = found.join(asked, "key", "full").withColumn("source", F.coalesce("source", "name")).drop("name")
    given = store(given.fillna(0.0, ["tokens", *(f"n{i}" for i in range(n_domains))]))
    sums = given.agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("asked"), F.sum(F.when(F.col("weight").isNull(), F.col("tokens"))).alias("kept"),
                     *(F.sum(f"n{i}").alias(f"n{i}") for i in range(n_domains))).first()
    tokens, asked, kept = (float(sums[c] or 0.0) for c in ("tokens", "asked", "kept"))
    targets = smoothed_targets([float(sums[f"n{i}"] or 0.0) for i in range(n_domains)], power) if targets is None else [float(t) for t in targets]
    volume = sum(targets) if n_domains else tokens
    free = 1.0 - (kept / tokens if tokens else 0.0)
    share = F.when(F.col("weight").isNull(), F.col("tokens") / (tokens or 1.0)).otherwise(F.col("weight") * (free / asked if asked else 0.0))
    placed = given.withColumn("target", share * volume).select(
        "key", "source", "weight", "tokens", "target", F.when(F.col("tokens") > 0, F.col("target") / F.col("tokens")).otherwise(1.0).alias("base"))
    return placed, targets


def fit_sources(members: DataFrame, n_domains: int, weights: dict[str, float] | None = None, power: float = 0.7,
                targets: list[float] | None = None, max_rounds: int = 100, patience: int = 12) -> SourceMixture:
    """Rates by which sources meet ``weights`` and soft domains their targets (tokens; None: smoothed totals) at once.

    ``members`` (n_tokens, posterior, source; stored). A rate starts as what its source needs. Each round is one
    aggregation of totals by source, joined to the table of sources, and one over that table; then all steps move along the gradient of the least
    squares at once. Each row belongs to one source and, in parts, to the domains, so that half the inverse of the first
    totals bounds the curvature. Momentum is dropped whenever it points against the gradient.
    Targets that cannot be met together show in gaps that no longer shrink: after ``patience`` rounds without a gain of
    a hundredth the fit ends. Sources of ``weights`` that hold no tokens cannot be met and count for ``met``.
    """
    d = n_domains
    placed, targets = _place_sources(members, d, weights, power, targets)
    rows = members.select(source_key(F.col("source")).alias("key"), "n_tokens", "posterior")
    state = placed.withColumn("step", F.lit(0.0)).withColumn("last", F.lit(0.0)).withColumn("now", F.lit(0.0))
    steps, last, first, pace = np.zeros(d), np.zeros(d), None, 1.0
    want, stored, best, best_round = np.array(targets), None, math.inf, 0
    for n in range(max_rounds + 1):
        now = F.col("n_tokens") * source_rate(F.col("posterior"), steps.tolist())
        sums = rows.join(state.select("key", "base", "step"), "key").select("key", now.alias("now"), "posterior") \
            .groupBy("key").agg(F.sum("now").alias("now"), *(F.sum(F.col("now") * F.col("posterior")[i]).alias(f"n{i}") for i in range(d)))
        measured = store(state.drop("now", *(f"n{i}" for i in range(d))).join(sums, "key", "left").fillna(0.0, ["now"]))
        if stored is not None:
            discard(stored)
        stored = measured
        gap = F.col("now") - F.col("target")
        totals = measured.agg(
            F.max(F.abs(gap) / F.greatest("target", F.lit(1.0))).alias("off"), F.sum(gap * (F.col("step") - F.col("last"))).alias("against"),
            F.max((F.col("weight") > 0) & (F.col("tokens") == 0)).alias("absent"), *(F.sum(f"n{i}").alias(f"n{i}") for i in range(d))).first()
        total = np.array([totals[f"n{i}"] or 0.0 for i in range(d)])
        first = np.maximum(total, 1.0) if first is None else first
        off = max([totals["off"] or 0.0, *(np.abs(total - want) / np.maximum(want, 1.0))])
        if off < 0.99 * best:
            best, best_round = off, n
        if off <= TOLERANCE or n == max_rounds or n - best_round >= patience:
            break
        if (totals["against"] or 0.0) + (total - want) @ (steps - last) < 0:
            pace = 1.0
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        push, pace = (pace - 1) / faster, faster
        # The point without momentum is kept as well: the next momentum starts from it.
        plain = F.col("step") + gap / (2 * F.greatest("target", F.lit(1.0)))
        state = measured.withColumn("plain", plain).withColumn("step", F.col("plain") + push * (F.col("plain") - F.col("last"))) \
            .withColumn("last", F.col("plain")).drop("plain")
        moved = steps + (total - want) / (2 * first)
        steps, last = moved + push * (moved - last), moved
    off = max(off, 1.0) if totals["absent"] else float(off)
    return SourceMixture(measured, steps.tolist(), targets, total.tolist(), n, float(off), bool(off <= TOLERANCE))


def op2_mixing(spark: SparkSession, sf_dir: str, weights: dict[str, float] | None = None) -> DataFrame:
    """``weights`` are target weights of the values of ``source``; None gives each source the same."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    model = fit_domains(docs, labelled_domains(spark, docs, sf_dir))
    members = store(posteriors(docs, model).select("doc_id", "source", "n_tokens", "posterior", F.xxhash64("text").alias("text_hash")))
    mix = fit_sources(members, len(model.names), weights)
    names = F.lit(model.names) if model.names else F.array().cast("array<string>")
    r = source_rate(F.col("posterior"), mix.steps)
    return members.withColumn("key", source_key(F.col("source"))).join(mix.rates.select("key", "base", "step", "target", "now"), "key").select(
        "doc_id", "source", "n_tokens", F.get(names, (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int")).alias("domain"),
        "posterior", r.alias("rate"), copies(r, F.col("doc_id"), F.col("text_hash")).alias("copies"),
        F.col("target").alias("source_target"), F.col("now").alias("source_total"),
        F.lit(mix.off_target).alias("off_target"), F.lit(mix.met).alias("targets_met"))


def mix_rows(docs: DataFrame, model: DomainModel, weights: dict[str, float] | None = None, power: float = 0.7) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, source and others) as often as the rates of ``fit_sources`` say, some not at all.

    Texts without tokens bear on no target and stay once. Missed targets are warned of, with the largest gap.
    """
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text", "doc_id", F.col("source").cast("string").alias("source"))
    members = store(posteriors(packed.select("text", "source"), model).select("n_tokens", "posterior", "source"))
    mix = fit_sources(members, len(model.names), weights, power)
    if not mix.met:
        warnings.warn(f"target weights not met: off by {mix.off_target:.3g} of a target after {mix.rounds} rounds", stacklevel=2)
    n = F.when(F.col("n_tokens") == 0, 1).otherwise(copies(source_rate(F.col("posterior"), mix.steps), F.col("doc_id"), F.xxhash64("text")))
    rated = posteriors(packed, model).withColumn("key", source_key(F.col("source"))).join(mix.rates.select("key", "base", "step"), "key")
    return rated.select("row", n.alias("_n")).filter("_n > 0") \
        .select("row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("row.*")
