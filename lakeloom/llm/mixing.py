"""Mixing to target weights with soft domain membership, in DataFrame functions alone.

A naive Bayes classifier over hashed words, fitted on a labelled table (at most
``max_rows`` labels; counted by the executors), gives every document a
probability for each domain.  A document with n tokens and posterior p adds
r n p to the domains' expected token totals if it is taken at rate r.  The
rates minimise the squared distance of the totals to the targets, with r >= 0:
projected gradient descent from r = 1 with momentum, where each step is one
distributed aggregation of as many numbers as there are domains.  Distances are
measured in the metric of G = sum n p p', for which the step length 1 is safe,
so without a rate at zero the first step is exact.  A document's rate follows from its own
posterior and the few step vectors alone: nothing is joined or shuffled to
apply it.

Defined results: a null or empty text has no tokens and the prior as its
posterior; domains of the targets without a labelled document drop out and the
other targets are scaled up; without any label there is one domain, ``all``;
a domain without tokens can't reach its target and the rest comes as near as
it can; repeated rows are documents of their own; a null id isn't learned from,
and is scored and rated; an empty table gives no rows; other columns, whatever
their names, are not read, and ``resample`` passes them on.  A solver that
stops before its optimum warns and says so in ``Rates.converged``.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import labelled_sample, materialise

SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Config:
    """Hash buckets, informative buckets kept, the bound of the labelled sample, and the solver's limits."""

    buckets: int = 1 << 14
    informative: int = 1024
    max_rows: int = 10_000
    smoothing: float = 0.5
    steps: int = 100
    tolerance: float = 1e-6
    still: float = 1e-5
    seed: int = 23


@dataclass
class DomainModel:
    """``bias`` per domain, and per domain a weight for every bucket (0 where uninformative)."""

    domains: list[str]
    bias: list[float]
    weights: np.ndarray


@dataclass
class Rates:
    """The solver's step vectors with the momentum before each; ``totals`` and ``targets`` by domain; whether the optimum was reached."""

    domains: list[str]
    targets: np.ndarray
    totals: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps: list[tuple[np.ndarray, float]] = field(default_factory=list)
    converged: bool = True


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _buckets(words: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.array_distinct(words), lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(n)).cast("int")))


def train_domains(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> DomainModel:
    """A model of (doc_id, label) over the documents' words."""
    sample = labelled_sample(docs, labels, config.max_rows, config.seed).select(F.col("label").cast("string").alias("label"), _buckets(_words(F.col("text")), config.buckets).alias("b"))
    sample = materialise(sample, "domain-sample")
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    domains = sorted(sizes)
    if not domains:
        return DomainModel(["all"], [0.0], np.zeros((1, config.buckets)))
    counts = np.zeros((len(domains), config.buckets))
    for r in sample.select("label", F.explode("b").alias("b")).groupBy("label", "b").agg(F.count("*").alias("n")).toLocalIterator():  # domains x buckets numbers
        counts[domains.index(r.label), r.b] = r.n
    n = np.array([sizes[d] for d in domains], dtype=float)[:, None]
    p = (counts + config.smoothing) / (n + 2 * config.smoothing)
    share = n / n.sum()
    whole = (share * p).sum(axis=0)
    gain = (share * (p * np.log(p / whole) + (1 - p) * np.log((1 - p) / (1 - whole)))).sum(axis=0)
    keep = np.argsort(-gain, kind="stable")[: config.informative]
    weights = np.zeros_like(counts)
    weights[:, keep] = np.log(p[:, keep] / (1 - p[:, keep]))
    bias = np.log(share[:, 0]) + np.log(1 - p[:, keep]).sum(axis=1)
    return DomainModel(domains, bias.tolist(), weights)


def with_posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """(row, tokens, posterior): every row of ``docs`` as a struct, its number of words, and the domain probabilities in the model's order."""
    used = (model.weights != 0).any(axis=0)
    table = docs.sparkSession.createDataFrame([(used.tolist(), model.weights.tolist())], "used array<boolean>, weights array<array<double>>")
    told = F.transform(F.array(_words(F.col("row.text").cast("string"))), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.filter(_buckets(w, model.weights.shape[1]), lambda b: F.get(F.col("used"), b)).alias("hits")))[0]
    shaped = docs.select(F.struct("*").alias("row")).crossJoin(F.broadcast(table)).withColumn("told", told)  # the table is one row
    prior = F.array(*[F.lit(float(x)) for x in _prior(model)])

    def logit(j: int) -> Column:
        return F.aggregate(F.col("told.hits"), F.lit(float(model.bias[j])), lambda s, b: s + F.get(F.get(F.col("weights"), F.lit(j)), b))

    logits = F.array(*[logit(j) for j in range(len(model.domains))])
    soft = lambda z: F.transform(F.array(F.array_max(z)), lambda m: F.transform(z, lambda x: F.exp(x - m)))[0]
    normal = F.transform(F.array(F.transform(F.array(logits), soft)[0]), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y)))[0]
    return shaped.select("row", F.col("told.n").alias("tokens"), F.when(F.size("told.hits") == 0, prior).otherwise(normal).alias("posterior"))


def _prior(model: DomainModel) -> np.ndarray:
    """The posterior of a document without informative words: what the bias says of labelled shares."""
    if len(model.domains) == 1:
        return np.ones(1)
    p = 1 / (1 + np.exp(-model.weights))
    z = np.array(model.bias) - np.where(model.weights != 0, np.log(1 - p), 0).sum(axis=1)
    e = np.exp(z - z.max())
    return e / e.sum()


def _state(posterior: Column, rates: Rates) -> Column:
    """(r, q, moved) of a document: its rate, the one before, and how far the last step moved it; the steps, replayed."""
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("q"), F.lit(0.0).alias("moved"))
    if not rates.steps:
        return start
    steps = F.array(*[F.struct(F.lit(float(b)).alias("b"), F.array(*[F.lit(float(x)) for x in v]).alias("v")) for v, b in rates.steps])

    def move(state: Column, step: Column) -> Column:
        y = state["r"] + step["b"] * (state["r"] - state["q"])
        dot = sum((F.get(posterior, F.lit(j)) * F.get(step["v"], F.lit(j)) for j in range(len(rates.domains))), F.lit(0.0))
        new = F.greatest(F.lit(0.0), y + dot)
        return F.struct(new.alias("r"), state["r"].alias("q"), (new - y).alias("moved"))

    return F.aggregate(steps, start, move)


def rate_of(posterior: Column, rates: Rates) -> Column:
    """The rate of a document."""
    return _state(posterior, rates)["r"]


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], config: Config = Config()) -> Rates:
    """Fit the rates of (tokens, posterior) rows to shares of the tokens there are."""
    k = len(domains)
    want = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    want = want / want.sum() if want.sum() else np.full(k, 1 / k)
    p = [F.get(F.col("posterior"), F.lit(j)) for j in range(k)]
    moments = members.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
    total = float(moments[0] or 0)
    gram = np.array([float(x or 0) for x in moments[1:]]).reshape(k, k)
    rates = Rates(domains, want * total, np.zeros(k))
    if not total:
        return rates
    inverse = np.linalg.pinv(gram, rcond=1e-10, hermitian=True)
    before, last, pace = None, np.inf, 1.0
    while True:
        told = members.select("tokens", "posterior", _state(F.col("posterior"), rates).alias("s"))
        *sums, moved = told.agg(*[F.sum(F.col("s.r") * F.col("tokens") * x) for x in p], F.sum(F.col("s.moved") ** 2 * F.col("tokens"))).first()
        rates.totals = np.array([float(x) for x in sums])
        miss = rates.targets - rates.totals
        value = miss @ inverse @ miss  # what is minimised
        # A step that moves no rate is an optimum; so are the targets themselves.
        rates.converged = bool(np.abs(miss).max() <= config.tolerance * total or (rates.steps and float(moved) <= (config.still**2) * total))
        if rates.converged or len(rates.steps) >= config.steps:
            break
        if value > last:
            pace = 1.0  # momentum starts anew
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        push = (pace - 1) / faster if before is not None else 0.0
        ahead = rates.totals + push * (rates.totals - before) if before is not None else rates.totals  # totals are linear in the rates
        rates.steps.append((inverse @ (rates.targets - ahead), push))
        before, last, pace = rates.totals, value, faster
    if not rates.converged:
        warnings.warn(f"mixing rates: no optimum after {config.steps} steps; totals miss the targets by {np.abs(miss).max() / total:.2e} of the tokens", stacklevel=2)
    return rates


def soft_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], config: Config = Config()) -> DataFrame:
    """(doc_id, n_tokens, domains, posterior, rate) of every row."""
    model = train_domains(docs, labels, config)
    members = materialise(with_posteriors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("row.doc_id", "tokens", "posterior"), "members")
    rates = fit_rates(members, model.domains, targets, config)
    return members.select("doc_id", F.col("tokens").alias("n_tokens"), F.array(*map(F.lit, model.domains)).alias("domains"), "posterior", rate_of(F.col("posterior"), rates).alias("rate"))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float], config: Config = Config()) -> DataFrame:
    """The documents taken at their rates: floor(rate + u) copies of each, u a uniform number made of the id.

    The columns are those of ``docs``.
    """
    model = train_domains(docs, labels, config)
    told = materialise(with_posteriors(docs, model), "members", compression="zstd")  # whole rows: their words are hashed once, and a lost task costs no more
    rates = fit_rates(told, model.domains, targets, config)
    u = F.pmod(F.xxhash64(F.col("row.doc_id").cast("string"), F.lit(config.seed)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(rate_of(F.col("posterior"), rates) + u).cast("int")
    return told.select("row", F.explode(F.array_repeat(F.lit(True), copies))).select("row.*")
