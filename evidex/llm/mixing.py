"""Soft-membership mixing of domains to target token shares.

1. A naive Bayes model over hashed words is fitted on a labelled table of (text, domain);
   it gives every document a posterior over the domains.  A document counts as evidence of
   at most ``EVIDENCE`` words, so that memberships stay soft.
2. Projected-gradient least squares finds a rate for every document, not below ``floor``,
   whose expected token totals by domain meet the targets.

Documents of the same posterior (rounded to hundredths) follow the same path from the same
start, so the descent runs over one row per posterior with its tokens summed: exact, and of
a size bounded by the number of rounded posteriors.  In relative units the Hessian is a
stochastic matrix, its largest eigenvalue is 1, and the step is 1.

Everything is SQL functions; the driver sees the model (``BUCKETS`` rows) and one row of sums
per step.

Defined results: a null or empty text has no tokens, the prior as posterior and a rate like
any other; labelled rows with a null text or a domain outside the targets are not used; a domain nobody belongs
to cannot be met and is left out of the fit; an empty table gives no rows; added columns
replace columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import staged, whole_text

BUCKETS = 2048
EVIDENCE = 12.0
STEPS = 60
TOLERANCE = 1e-5
STAGED = 6  # steps after which the rates are written, so that a step repeats few others
SLACK = 1.1  # room above the least total: documents of a wanted domain also carry others
HUNDREDTHS = 100


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(whole_text(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit_domains(labelled: DataFrame, domains: list[str], text: str = "text", domain: str = "domain") -> list[list[float]]:
    """Per domain, the log share of each word bucket (add-one smoothing)."""
    seen = labelled.where(F.col(domain).isin(domains)).select(F.col(domain).alias("d"), F.explode(_words(text)).alias("w"))
    counts = seen.groupBy(_bucket(F.col("w")).alias("b")).agg(
        *[F.count(F.when(F.col("d") == k, 1)).alias(f"c{i}") for i, k in enumerate(domains)]
    )
    rows = {r["b"]: r for r in counts.collect()}
    model = []
    for i in range(len(domains)):
        column = [rows[b][f"c{i}"] + 1 if b in rows else 1 for b in range(BUCKETS)]
        total = math.log(sum(column))
        model.append([math.log(c) - total for c in column])
    return model


def _literal(values: list[float]) -> Column:
    """A constant array as one folded literal."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def _adder(logs: Column):
    return lambda total, bucket: total + F.get(logs, bucket)


def posteriors(docs: DataFrame, model: list[list[float]], domains: list[str], text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``_share``: the rounded posterior, hundredths that add up to 100."""
    ids = F.transform(_words(text), _bucket)
    zero = F.lit(0.0)

    def shares(at: Column) -> Column:
        n = F.greatest(F.size(at), F.lit(1))
        evidence = F.least(n, F.lit(EVIDENCE)) / n
        logs = map(_literal, model)
        sums = [F.aggregate(at, zero, _adder(w)) * evidence for w in logs]
        return F.struct(F.size(at).cast("bigint").alias("n"), F.array(*sums).alias("logs"))

    scored = docs.withColumn("_s", F.transform(F.array(ids), shares)[0])
    weights = F.transform(F.col("_s.logs"), lambda x: F.exp(x - F.array_max("_s.logs")))
    total = F.aggregate("_w", zero, lambda a, x: a + x)
    rounded = F.transform("_w", lambda x: F.round(x / total * HUNDREDTHS).cast("int"))
    # what rounding leaves over goes to the largest share
    rest = F.lit(HUNDREDTHS) - F.aggregate("_r", F.lit(0), lambda a, x: a + x)
    top = F.array_position("_r", F.array_max("_r")) - 1
    return (
        scored.withColumn("_w", weights).withColumn("_r", rounded)
        .withColumn("_share", F.transform("_r", lambda x, i: x + F.when(i == top, rest).otherwise(0)))
        .withColumn("n_tokens", F.col("_s.n")).drop("_s", "_w", "_r")
    )


def _rate(steps: list[list[float]], floor: float) -> Column:
    """The rate after the given steps of projected descent from the rate there is."""
    if not steps:
        return F.col("rate")
    table = F.transform(F.split(F.lit(";".join(",".join(repr(g) for g in s) for s in steps)), ";"), lambda s: F.split(s, ",").cast("array<double>"))

    def move(rate: Column, step: Column) -> Column:
        slope = F.aggregate(F.zip_with("_share", step, lambda p, g: p * g / HUNDREDTHS), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(rate - slope, F.lit(floor))

    return F.aggregate(table, F.col("rate"), move)


def fit_rates(scored: DataFrame, targets: dict[str, float], floor: float = 0.0, total: float | None = None) -> DataFrame:
    """(``_share``, ``rate``): one row per posterior.

    ``total`` is the number of tokens wanted; None takes the least total at which every
    domain reaches its share without going below its present size, and a tenth more.  The
    descent ends when the totals meet the targets or no longer move.
    """
    domains, k = list(targets), len(targets)
    start = F.lit(max(1.0, floor)).alias("rate")
    groups = staged(scored.groupBy("_share").agg(F.sum("n_tokens").alias("t")).select("*", start), "mix-groups")
    part = lambda i: F.get("_share", F.lit(i)) / HUNDREDTHS

    def sums(rate: Column) -> list[float]:
        return [v or 0.0 for v in groups.agg(*[F.sum(F.col("t") * rate * part(i)) for i in range(k)]).first()]

    have = sums(F.lit(1.0))
    weight = sum(targets.values())
    share = [targets[d] / weight for d in domains]
    if total is None:
        total = SLACK * max((h / s for h, s in zip(have, share) if s > 0), default=0.0)
    want = [s * total for s in share]
    steps: list[list[float]] = []
    before = [math.inf] * k
    for _ in range(STEPS):
        now = sums(_rate(steps, floor))
        gap = [(n - w) / h if h > 0 else 0.0 for n, w, h in zip(now, want, have)]
        if all(abs(g) <= TOLERANCE or abs(g - b) <= TOLERANCE for g, b in zip(gap, before)):
            break
        steps.append(gap)
        before = gap
        if len(steps) == STAGED:
            groups = staged(groups.withColumn("rate", _rate(steps, floor)), "mix-groups")
            steps = []
    return groups.select("_share", _rate(steps, floor).alias("rate"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], floor: float = 0.0, total: float | None = None,
        text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``shares`` by domain, ``rate``, and ``copies``, the whole number that realises it.

    The fraction of a rate becomes one more copy with that probability, decided by a hash of
    the document.  The rates are joined by posterior; there are at most as many as ways to
    split 100 hundredths over the domains.
    """
    domains = list(targets)
    model = fit_domains(labelled, domains, text)
    scored = posteriors(docs, model, domains, text)
    scored = staged(scored.drop(text), "mix-shares")
    rates = staged(fit_rates(scored, targets, floor, total), "mix-rates")
    draw = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(1_000_003)) / 1_000_003
    bounded = math.comb(HUNDREDTHS + len(domains) - 1, len(domains) - 1) <= 200_000
    return (
        scored.drop("rate").join(F.broadcast(rates) if bounded else rates, "_share")
        .withColumn("shares", F.map_from_arrays(F.array(*[F.lit(d) for d in domains]), F.transform("_share", lambda x: x / HUNDREDTHS)))
        .withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("bigint"))
        .drop("_share")
    )


def labelled_sample(documents: DataFrame, labels: DataFrame, domain: Column, limit: int = 4_000) -> DataFrame:
    """At most ``limit`` labelled documents of good quality, by the order of a hash, with their domain."""
    chosen = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return documents.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", domain.alias("domain"))
