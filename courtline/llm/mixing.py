"""Soft-membership mixing: domain posteriors, then nonnegative document rates that meet targets.

JVM only. The classifier and the fit are sums over tables; the driver sees the residual of each
round, one number per domain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import hashed_sample, let, saved, stored, words_of

#: Domains in order, and the share of the tokens each is to get.
TARGETS = {"clean": 0.93, "low": 0.05, "toxic": 0.02}
BUCKETS = 1 << 14
#: Labelled documents the classifier learns from (documented bound of the sample).
TRAINING_DOCS = 20_000
#: Log odds of a text are divided by this: words of one text are not independent.
TEMPERATURE = 4.0
#: Posteriors are whole multiples of 1 / GRAIN; documents with equal ones share a rate.
GRAIN = 200
ROUNDS = 60
TOLERANCE = 1e-4


def label_domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def classifier(words: DataFrame, labels: DataFrame, domains: list[str]) -> DataFrame:
    """One row: array per domain of log shares by word bucket, and the log priors.

    ``words`` (doc_id, words), ``labels`` (doc_id, domain). Multinomial with pseudo-counts;
    a domain without rows has flat shares.
    """
    sample = hashed_sample(labels, "doc_id", TRAINING_DOCS, "mixing")
    counts = (
        words.join(F.broadcast(sample.select(F.col("doc_id").alias("_l"), "domain")), F.col("doc_id") == F.col("_l"))
        .select("domain", F.explode(F.transform("words", _bucket)).alias("bucket"))
        .groupBy("bucket").agg(*(F.count(F.when(F.col("domain") == d, 1)).alias(f"c{i}") for i, d in enumerate(domains)))
    )
    # BUCKETS rows, whatever the corpus
    rows = (
        words.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
        .join(counts, "bucket", "left").na.fill(0)
        .agg(F.sort_array(F.collect_list(F.struct("bucket", *(f"c{i}" for i in range(len(domains)))))).alias("rows"))
    )

    def shares(i: int) -> Column:
        def of(total: Column) -> Column:
            return F.transform("rows", lambda r: F.log((r[f"c{i}"] + 1.0) / total))

        return let(F.aggregate("rows", F.lit(float(BUCKETS)), lambda acc, r: acc + r[f"c{i}"]), of)

    priors = labels.agg(F.array(*(F.log(F.count(F.when(F.col("domain") == d, 1)) + 1.0) for d in domains)).alias("prior"))
    table = rows.select(F.array(*(shares(i) for i in range(len(domains)))).alias("table"))
    return table.withColumn("prior", priors.scalar())


def posteriors(docs: DataFrame, labels: DataFrame, domains: list[str]) -> DataFrame:
    """``docs`` with n_tokens and p: posterior per domain in whole parts of GRAIN, summing to it."""
    rows = docs.withColumn("_words", words_of(F.col("text").cast("string")))
    known = (
        labels.select(F.col("doc_id").cast("bigint"), label_domain().alias("domain")).filter("doc_id is not null and domain is not null")
        .groupBy("doc_id").agg(F.min("domain").alias("domain"))
    )
    model = classifier(rows.select(F.col("doc_id").cast("bigint"), F.col("_words").alias("words")), known, domains)
    model = saved(model)
    rows = rows.withColumns({
        "_table": model.select("table").scalar(), "_prior": model.select("prior").scalar(),
    })

    def evidence(i: int):
        def of(buckets: Column) -> Column:
            return F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(F.get(F.col("_table"), F.lit(i)), b))

        return of

    k = len(domains)
    logs = let(
        F.transform("_words", _bucket),
        lambda b: F.array(*(evidence(i)(b) / TEMPERATURE + F.get("_prior", F.lit(i)) for i in range(k))),
    )
    shares = let(logs, lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top))))
    total = F.aggregate("_e", F.lit(0.0), lambda acc, v: acc + v)
    parts = F.transform("_e", lambda v: F.floor(v * GRAIN / F.col("_t")).cast("int"))
    # what rounding down leaves goes to the largest, the first of equals
    rest = F.lit(GRAIN) - F.aggregate("_p", F.lit(0), lambda acc, v: acc + v)
    best = F.array_position("_e", F.array_max("_e")).cast("int") - 1
    return (
        rows.withColumn("_e", shares).withColumn("_t", total).withColumn("_p", parts)
        .withColumns({
            "p": F.transform("_p", lambda v, i: v + F.when(i == best, rest).otherwise(0)),
            "n_tokens": F.size("_words").cast("bigint"),
        })
        .drop("_words", "_table", "_prior", "_e", "_t", "_p")
    )


def _inverse(m: list[list[float]]) -> list[list[float]]:
    """Gauss-Jordan with pivots; as small as the number of domains."""
    n = len(m)
    a = [row[:] + [float(i == j) for j in range(n)] for i, row in enumerate(m)]
    for c in range(n):
        p = max(range(c, n), key=lambda r: abs(a[r][c]))
        a[c], a[p] = a[p], a[c]
        a[c] = [v / a[c][c] for v in a[c]]
        for r in range(n):
            if r != c:
                a[r] = [x - a[r][c] * y for x, y in zip(a[r], a[c], strict=True)]
    return [row[n:] for row in a]


@dataclass(frozen=True)
class Fit:
    """Steps of the descent; ``rate`` replays them from a posterior."""

    steps: list[list[float]]
    residual: list[float]

    def rate(self, p: Column) -> Column:
        def step(r: Column, y: Column) -> Column:
            dot = sum((F.get(p, F.lit(i)) * F.get(y, F.lit(i)) for i in range(1, len(self.residual))), F.get(p, F.lit(0)) * F.get(y, F.lit(0)))
            return F.greatest(F.lit(0.0), r - dot / GRAIN)

        if not self.steps:
            return F.lit(1.0)
        flat = F.array(*(F.array(*map(F.lit, y)) for y in self.steps))
        return F.aggregate(flat, F.lit(1.0), step)


def fit_rates(docs: DataFrame, targets: list[float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Fit:
    """Projected-gradient least squares over ``docs`` (p, n_tokens).

    Minimises |A r - t|^2 over r >= 0 from r = 1, in the metric of the inverse Gram matrix of
    the posteriors, where the gradient has Lipschitz constant 1 and the step is 1. A document's
    rate depends on its posterior alone, so the sums run over one row per distinct posterior
    (their number is set by GRAIN and the domains, not by the corpus).
    """
    k = len(targets)
    cells = saved(
        docs.filter("n_tokens > 0").groupBy("p").agg(F.sum("n_tokens").cast("double").alias("tokens"))
    )
    share = [F.get("p", F.lit(i)) / float(GRAIN) for i in range(k)]
    names = [(i, j) for i in range(k) for j in range(i, k)]
    got = cells.agg(F.sum("tokens").alias("all"), *(F.sum(F.col("tokens") * share[i] * share[j]).alias(f"g{i}_{j}") for i, j in names)).first()
    if not got["all"]:
        return Fit([], [0.0] * k)
    gram = [[got[f"g{min(i, j)}_{max(i, j)}"] / got["all"] for j in range(k)] for i in range(k)]
    ridge = 1e-9 + 1e-6 * max(gram[i][i] for i in range(k))
    inverse = _inverse([[v + (ridge if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(gram)])
    fit = Fit([], [])
    for _ in range(rounds):
        rate = Fit(fit.steps, targets).rate(F.col("p"))
        sums = cells.agg(*(F.sum(F.col("tokens") * share[i] * rate).alias(f"s{i}") for i in range(k))).first()
        left = [sums[i] / got["all"] - t for i, t in enumerate(targets)]
        if max(map(abs, left)) <= tolerance:
            return Fit(fit.steps, left)
        fit = Fit([*fit.steps, [sum(a * b for a, b in zip(row, left, strict=True)) for row in inverse]], left)
    return fit


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` (doc_id, text and any others) with n_tokens, p and rate.

    Posteriors of the domains in ``targets`` come from a classifier on ``labels`` (doc_id,
    quality, toxic); rates are nonnegative and make the expected tokens of each domain,
    sum(rate * n_tokens * posterior), the target share of all tokens, as closely as rates can.

    Null or blank text: no tokens, the prior as posterior, and the rate of that posterior.
    Without labels the posteriors are equal. Several labels of one document: the first domain
    in order of name. Null labels, quality or ids teach nothing. Repeated rows count as often
    as they stand. No rows: no result. A column that is named like a result is replaced.
    """
    targets = targets or TARGETS
    # a table, so that no later filter on the rate is moved below the scoring and repeats it
    return _rated(stored(posteriors(docs, labels, list(targets))), targets)


def _rated(rows: DataFrame, targets: dict[str, float]) -> DataFrame:
    total = sum(targets.values())
    fit = fit_rates(rows, [v / total for v in targets.values()])
    return rows.withColumn("rate", F.round(fit.rate(F.col("p")), 9))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, p_<domain> and rate; see ``mixed``."""
    targets = targets or TARGETS
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # without the texts a checkpoint is small, and saves a second scoring
    rows = saved(posteriors(slim, labels, list(targets)).drop("text"))
    return _rated(rows, targets).select(
        "doc_id", "n_tokens",
        *((F.get("p", F.lit(i)) / float(GRAIN)).alias(f"p_{d}") for i, d in enumerate(targets)), "rate",
    )
