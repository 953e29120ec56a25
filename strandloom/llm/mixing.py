"""Mixing documents of unknown domain to target weights, in DataFrame functions only.

A naive Bayes classifier on binned features is counted on the labelled table and
gives every document posteriors over the label's domains. Document rates then
solve a nonnegative least squares problem: the expected tokens of each domain,
sum of rate * tokens * posterior, shall be the domain's target; misses weigh by
the inverse of the domain's own size, so that small domains count. Where soft posteriors
keep targets out of reach, the targets alone would have all tokens come from the few
documents with the most extreme posteriors; so rates shall also be 1, with the small weight
``NEAR`` by tokens, which makes the solution unique.

The rates are fitted by distributed projected gradient. Documents with the same feature bins have the
same posteriors and so the same rate; so the rates are a column of a table with one row per combination of bins,
whose number does not grow with the corpus. A step moves all rates against the gradient and lifts those below their
least value back to it; the rates that are then free go on along conjugate gradients, of which one more than there
are domains suffice, and are lifted again. Only sums per domain come to the driver. At the solution a rate is max(least, 1 - prices * posteriors) with one
price per domain, proportional to the domain's remaining miss; steps end when the table's rates
are what these prices say, and the prices then give every document its rate. The text is never shuffled.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import documents, scratch, text_of

# Labelled documents per domain from which the telling words are learned, and words per domain.
SAMPLE, VOCABULARY = 2000, 64
QUANTILES = [0.05, 0.2, 0.5, 0.8, 0.95]
# Weight of rates off 1 against misses of the targets.
NEAR = 1e-3
# Steps end when no rate is further than the tolerance from what its prices say, or after so many.
STEPS, TOLERANCE = 200, 1e-7
# Shares of all tokens by domain (quality/toxic); domains that the labels do not show are left out.
WEIGHTS = {"1/0": 0.9, "0/0": 0.1, "1/1": 0.0, "0/1": 0.0}


def domain_of_labels(labels: DataFrame) -> DataFrame:
    """doc_id and domain of every labelled document; a document labelled more than once counts once, by its first domain."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    named = known.select(F.col("doc_id").cast("bigint").alias("_doc"), F.concat_ws("/", F.col("quality").cast("int"), F.col("toxic").cast("int")).alias("domain"))
    return named.groupBy("_doc").agg(F.min("domain").alias("domain"))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def telling_words(docs: DataFrame, domains: DataFrame, names: list[str]) -> dict[str, list[str]]:
    """Words whose share of documents is highest in a domain against the others, at least four times as high; learned on a bounded sample."""
    order = [F.xxhash64("_doc"), F.col("_doc")]
    chosen = None
    for name in names:
        some = domains.where(F.col("domain") == name).orderBy(*order).limit(SAMPLE)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_doc"))
    each = sample.select("domain", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    counts = [F.count(F.when(F.col("domain") == n, 1)).alias(f"n{i}") for i, n in enumerate(names)]
    table = scratch(each.groupBy("word").agg(*counts).where(" + ".join(f"n{i}" for i in range(len(names))) + " >= 3"), "words")
    found = {}
    for i, name in enumerate(names):
        own, rest = sizes.get(name, 0), sum(sizes.values()) - sizes.get(name, 0)
        share = F.col(f"n{i}") / max(own, 1)
        others = (sum((F.col(f"n{j}") for j in range(len(names)) if j != i), F.lit(0))) / max(rest, 1)
        top = table.where((share > 4 * others) & (F.col(f"n{i}") >= 3)).orderBy((others - share).asc(), "word").limit(VOCABULARY)
        found[name] = [r["word"] for r in top.select("word").collect()]
    return found


def described(rows: DataFrame, vocabulary: dict[str, list[str]], keep: list[str]) -> tuple[DataFrame, list[str]]:
    """The columns ``keep`` of rows with ``_text``, ``_tokens``, and numbers that describe the text; also the numbers' names.

    Every array that several numbers need is a column of its own first, so that it is made once.
    """
    words = rows.select(*keep, "_text", _words(F.col("_text")).alias("_words"))
    words = words.select("*", F.array_distinct("_words").alias("_distinct"), F.greatest(F.char_length("_text"), F.lit(1)).alias("_n"), F.greatest(F.size("_words"), F.lit(1)).alias("_size"))
    found = {
        "_capitals": F.regexp_count("_text", F.lit(r"\p{Lu}")) / F.col("_n"),
        "_signs": F.regexp_count("_text", F.lit(r"[^\p{L}\p{N}\s.,]")) / F.col("_n"),
        "_variety": F.size("_distinct") / F.col("_size"),
        "_word_length": F.char_length("_text") / F.col("_size"),
        "_length": F.log2("_size"),
    }
    for i, name in enumerate(sorted(vocabulary)):
        if vocabulary[name]:
            found[f"_told{i}"] = F.size(F.array_intersect("_distinct", F.array(*map(F.lit, vocabulary[name])))).cast("double")
    return words.select(*keep, F.size("_words").cast("bigint").alias("_tokens"), *[v.alias(k) for k, v in found.items()]), list(found)


class Mixture:
    """Classifier and rates as column expressions over a text."""

    def __init__(self, vocabulary: dict[str, list[str]], bounds: dict[str, list[float]], names: list[str], logs: dict[str, list[list[float]]], prior: list[float]):
        self.vocabulary, self.bounds, self.names, self.logs, self.prior = vocabulary, bounds, names, logs, prior
        # Per domain: least rate of its documents, price, and expected less wanted tokens, as a share of all; number of steps.
        self.least: list[float] = [0.0] * len(names)
        self.prices: list[float] = [0.0] * len(names)
        self.miss: list[float] = []
        # Steps taken, and how far a rate was from its prices' at most when they ended.
        self.steps, self.gap = 0, 0.0
        # The numbers of all documents: _id, _coin, _tokens and one column per number.
        self.features: DataFrame | None = None

    def classified(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """The columns ``keep`` and ``_p``, the posteriors of the domains, from rows with the numbers."""
        binned = rows.select(*keep, *self.bins())
        scores = []
        for d in range(len(self.names)):
            tables = [F.element_at(F.array(*map(F.lit, self.logs[k][d])), F.col(k) + 1) for k in self.bounds]
            scores.append(sum(tables, F.lit(self.prior[d])))
        scored = binned.select(*keep, F.array(*scores).alias("_s"))
        powers = scored.select(*keep, F.transform("_s", lambda s: F.exp(s - F.array_max("_s"))).alias("_e"))
        total = F.aggregate("_e", F.lit(0.0), lambda x, e: x + e)
        return powers.select(*keep, "_e", total.alias("_total")).select(*keep, F.transform("_e", lambda e: e / F.col("_total")).alias("_p"))

    def bins(self) -> list[Column]:
        """Of each number, how many bounds it reaches."""
        return [sum(((F.col(k) >= b).cast("int") for b in bounds), F.lit(0)).alias(k) for k, bounds in self.bounds.items()]

    def best_name(self) -> Column:
        """The most likely domain; of equally likely ones the first by name."""
        return F.element_at(F.array(*map(F.lit, self.names)), F.array_position("_p", F.array_max("_p")).cast("int"))

    def rate(self, posterior: Column) -> Column:
        return F.greatest(_least(posterior, self.least), _free(posterior, self.prices))


def _coin() -> Column:
    """A number from 0 to below 1 by a hash of id and text."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("bigint"), text_of()), F.lit(1 << 30)) / float(1 << 30)


def _least(posterior: Column, least: list[float]) -> Column:
    """The least rate of the most likely domain."""
    if len(set(least)) == 1:
        return F.lit(float(least[0]))
    return F.element_at(F.array(*[F.lit(float(v)) for v in least]), F.array_position(posterior, F.array_max(posterior)).cast("int"))


def _free(posterior: Column, prices: list[float]) -> Column:
    """The rate if none were too small."""
    return F.lit(1.0) - sum((F.element_at(posterior, d + 1) * F.lit(float(v)) for d, v in enumerate(prices)), F.lit(0.0))


def _classifier(narrow: DataFrame, domains: DataFrame, names: list[str], vocabulary: dict[str, list[str]], kinds: list[str]) -> Mixture:
    """Bins from quantiles of all labelled documents, and smoothed counts of bins per domain."""
    labelled = scratch(narrow.join(domains, F.col("_id") == F.col("_doc")).select("domain", *kinds), "labelled")
    cuts = labelled.agg(*[F.percentile_approx(k, QUANTILES, 10000).alias(k) for k in kinds]).first()
    bounds = {k: sorted(set(cuts[k] or [])) for k in kinds}
    # A count of telling words above 0, 1 and 3 says more than quantiles that are all 0.
    bounds = {k: [1.0, 2.0, 4.0] if k.startswith("_told") else b for k, b in bounds.items()}
    mixture = Mixture(vocabulary, bounds, names, {}, [])
    binned = labelled.select("domain", *mixture.bins())
    counts = binned.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(k) == b, 1)).alias(f"{k}_{b}") for k in kinds for b in range(len(bounds[k]) + 1)]
    )
    rows = {r["domain"]: r for r in counts.collect()}
    total = sum(r["n"] for r in rows.values())
    mixture.prior = [math.log((rows[n]["n"] + 1) / (total + len(names))) for n in names]
    for k in kinds:
        width = len(bounds[k]) + 1
        mixture.logs[k] = [[math.log((rows[n][f"{k}_{b}"] + 1) / (rows[n]["n"] + width)) for b in range(width)] for n in names]
    return mixture


def fitted(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, keep: bool = False) -> Mixture | None:
    """Train the classifier and fit the rates; None if no document is labelled with a domain that has a weight.

    With ``keep``, documents whose most likely domain is wanted (weight above 0) have rates of at least 1, and all targets
    are raised by the least factor by which no wanted domain's target is below its own tokens. Otherwise targets are shares of the tokens given.
    """
    wanted = domain_of_labels(labels).where(F.col("domain").isin(*weights))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("_doc"))
    domains = scratch(wanted.join(ids, "_doc", "left_semi"), "domains")
    names = sorted(r["domain"] for r in domains.select("domain").distinct().collect())  # at most one per weight
    if not names or sum(weights[n] for n in names) <= 0:
        return None
    vocabulary = telling_words(docs, domains, names)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), text_of().alias("_text"), _coin().alias("_coin"))
    numbers, kinds = described(texts, vocabulary, ["_id", "_coin"])
    narrow = scratch(numbers, "features")
    mixture = _classifier(narrow, domains, names, vocabulary, kinds)
    mixture.features = narrow

    cells = narrow.select("_tokens", *mixture.bins()).groupBy(*kinds).agg(F.sum("_tokens").cast("double").alias("tokens"))
    for k, bounds in mixture.bounds.items():  # any number of the bin stands for it
        cells = cells.withColumn(k, F.element_at(F.array(*map(F.lit, [-math.inf, *bounds])), F.col(k) + 1))
    cells = scratch(mixture.classified(cells, ["tokens"]), "cells")
    share = np.array([weights[n] for n in names]) / sum(weights[n] for n in names)
    if keep:
        mixture.least = (share > 0).astype(float).tolist()
    found = solved(cells, share, mixture.least, keep)
    if found is not None:
        mixture.prices, mixture.miss, mixture.steps, mixture.gap = found
    return mixture


def solved(cells: DataFrame, share: np.ndarray, least: list[float], raised: bool = False) -> tuple[list[float], list[float], int, float] | None:
    """Prices and misses per domain, steps, and the largest distance of a rate from its prices'; None without tokens.

    ``cells`` has ``tokens`` and the posteriors ``_p``. ``raised`` raises the targets to the tokens of the wanted domains. If
    ``STEPS`` do not bring the rates within the tolerance, the prices of the last step hold and the distance says so.
    """
    n = len(share)
    ps = [F.col(f"p{d}") for d in range(n)]
    tokens, r, x, d = (F.col(c) for c in ("tokens", "r", "x", "d"))
    state = cells.select("tokens", *[F.element_at("_p", i + 1).alias(f"p{i}") for i in range(n)], _least(F.col("_p"), least).alias("least"))
    state = scratch(state.withColumn("r", F.greatest(F.lit(1.0), "least")), "rates")
    total = float(state.agg(F.sum("tokens")).first()[0] or 0.0)
    if total <= 0:
        return None

    def dot(numbers: np.ndarray) -> Column:
        return sum((F.lit(float(v)) * p for v, p in zip(numbers, ps)), F.lit(0.0))

    def gradient(expected: np.ndarray, rate: Column) -> Column:
        """Per rate and token, half the slope of the objective."""
        return dot(weight * (expected - share)) + NEAR * (rate - 1)

    def sums(rows: DataFrame, *columns: Column) -> np.ndarray:
        return np.array(rows.agg(*columns).first(), float)

    def of_rate(rate: Column) -> list[Column]:
        """Squared distance from 1 and expected tokens per domain."""
        return [F.sum(tokens * (rate - 1) * (rate - 1)) / total, *[F.sum(tokens * rate * p) / total for p in ps]]

    def objective(found: np.ndarray) -> float:
        return float((weight * (found[1:] - share) ** 2).sum() + NEAR * found[0])

    def products(where: Column) -> list[Column]:
        return [F.sum(F.when(where, tokens * a * b).otherwise(0.0)) / total for a in ps for b in ps]

    first = sums(state, *products(F.lit(True)), *of_rate(r))
    all_products, here = first[: n * n].reshape(n, n), first[n * n :]
    weight = 1 / np.maximum(np.diag(all_products), 1e-9)
    curvature = float(np.linalg.eigvalsh(np.sqrt(weight)[:, None] * all_products * np.sqrt(weight)).max()) + NEAR
    if raised:
        share = share * max(1.0, float((here[1:][share > 0] / share[share > 0]).max()))
    for step in range(STEPS + 1):
        prices = weight * (here[1:] - share) / NEAR
        moved = state.withColumn("x", F.greatest("least", r - gradient(here[1:], r) / curvature))
        *there, gap = sums(moved, *of_rate(x), F.max(F.abs(r - F.greatest("least", F.lit(1.0) - dot(prices)))))
        there = np.array(there)
        if gap < TOLERANCE or step == STEPS:
            break
        free = (x > F.col("least")) | (gradient(there[1:], x) < 0)
        face = moved.withColumns({"free": free, "g": F.when(free, gradient(there[1:], x)).otherwise(0.0)})
        face = face.select("tokens", *ps, "least", "x", "free", "g", (-F.col("g")).alias("d"), x.alias("z"))
        size, *within = sums(face, F.sum(tokens * F.col("g") * F.col("g")) / total, *products(F.col("free")))
        within, start = np.array(within).reshape(n, n), size
        for _ in range(n + 1):
            if size <= 1e-24 * max(start, 1.0):
                break
            along, *onto = sums(face, F.sum(tokens * d * d) / total, *[F.sum(tokens * d * p) / total for p in ps])
            onto = np.array(onto)
            pull = weight * onto  # the gradient changes by pull * posteriors + NEAR * d
            bent = float(pull @ onto + NEAR * along)
            far = size / bent
            after = size - 2 * far * bent + far * far * float(pull @ within @ pull + 2 * NEAR * pull @ onto + NEAR * NEAR * along)
            after = max(after, 0.0)
            face = face.withColumns({"z": F.col("z") + far * d, "g": F.col("g") + F.when(F.col("free"), far * (dot(pull) + NEAR * d)).otherwise(0.0)})
            face = face.withColumn("d", -F.col("g") + (after / size) * d)
            size = after
        length = 1.0
        while True:  # back from the face's least point until lifting the rates does not raise the objective
            lifted = face.select("tokens", *ps, "least", F.greatest("least", x + length * (F.col("z") - x)).alias("r"))
            found = sums(lifted, *of_rate(r))
            if objective(found) <= objective(there):
                break
            length /= 2
            if length < 1e-4:
                lifted, found = moved.select("tokens", *ps, "least", x.alias("r")), there
                break
        state, here = scratch(lifted, "rates"), found
    return prices.tolist(), (here[1:] - share).tolist(), step, float(gap)


def _rated(docs: DataFrame, mixture: Mixture | None) -> DataFrame:
    """``_row`` with all columns of ``docs``, and _tokens, _domain, _posterior, _rate, _copies; no shuffle, no Python."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    if mixture is None:
        return docs.select(whole, F.size(_words(text_of())).cast("bigint").alias("_tokens"), F.lit(None).cast("string").alias("_domain"), F.lit(None).cast("double").alias("_posterior"), F.lit(1.0).alias("_rate"), F.lit(1).cast("bigint").alias("_copies"))
    rows = docs.select(whole, text_of().alias("_text"), _coin().alias("_coin"))
    numbers, _ = described(rows, mixture.vocabulary, ["_row", "_coin"])
    given = mixture.classified(numbers, ["_row", "_tokens", "_coin"])
    out = given.select("_row", "_tokens", mixture.best_name().alias("_domain"), F.array_max("_p").alias("_posterior"), mixture.rate(F.col("_p")).alias("_rate"), "_coin")
    return out.select("_row", "_tokens", "_domain", "_posterior", "_rate", F.floor(F.col("_rate") + F.col("_coin")).alias("_copies"))


def rated(docs: DataFrame, mixture: Mixture | None) -> DataFrame:
    """All columns of ``docs`` and _tokens, _domain, _posterior, _rate, _copies; no shuffle, no Python.

    ``_copies`` is the rate rounded up or down by a hash of doc_id and text, up as often as the
    fraction says. Null texts count as empty. Without a mixture every rate is 1.
    """
    return _rated(docs, mixture).select("_row.*", "_tokens", "_domain", "_posterior", "_rate", "_copies")


def left_out(mixed: DataFrame) -> DataFrame:
    """Per domain of what ``rated`` gives: documents, and how many of them have no copy."""
    return mixed.groupBy(F.col("_domain").alias("domain")).agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("_copies") == 0, 1)).alias("left_out"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, domain, posterior, rate and copies of every document."""
    docs = documents(spark, sf_dir)
    mixture = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if mixture is None:
        found = rated(docs.select("doc_id", "text"), None)
    else:  # the texts were described for the fit; their numbers are stored
        given = mixture.classified(mixture.features, ["_id", "_tokens", "_coin"])
        given = given.select(F.col("_id").alias("doc_id"), "_tokens", "_coin", mixture.best_name().alias("_domain"), F.array_max("_p").alias("_posterior"), mixture.rate(F.col("_p")).alias("_rate"))
        found = given.withColumn("_copies", F.floor(F.col("_rate") + F.col("_coin")))
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("_tokens").alias("n_tokens"), F.col("_domain").alias("domain"), F.col("_posterior").alias("posterior"), F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its copies say; none of a wanted domain is left out.

    Null and empty texts have no tokens and are kept or repeated by the rate of their bins like others; repeated rows have the same copies each. Columns
    pass through whatever their names, an empty table stays empty, and without labels every document stays once.
    """
    mixed = _rated(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=True))
    return mixed.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("_row.*")
