"""Mixing documents to target weights of domains, with DataFrame functions only.

A labelled table names the domain of some documents. A naive Bayes classifier
over informative words, fitted on a bounded sample of them, gives every document
posterior shares of all domains (soft membership). Projected-gradient least
squares then finds a nonnegative rate for each document so that the expected
tokens of each domain match the targets: every step sums a handful of numbers
over all documents, and a document's rate follows from its own shares and the
steps so far.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, fresh

#: The classifier is fitted on at most this many labelled ids, taken by hash, and keeps so many words.
TRAIN_ROWS = 10_000
WORDS = 4_096
SMOOTHING = 0.5
#: The words of a text count as so many at most, so that shares stay soft.
EVIDENCE_WORDS = 8.0
STEPS = 60
TOLERANCE = 1e-6
TARGETS = {"good": 0.75, "poor": 0.2, "toxic": 0.05}


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def marks_of(text: Column, words: Column) -> Column:
    """Traits of a text as words of their own (they hold a colon): length, variety, share of signs, length of words."""
    n, letters = F.size(words), F.length(F.array_join(words, " "))
    size = F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1))
    traits = {
        "length": F.floor(F.log2(n + 1)), "variety": F.floor(F.size(F.array_distinct(words)) * 10 / F.greatest(n, F.lit(1))),
        "signs": F.floor((1 - letters / size) * 20), "wordlength": F.floor(letters / F.greatest(n, F.lit(1))),
    }
    return F.array(*(F.concat(F.lit(f"{name}:"), F.least(value, F.lit(20)).cast("string")) for name, value in traits.items()))


def label_domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The domain that a row of labels names; null if it does not say."""
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 1, "good").when(F.col(quality) == 0, "poor")


def domain_words(docs: DataFrame, labels: DataFrame, domains: list[str], domain: Column, train_rows: int, words: int) -> tuple[DataFrame, list[float]]:
    """Log-likelihoods per domain of the most informative words (at most ``words`` rows), and the log-priors.

    An id that is labelled more than once counts with its last domain by name.
    """
    named = labels.select(F.col("doc_id").alias("label_id"), domain.alias("domain")).where(F.col("label_id").isNotNull() & F.col("domain").isin(domains))
    sample = named.groupBy("label_id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("label_id"), "label_id").limit(train_rows)
    seen = (docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))  # at most train_rows rows
            .select("domain", "text", words_of(F.col("text")).alias("words"))
            .select("domain", F.explode(F.concat(F.array_distinct("words"), marks_of(F.col("text"), F.col("words")))).alias("word")))
    counts = cut(seen.groupBy("word").agg(*(F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains))))
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # one row per domain
    total = [sizes.get(d, 0) for d in domains]
    share = [(F.col(f"n{k}") + SMOOTHING) / F.lit(total[k] + 2 * SMOOTHING) for k in range(len(domains))]
    every = sum((F.col(f"n{k}") for k in range(len(domains))), F.lit(0))
    mean = (every + SMOOTHING) / F.lit(sum(total) + 2 * SMOOTHING)
    # Information: texts with the word, times how far their domains are from those of all texts.
    gain = sum((F.col(f"n{k}") * F.log(share[k] / mean) for k in range(len(domains))), F.lit(0.0))
    # Traits are kept whatever they gain: they are few.
    table = counts.orderBy(F.col("word").contains(":").desc(), gain.desc(), "word").limit(words).select("word", *(F.log(share[k] / mean).alias(f"e{k}") for k in range(len(domains))))
    prior = [math.log((n + SMOOTHING) / (sum(total) + SMOOTHING * len(domains))) for n in total]
    return table, prior


def memberships(docs: DataFrame, labels: DataFrame, domains: list[str], domain: Column | None = None, train_rows: int = TRAIN_ROWS, words: int = WORDS) -> DataFrame:
    """One row per distinct (doc_id, text): copies, print, n_tokens and p0, p1, ... (posterior per domain).

    ``copies`` counts the rows that repeat both. Each text adds an empty word
    that every text has, so texts without informative words keep a row and get
    the priors.
    """
    table, prior = domain_words(docs, labels, domains, label_domain() if domain is None else domain, train_rows, words)
    blank = docs.sparkSession.range(1).select(F.lit("").alias("word"), *(F.lit(0.0).alias(f"e{k}") for k in range(len(domains))))
    table = cut(table.where("word <> ''").unionAll(blank))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"), "text", words_of(F.col("text")).alias("words"))
    tokens = F.concat(F.array(F.lit("")), marks_of(F.col("text"), F.col("words")), F.col("words"))
    every = rows.select("doc_id", "print", F.size("words").cast("long").alias("n"), F.explode(tokens).alias("word"))
    mark, word = F.col("word").contains(":"), (F.col("word") != "") & ~F.col("word").contains(":")
    found = (every.join(F.broadcast(table), "word")  # at most words + 1 rows
             .groupBy("doc_id", "print").agg(
                 F.sum((F.col("word") == "").cast("long")).alias("copies"), F.max("n").alias("n_tokens"),
                 F.sum(word.cast("long")).alias("hits"),
                 *(F.sum(F.when(word, F.col(f"e{k}")).otherwise(F.lit(0.0))).alias(f"e{k}") for k in range(len(domains))),
                 *(F.sum(F.when(mark, F.col(f"e{k}")).otherwise(F.lit(0.0))).alias(f"m{k}") for k in range(len(domains)))))
    # Sums cover all copies; beyond EVIDENCE_WORDS hits the evidence is averaged.
    hits = F.col("hits") / F.col("copies")
    weight = F.when(hits > EVIDENCE_WORDS, F.lit(EVIDENCE_WORDS) / hits).otherwise(F.lit(1.0)) / F.col("copies")
    scores = [F.round(F.col(f"e{k}") * weight + F.col(f"m{k}") / F.col("copies") + F.lit(prior[k]), 9) for k in range(len(domains))]
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    found = found.select("doc_id", "print", "copies", "n_tokens", *(F.exp(s - top).alias(f"p{k}") for k, s in enumerate(scores)))
    total = sum((F.col(f"p{k}") for k in range(len(domains))), F.lit(0.0))
    return found.select("doc_id", "print", "copies", "n_tokens", *((F.col(f"p{k}") / total).alias(f"p{k}") for k in range(len(domains))))


def _rate(pull: np.ndarray) -> Column:
    """A document's rate: 1 moved along its shares by the sum of all steps, and never below 0; 1 without tokens."""
    moved = F.greatest(F.lit(0.0), sum((F.col(f"p{k}") * F.lit(float(x)) for k, x in enumerate(pull)), F.lit(1.0)))
    return F.when(F.col("n_tokens") > 0, moved).otherwise(F.lit(1.0))


def fit_rates(shares: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> Column:
    """The rate column that makes expected domain tokens match ``targets`` (shares of all tokens).

    Least squares by projected gradient from rate 1: the gradient of a
    document's rate is its shares times what the domains lack, steps add up, and
    their sum is projected on rates of 0 or more. Steps are scaled by the second
    moments of the documents with a rate above 0 and halved until the fit gains,
    so a few do; rates stay as near to 1 (weighted by tokens) as the targets
    allow. Per step one row of sums reaches the driver.
    """
    size = len(targets)
    weight = F.col("copies") * F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(size) for j in range(i, size)]

    def sums(pull: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """All tokens, half the rated squares, expected tokens per domain, and the moments of documents with a rate above 0."""
        rated = shares.select(weight.alias("w"), _rate(pull).alias("rate"), *(F.col(f"p{k}") for k in range(size)))
        w, rate = F.col("w"), F.col("rate")
        moment = [F.sum(F.when(rate > 0, w * F.col(f"p{i}") * F.col(f"p{j}"))) for i, j in pairs]
        row = [x or 0.0 for x in rated.agg(F.sum(w), F.sum(w * rate * rate) / 2, *(F.sum(w * rate * F.col(f"p{k}")) for k in range(size)), *moment).first()]
        gram = np.zeros((size, size))
        for (i, j), x in zip(pairs, row[2 + size :], strict=True):
            gram[i, j] = gram[j, i] = x
        return row[0], row[1], np.array(row[2 : 2 + size]), gram

    pull = np.zeros(size)
    total, half, got, gram = sums(pull)
    goal = np.array(targets) * total / sum(targets)
    passes = 1
    while passes < steps and np.abs(goal - got).max() > tolerance * total:
        move = np.linalg.pinv(gram + np.eye(size) * 1e-9 * max(np.trace(gram), 1e-30)) @ (goal - got)
        value, gain = pull @ goal - half, (goal - got) @ move
        while passes < steps:
            _, half, got, gram = sums(pull + move)
            passes += 1
            if (pull + move) @ goal - half >= value + 1e-4 * gain:
                break
            move, gain = move / 2, gain / 2
        pull = pull + move
    return _rate(pull)


def mix_to_targets(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, a share per domain (``share_<domain>``) and rate.

    The rate says how often a document is to be taken (fractions are
    probabilities); summed over documents, rate x tokens x share of each domain
    matches its target, if nonnegative rates can. Null and empty texts have no
    tokens, the prior shares and rate 1. Rows that repeat an id and its text
    share one classification and get a row each. Null ids are classified like
    others and never matched with labels. An empty table gives no rows; without
    labels all shares are the same. Other columns are not read.
    """
    targets = TARGETS if targets is None else targets
    domains = sorted(targets)
    shares = cut(memberships(docs, labels, domains, domain))
    rate = fit_rates(shares, [targets[d] for d in domains])
    rated = shares.select("doc_id", "n_tokens", *(F.col(f"p{k}").alias(f"share_{d}") for k, d in enumerate(domains)), rate.alias("rate"), "copies")
    return rated.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")


def with_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: Column | None = None) -> DataFrame:
    """``docs``, all rows and columns, with a column for the rate (named ``rate`` unless that is taken)."""
    targets = TARGETS if targets is None else targets
    domains = sorted(targets)
    shares = cut(memberships(docs, labels, domains, domain))
    rate = fit_rates(shares, [targets[d] for d in domains])
    name, own_id, own_print = fresh(docs, "rate", "rated_id", "rated_print")
    rates = shares.select(F.col("doc_id").alias(own_id), F.col("print").alias(own_print), rate.alias(name))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(own_print))
    return docs.join(rates, same, "left").drop(own_id, own_print)
