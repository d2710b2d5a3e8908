"""Mixing documents to target domain weights with soft membership.

A logistic regression over the presence of words is fitted on labelled rows (at
most ``SAMPLE_ROWS``, those of the smallest hash of doc_id) and gives every document a posterior over the domains.
Its words are for each domain those that tell most about it, however many rows they are in; words that say the same
(the language, the length) share their weight, so none is passed over for being common.
A document's rate is how often it should be taken. Rates are fitted by projected gradient: least
squares between the expected domain token totals (rate * tokens * posterior, summed over all
documents) and the targets, in the metric that weighs each document by its tokens, so that a
step depends on the posterior and not on the length; after each step rates below 0 become 0. Steps are scaled by
the Gram matrix of the posteriors, so that small domains move as fast as large ones, go in conjugate directions, and are as long as the
misses allow: one aggregate tries ``TRIALS`` lengths at once, by a row for each. A change of the rates weighs against the misses,
less and less (``PULLS``), until each domain misses its target by at most ``MISS`` of its own share; a target that is missed by more even so is logged as a warning.

A step is two or three aggregates of at most ``TRIALS`` rows. A rate is an expression of the document's posterior and one number for each domain.

Defined results: a null or blank text has 0 tokens and the posterior of a text without any of the words; without labelled
rows there are no domains and every rate is 1; a domain without documents adds nothing.
Repeated rows each count. Labels of unknown documents are ignored. Texts of any length count whole; other columns, whatever their names, are not looked at
(``mixed`` passes them on); equal gains of words go by the word.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import stored

#: Labelled rows that the classifier is fitted on, words it takes for each domain, and the fewest sample documents a word must be in.
SAMPLE_ROWS, VOCABULARY, LEAST_DOCUMENTS = 4000, 200, 5
#: Share of the sample up to which a word is taken: common words count too, whatever the mix of labels.
MOST_DOCUMENTS = 1.0
#: Weight of the squared coefficients; steps and largest slope (in rows) at which their fit ends.
RIDGE, FIT_STEPS, FIT_SLOPE = 0.1, 5000, 0.01
#: Gradient steps for one weight of changes, the slope (as a part of each domain's own share) at which they end, and the lengths that one aggregate tries.
STEPS, SLOPE, TRIALS = 150, 1e-4, 8
#: Part of a domain's own share of the tokens by which its target may be missed, and the least share that counts in that.
MISS, LEAST_SHARE = 0.02, 1e-9
#: How much a change of the rates weighs against the misses: falling, until the targets are met, and where whole documents
#: are taken (meeting them to the last token there would drop every document with a doubt).
PULLS, WHOLE_PULL = (0.05, 0.01, 0.002, 0.0005, 0.0001), 0.03

Model = tuple[list[str], list[str], list[float], list[list[float]]]


def words(text: Column) -> Column:
    """Lower-cased words of a text between white space; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a labels table: toxic, else good or poor by quality."""
    return labels.where("toxic is not null or quality is not null").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor").alias("domain"))


def fit(docs: DataFrame, domains: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Domain names, words, and for each domain its score without any word and what each word adds."""
    sample = domains.where("doc_id is not null and domain is not null").select("doc_id", "domain").orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # Read three times, so written once: the words of as many rows as the sample has.
    seen = stored(texts.select("domain", F.array_distinct(words(F.col("text"))).alias("ws")), "mixing-sample")
    totals = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    names, every = sorted(totals), sum(totals.values())
    if not names:
        return [], [], [], []
    counts = seen.select("domain", F.explode("ws").alias("w")).groupBy("w").agg(*[F.count_if(F.col("domain") == n).alias(f"c{i}") for i, n in enumerate(names)])
    present = sum(F.col(f"c{i}") for i in range(len(names)))
    able, chosen = stored(counts.where((present >= LEAST_DOCUMENTS) & (present <= MOST_DOCUMENTS * every)), "mixing-words"), set()
    for i, n in enumerate(names):
        # Mutual information of the word's presence and the domain against the others.
        here, parts = F.col(f"c{i}"), []
        for both, margin, total in ((here, present, totals[n]), (F.lit(totals[n]) - here, F.lit(every) - present, totals[n]), (present - here, present, every - totals[n]), (F.lit(every - totals[n]) - present + here, F.lit(every) - present, every - totals[n])):
            parts.append(F.when(both > 0, both * F.log(both * F.lit(float(every)) / (margin * F.lit(float(total))))).otherwise(F.lit(0.0)))
        chosen.update(r["w"] for r in able.select("w", F.round(sum(parts), 6).alias("gain")).orderBy(F.desc("gain"), "w").limit(VOCABULARY).collect())
    vocabulary = sorted(chosen)
    # As many rows as the sample has at most; of each only the words taken.
    taken = seen.select("domain", F.array_sort(F.array_intersect("ws", F.array(*map(F.lit, vocabulary)).cast("array<string>"))).alias("hits")).groupBy("domain", "hits").agg(F.count("*").alias("n"))
    start, add = _regression(names, vocabulary, sorted((r["domain"], r["hits"], r["n"]) for r in taken.collect()))
    return names, vocabulary, start, add


def _regression(names: list[str], vocabulary: list[str], rows: list[tuple[str, list[str], int]]) -> tuple[list[float], list[list[float]]]:
    """For each domain its score without any word and what each word adds, by accelerated steps below a bound of the curvature."""
    at = {w: i for i, w in enumerate(vocabulary)}
    x, y, times = np.zeros((len(rows), len(at) + 1)), np.zeros((len(rows), len(names))), np.array([n for *_, n in rows], float)[:, None]
    x[:, -1] = 1
    for i, (domain, hits, _) in enumerate(rows):
        x[i, [at[w] for w in hits]] = 1
        y[i, names.index(domain)] = 1
    ridge = np.append(np.full(len(at), RIDGE), 1e-6)[:, None]
    inverse = np.linalg.inv(0.5 * x.T @ (times * x) + np.diag(ridge[:, 0]))
    old = ahead = np.zeros((len(at) + 1, len(names)))
    pace = 1.0
    for _ in range(FIT_STEPS):
        score = x @ ahead
        e = np.exp(score - score.max(axis=1, keepdims=True))
        slope = x.T @ (times * (e / e.sum(axis=1, keepdims=True) - y)) + ridge * ahead
        if np.abs(slope).max() < FIT_SLOPE:
            break
        new, faster = ahead - inverse @ slope, (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead, old, pace = new + (pace - 1) / faster * (new - old), new, faster
    else:
        logging.getLogger(__name__).warning("the classifier's fit ended at a slope of %s rows", np.abs(slope).max())
    return ahead[-1].tolist(), ahead[:-1].T.tolist()


def _summed(places: str, start: float, weights: Column) -> Column:
    return F.aggregate(places, F.lit(start), lambda acc, i: acc + F.element_at(weights, i))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, p0 ...) for every row of ``docs`` (doc_id, text)."""
    names, vocabulary, start, add = model
    known = F.array(*map(F.lit, vocabulary)).cast("array<string>")
    staged = docs.select("doc_id", words(F.col("text")).alias("ws"))
    staged = staged.select("doc_id", F.size("ws").cast("long").alias("n_tokens"), F.array_intersect("ws", known).alias("hits"))
    staged = staged.withColumn("at", F.transform("hits", lambda w: F.array_position(known, w).cast("int")))
    for i, (s, a) in enumerate(zip(start, add, strict=True)):
        staged = staged.withColumn(f"s{i}", _summed("at", s, F.array(*map(F.lit, a)).cast("array<double>")))
    top = F.greatest(*[F.col(f"s{i}") for i in range(len(names))], *([F.col("s0")] if len(names) == 1 else []))
    for i in range(len(names)):
        staged = staged.withColumn(f"e{i}", F.exp(F.col(f"s{i}") - top))
    total = sum(F.col(f"e{i}") for i in range(len(names)))
    return staged.select("doc_id", "n_tokens", *[(F.col(f"e{i}") / total).alias(f"p{i}") for i in range(len(names))])


def fit_rates(scored: DataFrame, targets: list[float] | None, weights: list[float] | None = None, pull: float | None = None) -> Column:
    """The rate as an expression of the columns p0 ... of ``scored``.

    ``targets`` are token totals by domain; with ``weights`` instead they are shares of all tokens. ``pull``
    is held as given; without it, it falls through ``PULLS`` until the targets are met.
    """
    k = len(targets if targets is not None else weights)
    p, n = [F.col(f"p{i}") for i in range(k)], F.col("n_tokens").cast("double")
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    first = scored.agg(F.sum(n), *[F.sum(n * x) for x in p], *[F.sum(n * p[i] * p[j]) for i, j in cells]).first()
    tokens = first[0] or 0.0
    if not tokens:
        return F.lit(1.0)
    share = np.array([t / tokens for t in targets] if targets is not None else [w / sum(weights) for w in weights])
    present = np.maximum(np.array([x or 0.0 for x in first[1 : k + 1]]) / tokens, LEAST_SHARE)
    gram = np.zeros((k, k))
    for (i, j), x in zip(cells, first[k + 1 :], strict=True):
        gram[i, j] = gram[j, i] = (x or 0.0) / tokens

    def rate(moved: list[Column]) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) - sum(x * c for x, c in zip(p, moved, strict=True)))

    def misses(points: list[np.ndarray]) -> np.ndarray:
        # The points are rows made of one constant array, not constants of the code: it is compiled once for all steps.
        each = F.array(*[F.struct(F.lit(at).alias("at"), *[F.lit(float(c)).alias(f"m{i}") for i, c in enumerate(moved)]) for at, moved in enumerate(points)])
        tried = scored.select("n_tokens", *[f"p{i}" for i in range(k)], F.inline(each))
        sums = tried.groupBy("at").agg(*[F.sum(n * x * rate([F.col(f"m{i}") for i in range(k)])).alias(f"s{j}") for j, x in enumerate(p)])
        by = {r["at"]: [r[f"s{j}"] or 0.0 for j in range(k)] for r in sums.collect()}
        return np.array([by[at] for at in range(len(points))]) / tokens - share

    moved, off = np.zeros(k), present - share
    for weight in PULLS if pull is None else (pull,):
        if np.all(np.abs(off) <= MISS * present):
            break
        moved, off = _descend(moved, weight * present, gram, misses, present)
    if np.any(np.abs(off) > MISS * present):
        logging.getLogger(__name__).warning("token shares miss their targets by %s", off.tolist())
    return rate([F.lit(float(c)) for c in moved])


Slopes = Callable[[list[np.ndarray]], list[np.ndarray]]


def _descend(moved: np.ndarray, ridge: np.ndarray, gram: np.ndarray, misses: Callable[[list[np.ndarray]], np.ndarray], present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Projected gradient steps in conjugate directions: ``moved`` and the misses at it.

    The objective is sum(misses^2 / ridge) / 2 and the squared change of the rates from 1. A rate's gradient is its own change plus its posteriors times
    misses / ridge, so rates stay ``max(0, 1 - posteriors * moved)``: the projection of a point that k numbers
    describe, and a step needs k sums over the documents for each length it tries. It is scaled by the Gram matrix of the posteriors, which bounds the curvature
    whatever rates are 0; directions start anew where they point uphill.
    """

    def slopes(points: list[np.ndarray]) -> list[np.ndarray]:
        return [ridge * at - off for at, off in zip(points, misses(points), strict=True)]

    scale = np.linalg.inv(gram + np.diag(ridge))
    (slope,) = slopes([moved])
    way = -scale @ slope
    for _ in range(STEPS):
        if np.all(np.abs(slope) <= SLOPE * present):
            break
        moved, new = _along(moved, way, slopes)
        turned = max(0.0, new @ scale @ (new - slope) / (slope @ scale @ slope))
        slope, way = new, turned * way - scale @ new
        if way @ slope >= 0:
            way = -scale @ slope
    else:
        logging.getLogger(__name__).warning("the rates were still changing after %s steps: %s", STEPS, slope.tolist())
    return moved, ridge * moved - slope


def _along(start: np.ndarray, way: np.ndarray, slopes: Slopes) -> tuple[np.ndarray, np.ndarray]:
    """The point from ``start`` along ``way`` at which it points uphill least, with its slope: lengths double until it does, then those between are tried."""

    def tried(lengths: list[float]) -> list[tuple[float, float, np.ndarray]]:
        return [(slope @ way, length, slope) for length, slope in zip(lengths, slopes([start + x * way for x in lengths]), strict=True)]

    seen, length = [], 1.0
    while not seen or seen[-1][0] < 0 and math.isfinite(length):
        seen += tried([length * 2**i for i in range(TRIALS)])
        length *= 2**TRIALS
    last = min((x for up, x, _ in seen if up >= 0), default=seen[-1][1])
    first = max((x for up, x, _ in seen if up < 0 and x < last), default=0.0)
    seen += tried([first + (last - first) * i / TRIALS for i in range(1, TRIALS)])
    _, best, slope = min(seen, key=lambda x: (abs(x[0]), x[1]))
    return start + best * way, slope


def mixing_rates(docs: DataFrame, domains: DataFrame, weights: dict[str, float] | None = None, dropped: tuple[str, ...] = (), pull: float | None = None) -> DataFrame:
    """doc_id, n_tokens, a posterior column for each domain, and rate, for every row of ``docs``.

    ``weights`` are target shares of all tokens by domain (a domain not named gets 0). Without them the
    targets are the expected totals as they are, with 0 for the ``dropped`` domains.
    """
    model = fit(docs, domains)
    names = model[0]
    if not names:
        return docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_tokens"), F.lit(1.0).alias("rate"))
    scored = stored(score_documents(docs.select("doc_id", "text"), model), "mixing-scores")
    if weights is not None:
        rate = fit_rates(scored, None, [weights.get(n, 0.0) for n in names], pull)
    else:
        totals = scored.agg(*[F.sum(F.col("n_tokens") * F.col(f"p{i}")) for i in range(len(names))]).first()
        rate = fit_rates(scored, [0.0 if n in dropped else (t or 0.0) for n, t in zip(names, totals, strict=True)], pull=pull)
    return scored.select("doc_id", "n_tokens", *[F.round(f"p{i}", 9).alias(f"p_{n}") for i, n in enumerate(names)], F.round(rate, 9).alias("rate"))


def mixed(docs: DataFrame, domains: DataFrame, dropped: tuple[str, ...] = ("toxic",)) -> DataFrame:
    """``docs`` taken as often as their rates say, to the nearest whole number."""
    rates = mixing_rates(docs, domains, dropped=dropped, pull=WHOLE_PULL).groupBy("doc_id").agg(F.max("rate").alias("rate"))
    key, times = "_mixing_id", "_mixing_times"
    while key in docs.columns or times in docs.columns:
        key, times = f"{key}_", f"{times}_"
    taken = rates.select(F.col("doc_id").alias(key), F.floor(F.col("rate") + 0.5).cast("int").alias(times)).where(F.col(times) >= 1)
    joined = docs.join(taken, docs["doc_id"].eqNullSafe(taken[key]))
    return joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[docs[c] for c in docs.columns])
