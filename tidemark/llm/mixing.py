"""Document rates that bring soft domain memberships to target weights."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import linear
from tidemark.llm.store import discard, plain_names, stored
from tidemark.llm.words import SPACED, slices, words_of

#: Share of the token total that each domain should get.
TARGETS = {"prime": 0.97, "rough": 0.02, "toxic": 0.01}
#: Share of the token total by which a domain may miss its target, and the least fall of the squared distance that makes a pass worth another.
TOLERANCE, PROGRESS = 5e-4, 1e-2
#: Passes after which rates are stored, so that a pass repeats fewer steps than that.
STORED = 32
_log = logging.getLogger(__name__)


def labelled_domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of the labelled table: toxic, else rough (quality 0), else prime."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("toxic") == 1, "toxic").when(
        F.col("quality") == 0, "rough").when(F.col("quality") == 1, "prime").alias("domain")).filter("domain is not null")


def with_posteriors(docs: DataFrame, domains: DataFrame, names: list[str], sample_rows: int = linear.SAMPLE_ROWS) -> DataFrame:
    """The documents with ``_tokens`` (words between white space) and ``_posterior`` (of ``names``, summing to one)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    number = F.create_map(*[x for k, name in enumerate(names) for x in (F.lit(name), F.lit(k))])
    marked = domains.filter(F.col("domain").isin(names) & ~linear.held_out()).select("doc_id", number[F.col("domain")].alias("label"))
    weights = docs.sparkSession.sparkContext.broadcast(linear.fit(rows, len(names), sample_rows, presence=True, marks=marked))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                p = linear.sigmoid(linear.margins(text, weights.value, presence=True))
                p = (p / p.sum(axis=0)).T
                offsets = pa.array(np.arange(len(text) + 1) * len(names), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.diff(words_of(text, SPACED).first), pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(p).reshape(-1)))],
                    [*part.schema.names, "_tokens", "_posterior"])

    return docs.mapInArrow(judge, T.StructType([
        *docs.schema.fields, T.StructField("_tokens", T.LongType()), T.StructField("_posterior", T.ArrayType(T.DoubleType()))]))


def rate(steps: list[list[float]], posterior: str = "_posterior", start: Column | None = None) -> Column:
    """A document's rate after projected steps: from 1 (or ``start``), minus its memberships times each step, at least 0."""
    start = F.lit(1.0) if start is None else start
    if not steps:
        return start
    moves = F.expr(f"array({', '.join('array(' + ', '.join(f'{float(u)!r}D' for u in step) + ')' for step in steps)})")
    width = len(steps[0])
    return F.aggregate(moves, start, lambda r, u: F.greatest(
        F.lit(0.0), r - sum((F.col(posterior)[k] * u[k] for k in range(width)), F.lit(0.0))))


def fit_rates(soft: DataFrame, targets: list[float], total: float | None = None, max_steps: int | None = None,
              tolerance: float = TOLERANCE, progress: float = PROGRESS, keep: int = STORED) -> list[list[float]]:
    """Steps of projected-gradient least squares on ``_tokens, _posterior`` rows.

    Minimises the squared distance of the expected domain totals
    ``sum(rate * _tokens * posterior)`` from ``total`` times the targets over
    nonnegative rates, starting at 1.  The gradient by a document is its
    memberships times the residuals; both are scaled by the domains' capacity,
    for which a step of one is stable.  A pass is one aggregate of one number
    per domain over a table of tokens, memberships and rates alone.  A
    document's rate follows from its memberships and the steps; rates are stored
    every ``keep`` passes, so a pass costs the same however many came before.

    Passes go on until every domain is within ``tolerance`` of its target, or
    the squared distance, which never rises, falls by less than ``progress`` of itself:
    memberships may not allow the targets.  The domain shares that are reached
    are logged, as a warning where they miss the targets; ``domain_shares``
    gives them for any rates.
    """
    width = len(targets)
    shares = targets / np.sum(targets)

    # Rows of no tokens add nothing to any total.
    held = stored(soft.select("_tokens", "_posterior", F.lit(1.0).alias("_rate")).filter("_tokens > 0"), "rates")

    def totals(steps: list[list[float]]) -> np.ndarray:
        r = rate(steps, start=F.col("_rate"))
        row = held.agg(*[F.sum(r * F.col("_tokens") * F.col("_posterior")[k]) for k in range(width)]).first()
        return np.array([x or 0.0 for x in row], float)

    capacity = totals([])
    if not capacity.sum():
        discard(held)
        return []
    goal = shares * (capacity.sum() if total is None else total)
    steps: list[list[float]] = []
    now = capacity
    scale = np.maximum(capacity, 1e-9 * capacity.sum())
    distance = np.inf
    while np.abs(now - goal).max() > tolerance * goal.sum() and (max_steps is None or len(steps) < max_steps):
        before, distance = distance, float(((now - goal) ** 2 / scale).sum())
        if distance > before * (1 - progress):
            break
        steps.append(list((now - goal) / scale))
        if len(steps) % keep == 0:
            last, held = held, stored(held.withColumn("_rate", rate(steps[-keep:], start=F.col("_rate"))), "rates")
            discard(last)
        now = totals(steps[len(steps) // keep * keep:])
    discard(held)
    missed = np.abs(now - goal).max() / goal.sum()
    _log.log(logging.WARNING if missed > tolerance else logging.INFO, "domain shares %s for targets %s after %d passes",
             np.round(now / goal.sum(), 5).tolist(), np.round(shares, 5).tolist(), len(steps))
    return steps


def domain_shares(rated: DataFrame, names: list[str]) -> DataFrame:
    """Expected share of all tokens of each domain under ``rate``: ``domain, share``; takes what ``mix`` returns."""
    held = rated.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{name}")).alias(name) for name in names])
    whole = sum((F.col(name) for name in names), F.lit(0.0))
    return held.select(F.explode(F.array(*[F.struct(F.lit(name).alias("domain"), (F.col(name) / F.nullif(whole, F.lit(0.0))).alias("share"))
                                           for name in names])).alias("d")).select("d.*")


def with_rates(docs: DataFrame, domains: DataFrame, targets: dict[str, float], total: float | None = None,
               sample_rows: int = linear.SAMPLE_ROWS, with_text: bool = True) -> DataFrame:
    """The documents with ``_tokens, _posterior, _rate, _copies``.

    Texts are judged once; what was judged is stored, with the texts unless
    ``with_text`` is false, and read by the passes and by the result.
    ``_copies`` is the rate rounded down or up by a hash of id and text, so its
    expectation is the rate and every run decides alike.
    """
    names = list(targets)
    chance = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    judged = with_posteriors(docs, domains, names, sample_rows).withColumn("_chance", chance)
    judged = stored(judged if with_text else judged.drop("text"), "memberships")
    steps = fit_rates(judged.select("_tokens", "_posterior"), [targets[n] for n in names], total)
    return judged.withColumn("_rate", rate(steps)).withColumn(
        "_copies", (F.floor("_rate") + (F.col("_chance") < F.col("_rate") - F.floor("_rate")).cast("long")).cast("long"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample_rows: int = linear.SAMPLE_ROWS) -> DataFrame:
    """Rates of documents: ``doc_id, n_tokens, p_<domain>..., rate, copies``, one row per input row.

    Takes ``doc_id, text`` and ``doc_id, quality, toxic``; other columns are
    ignored.  A classifier learnt from the labelled table (at most
    ``sample_rows`` rows that are not held out) gives each document a
    membership in every domain of ``targets``; the token total stays as it is
    and is divided as the targets say.

    Null and empty texts have no tokens and weigh nothing; they get the rate
    their (constant) memberships give.  Rows of equal id and text get equal
    rates.  Where memberships do not allow the targets, the rates come as near
    as they do (see ``fit_rates``).  Without labels the memberships are equal, and rates stay at what
    those allow; without documents the result is empty.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = with_rates(docs, labelled_domains(labels), targets, None, sample_rows, with_text=False)
    return out.select("doc_id", F.col("_tokens").alias("n_tokens"), *[
        F.col("_posterior")[k].alias(f"p_{name}") for k, name in enumerate(targets)],
        F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float]) -> DataFrame:
    """The documents, each as often as its copies say; columns as they were."""
    docs, restore = plain_names(docs)
    out = with_rates(docs, labelled_domains(labels), targets)
    return restore(out.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))))
