"""Mixing to target weights by soft membership.

A classifier fitted on a labelled table gives each document a posterior over the domains.
A document with ``n`` tokens and posterior ``p`` at rate ``r`` brings ``r n p_k`` expected
tokens to domain ``k``.  Projected-gradient least squares fits rates ``r >= 0`` that bring
the domains' totals ``t`` as near as can be to ``budget * weight``.  Weighted by tokens, the
gradient of a document's rate is ``p . gap`` (``gap = t - goal``); a round moves every rate
by ``-p . step``, with the momentum of the round before, and clips it at zero.  The step is
the gradient over the largest eigenvalue of the token matrix ``sum n p p'``; one aggregate
also tries lengths of the gradient scaled by the inverse of the matrix of the documents
that are still above zero, and the best is taken.  The fit ends when the gap is closed, or
when the duality gap proves that no rates come nearer by more than ``near`` of the budget;
it raises if neither happens.  Rates are functions of the steps so far, so that no state of
a document is kept between rounds.

Tokens are words (runs of letters) here, and the targets are shares of those.

``copies`` of a document: the whole part of its rate, and one more with the chance of the
rest, decided by a hash of its id (the same on every run).

Defined cases: a null text, or one without letters, has a flat posterior and no tokens; a
domain with a target but without documents keeps its share of the budget and stays short;
a domain without a target aims at zero; without labelled rows, without targets, or with an
empty table, all rates are one; repeated rows each have their rate, rows with a null id
too; a long text counts with all its words; equal posteriors go to the first domain by
name; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import staged
from graphloom.llm.language import Model, fit, predict

#: Shares of the tokens that the registered query and the pipeline aim at.
TARGETS = {"de": 0.2, "en": 0.45, "es": 0.15, "fr": 0.2}


def memberships(docs: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep``, ``n_tokens`` (words) and ``p`` (posterior in the order of ``model.langs``) of every document."""
    told = predict(docs, model, *keep, text=text, posterior=True)
    return told.select(*keep, F.col("n_words").alias("n_tokens"), F.col("posterior").alias("p"))


def moved(rate: F.Column, step: np.ndarray, before: F.Column | None = None, momentum: float = 0.0) -> F.Column:
    """A rate after one step (with ``momentum`` times what it rose from ``before``), clipped at zero."""
    from_here = rate if before is None else rate + F.lit(momentum) * (rate - before)
    return F.greatest(F.lit(0.0), from_here - sum((F.get("p", k) * F.lit(float(x)) for k, x in enumerate(step)), F.lit(0.0)))


def with_rates(members: DataFrame, steps: list[tuple[float, np.ndarray]]) -> DataFrame:
    """``members`` with ``rate`` after ``steps`` (momentum, step), from one, and ``before``, that of the step before."""
    if not steps:
        return members.withColumns({"rate": F.lit(1.0), "before": F.lit(1.0)})
    k = len(steps[0][1])
    told = F.array(*[F.struct(F.lit(float(m)).alias("m"), *[F.lit(float(x)).alias(f"x{i}") for i, x in enumerate(v)]) for m, v in steps])

    def after(state, step):
        y = state["rate"] + step["m"] * (state["rate"] - state["before"]) - sum((F.get("p", i) * step[f"x{i}"] for i in range(k)), F.lit(0.0))
        return F.struct(F.greatest(F.lit(0.0), y).alias("rate"), state["rate"].alias("before"))

    state = F.aggregate(told, F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("before")), after)
    return members.withColumn("_state", state).select("*", "_state.rate", "_state.before").drop("_state")


@dataclass
class Rates:
    """Steps of a fit, the expected totals that they lead to, and the totals aimed at."""

    steps: list[tuple[float, np.ndarray]]
    totals: np.ndarray
    goal: np.ndarray

    @property
    def gap(self) -> float:
        """The distance that is left."""
        return float(np.linalg.norm(self.totals - self.goal))


def fit_rates(
    members: DataFrame, domains: list[str], targets: dict[str, float], budget: float | None = None, rounds: int = 400, close: float = 1e-4, near: float = 0.01
) -> Rates:
    """Rates that bring ``members`` (``n_tokens, p``) to ``targets`` (shares, made to add up to one).

    ``close``: the gap that is good enough; ``near``: how far from the best it may be where
    the targets can't be met; both of the budget.
    """
    k = len(domains)
    nothing = Rates([], np.zeros(k), np.zeros(k))
    whole = sum(max(v, 0.0) for v in targets.values())
    if not k or whole <= 0:
        return nothing
    w, share = F.col("n_tokens").cast("double"), [F.get("p", i) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = members.agg(F.sum(w).alias("n"), *[F.sum(w * share[i]).alias(f"t{i}") for i in range(k)], *[F.sum(w * share[i] * share[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    if not row["n"]:
        return nothing

    def matrix(row) -> np.ndarray:
        return np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])

    goal = np.array([max(targets.get(d, 0.0), 0.0) / whole for d in domains]) * (budget or row["n"])
    most = float(np.linalg.eigvalsh(matrix(row))[-1])
    totals = past = np.array([row[f"t{i}"] for i in range(k)])
    steps: list[tuple[float, np.ndarray]] = []
    pace = 1.0
    for _ in range(rounds):
        gap = totals - goal
        if np.abs(gap).max() <= close * goal.sum():
            return Rates(steps, totals, goal)
        here = with_rates(members, steps)
        slope = sum((share[i] * F.lit(float(gap[i])) for i in range(k)), F.lit(0.0))
        free = (F.col("rate") > 0) | (slope < 0)
        row = here.where(w > 0).agg(F.min(slope).alias("least"), *[F.sum(F.when(free, w * share[i] * share[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
        dual = totals @ gap - min(0.0, row["least"]) * np.sqrt(k) * np.linalg.norm(goal)
        if np.linalg.norm(gap) - np.sqrt(max(0.0, gap @ gap - 2 * dual)) <= near * goal.sum():
            return Rates(steps, totals, goal)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        momentum = (pace - 1) / faster
        newton = np.linalg.pinv(matrix(row), rcond=1e-9, hermitian=True) @ gap
        tries = [(momentum, (totals + momentum * (totals - past) - goal) / most), (0.0, gap / most), *((0.0, newton * 2.0**-e) for e in range(6))]
        after = [moved(F.col("rate"), x, F.col("before"), m) for m, x in tries]
        got = here.agg(*[F.sum(w * share[i] * r).alias(f"t{c}_{i}") for c, r in enumerate(after) for i in range(k)]).first()
        after = [np.array([got[f"t{c}_{i}"] for i in range(k)]) for c in range(len(tries))]
        square = [float(((x - goal) ** 2).sum()) for x in after]
        best = int(np.argmin(square))
        if best and square[0] < gap @ gap and square[best] > 0.5 * square[0]:
            best = 0  # the momentum goes on unless another step is far better
        pace = 1.0 if best else faster
        steps.append(tries[best])
        totals, past = after[best], totals
    raise RuntimeError(f"the rates have not converged in {rounds} rounds: totals {totals.tolist()}, goal {goal.tolist()}")


def rated(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *keep: str, key: str = "doc_id", text: str = "text", budget: float | None = None
) -> DataFrame:
    """The columns ``keep`` (``key`` among them) with ``n_tokens, domain, rate, copies`` of every document; ``labelled`` has ``doc_id, text, lang``."""
    model = fit(labelled)
    members = staged(memberships(docs, model, *keep, text=text), "members")
    rates = with_rates(members, fit_rates(members, model.langs, targets, budget).steps)
    chance = F.pmod(F.xxhash64(F.lit("mix"), key), F.lit(1 << 32)) / float(1 << 32)
    best = F.array_position("p", F.array_max("p"))
    domain = F.get(F.array(*[F.lit(d) for d in model.langs]).cast("array<string>"), (best - 1).cast("int"))
    return rates.withColumn("rate", F.round("rate", 9)).select(
        *keep, "n_tokens", domain.alias("domain"), "rate",
        (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int").alias("copies"),
    )


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None) -> DataFrame:
    """``doc_id, n_tokens, domain, rate, copies`` of every document."""
    return rated(docs.select("doc_id", "text"), labelled, targets, "doc_id", budget=budget)
