"""Hyper-parameter search (H1, H2).  Candidates are plain parameter dicts;
evaluation reuses one set of per-fold statistics (linear family) or MLlib's
``CrossValidator`` with a fold column (trees), so no candidate re-reads the
raw rows for its own preprocessing."""

from __future__ import annotations

import itertools
import math
import random


def grid(space: dict) -> list[dict]:
    """H1: Cartesian product of the listed values."""
    keys = list(space)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[space[k] for k in keys])]


def _draw(rng: random.Random, spec, centre=None, shrink: float = 1.0):
    kind = spec[0]
    if kind == "choice":
        return rng.choice(spec[1])
    lo, hi = spec[1], spec[2]
    if kind == "log-uniform":
        a, b = math.log(lo), math.log(hi)
        if centre is not None:
            half = (b - a) * shrink / 2
            c = math.log(centre)
            a, b = max(a, c - half), min(b, c + half)
        return math.exp(rng.uniform(a, b))
    if kind == "uniform":
        if centre is not None:
            half = (hi - lo) * shrink / 2
            lo, hi = max(lo, centre - half), min(hi, centre + half)
        return rng.uniform(lo, hi)
    if kind == "int":
        if centre is not None:
            half = max(1, int((hi - lo) * shrink / 2))
            lo, hi = max(lo, centre - half), min(hi, centre + half)
        return rng.randint(int(lo), int(hi))
    raise ValueError(kind)


def sample(space: dict, n: int, seed: int = 42, centre: dict | None = None,
           shrink: float = 1.0) -> list[dict]:
    """Seeded draws from a space of ``(kind, ...)`` specs: ``log-uniform``,
    ``uniform``, ``int`` (inclusive) and ``choice``."""
    rng = random.Random(seed)
    return [{k: _draw(rng, s, None if centre is None else centre.get(k), shrink) for k, s in space.items()}
            for _ in range(n)]


def search(evaluate, space: dict, n_iter: int = 30, rounds: int = 2, seed: int = 42):
    """H2: ``n_iter`` candidates split over ``rounds``; round 1 samples the
    whole space, later rounds sample a shrinking box around the best so far.
    ``evaluate(list[dict]) -> list[float]`` (lower is better) is called once
    per round, so a round is one batch of Spark work.  Returns
    ``(best_params, best_score, history)``; ties keep the earlier candidate."""
    history = []
    per = [n_iter // rounds + (1 if i < n_iter % rounds else 0) for i in range(rounds)]
    best, best_score = None, math.inf
    for r, m in enumerate(per):
        if m == 0:
            continue
        cands = sample(space, m, seed + r, centre=best, shrink=0.5 ** r) if best else sample(space, m, seed)
        scores = evaluate(cands)
        for c, s in zip(cands, scores):
            history.append((r, c, s))
            if s < best_score:
                best, best_score = c, s
    return best, best_score, history
