"""Many logistic regressions in the same scans: all candidates and folds of a search advance together.

One scan forms, for every open model, its loss, gradient and curvature at its trial point as matrix products over blocks of
rows. The driver takes Newton steps; with an l1 share the step's quadratic problem is solved by coordinate descent and active sets, for all
models at once. Candidates that differ in their bound on steps share one path. The result is what one fit per candidate and fold would give.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import DataFrame

from spindlescope.ml.passes import block_sums

#: Numbers that a scan adds up at most; more models than fit take several scans per step.
MOST_NUMBERS = 1 << 23
TOLERANCE = 1e-9
#: Rounds of a step's quadratic problem, sweeps over the coordinates per round, and the change at which it is settled.
ROUNDS, SWEEPS, SETTLED = 12, 3, 1e-9
HALVINGS = 12
NO_FOLD = -1


@dataclasses.dataclass(frozen=True)
class Model:
    """``fold`` is left out of the fit; strength as ``c`` (regParam 1 / (c rows)) or none; ``l1``: share of the l1 penalty; ``mask``: columns used."""

    fold: int = NO_FOLD
    c: float | None = None
    l1: float = 0.0
    mask: tuple[bool, ...] | None = None


@dataclasses.dataclass(frozen=True)
class Moments:
    """Weight, mean and standard deviation of the rows that are not in a fold."""

    weight: np.ndarray
    rows: np.ndarray
    mean: np.ndarray
    std: np.ndarray


def moments(rows: DataFrame, d: int, folds: list[int], weight: str | None) -> tuple[np.ndarray, Moments]:
    """Mean of all rows, and per entry of ``folds`` the moments of the rows outside of it, about that mean."""
    def w_of(rest):
        return rest[weight] if weight else np.ones(len(rest["label"]))
    first = block_sums(rows, lambda x, rest: np.r_[w_of(rest).sum(), w_of(rest) @ x], d + 1)
    middle = first[1:] / max(first[0], 1e-300)

    def sums(x, rest):
        w, c = w_of(rest), x - middle
        out = []
        for f in folds:
            v = w * (rest["fold"] != f)
            out.append(np.r_[v.sum(), (v * v).sum(), (v > 0).sum(), v @ c, v @ (c * c)])
        return np.concatenate(out)
    s = block_sums(rows, sums, len(folds) * (2 * d + 3)).reshape(len(folds), -1)
    weight_sum = np.maximum(s[:, :1], 1e-300)
    mean = s[:, 3:3 + d] / weight_sum
    free = np.maximum(weight_sum - s[:, 1:2] / weight_sum, 1e-300)
    spread = np.maximum(s[:, 3 + d:] - weight_sum * mean * mean, 0.0)
    std = np.sqrt(spread / free)
    std[spread <= 1e-12 * np.maximum(s[:, 3 + d:], 1e-300)] = 0.0
    return middle, Moments(s[:, 0], s[:, 2], mean, std)


def _scan(rows: DataFrame, middle: np.ndarray, raw: np.ndarray, fold: np.ndarray, weight: str | None) -> np.ndarray:
    """Per model (row of ``raw``: coefficients on centred features, then the intercept): loss, gradient, upper curvature triangle."""
    m, width = raw.shape
    d = width - 1
    upper = np.triu_indices(width)
    size = 1 + width + len(upper[0])

    def sums(x, rest):
        c = np.hstack([x - middle, np.ones((len(x), 1))])
        w = rest[weight] if weight else np.ones(len(x))
        margin = c @ raw.T
        y = rest["label"][:, None]
        used = w[:, None] * (rest["fold"][:, None] != fold)
        p = 0.5 * (1.0 + np.tanh(0.5 * margin))
        out = np.empty((m, size))
        out[:, 0] = (used * (np.logaddexp(0.0, margin) - y * margin)).sum(axis=0)
        out[:, 1:1 + width] = (used * (p - y)).T @ c
        curve = used * p * (1.0 - p)
        for i in range(m):
            out[i, 1 + width:] = (c.T @ (c * curve[:, i:i + 1]))[upper]
        return out
    assert d == len(middle)
    return block_sums(rows, sums, m * size).reshape(m, size)


def _descend(g: np.ndarray, h: np.ndarray, b: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Steps that minimise g s + s'h s / 2 + l2 |b + s|^2 / 2 + l1 |b + s|, for all models at once.

    A few sweeps over the coordinates settle which coefficients are 0; a linear system then gives the best step with these
    and the signs of the others, and is followed until a sign would change.
    """
    width = b.shape[1]
    step, product = np.zeros_like(b), np.zeros_like(b)
    diagonal = np.maximum(np.einsum("mii->mi", h) + l2, 1e-300)
    full = h + l2[:, :, None] * np.eye(width)
    for _ in range(ROUNDS):
        start = step.copy()
        for j in [*range(width)] * SWEEPS:
            here = b[:, j] + step[:, j]
            slope = g[:, j] + product[:, j] + l2[:, j] * here
            aim = here - slope / diagonal[:, j]
            change = np.sign(aim) * np.maximum(np.abs(aim) - l1[:, j] / diagonal[:, j], 0.0) - here
            step[:, j] += change
            product += h[:, :, j] * change[:, None]
        here = b + step
        live = (here != 0) | (l1 == 0)
        pair = live[:, :, None] & live[:, None, :]
        system = np.where(pair, full, np.where(np.eye(width, dtype=bool), 1.0, 0.0))
        slope = g + product + l2 * here + l1 * np.sign(here)
        towards = np.linalg.solve(system, np.where(live, -slope, 0.0)[:, :, None])[:, :, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            flips = np.where(live & (l1 > 0) & (np.sign(here + towards) != np.sign(here)), -here / towards, 1.0)
        share = np.clip(np.nan_to_num(flips, nan=1.0).min(axis=1), 0.0, 1.0)
        step = step + share[:, None] * towards
        step = np.where(np.abs(b + step) <= 1e-15 * np.abs(b), -b, step)
        product = np.einsum("mij,mj->mi", h, step)
        if (np.abs(step - start) * np.sqrt(diagonal) < SETTLED).all():
            break
    return step


def fit_models(rows: DataFrame, models: list[Model], d: int, steps: list[int], weight: str | None = None) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Fit all ``models`` on stored rows (x, label, fold and perhaps ``weight``).

    Returns, for each bound in ``steps``, the coefficients on the raw features with the intercept last (models x (d + 1)), and the number
    of steps each model took. Penalties act on standardised features and not on the intercept; constant and masked
    columns get 0. A model ends when a step lowers its mean loss by less than TOLERANCE.
    """
    folds = sorted({m.fold for m in models})
    middle, stats = moments(rows, d, folds, weight)
    at = np.array([folds.index(m.fold) for m in models])
    mean, std, total = stats.mean[at], stats.std[at], np.maximum(stats.weight[at], 1e-300)
    used = (std > 0) & np.array([m.mask if m.mask is not None else (True,) * d for m in models], bool).reshape(len(models), d)
    scale = np.where(used, 1.0 / np.where(std > 0, std, 1.0), 0.0)
    strength = np.array([0.0 if m.c is None else 1.0 / (m.c * max(n, 1.0)) for m, n in zip(models, stats.rows[at])])
    share = np.array([m.l1 for m in models])
    n = len(models)
    l1 = np.hstack([np.repeat((strength * share)[:, None], d, 1), np.zeros((n, 1))])
    l2 = np.hstack([np.repeat((strength * (1 - share))[:, None], d, 1), np.zeros((n, 1))])
    turn = np.zeros((n, d + 1, d + 1))  # coefficients on standardised features -> on centred raw ones
    turn[:, np.arange(d), np.arange(d)] = scale
    turn[:, d, :d] = -mean * scale
    turn[:, d, d] = 1.0
    upper = np.triu_indices(d + 1)
    fold = np.array([m.fold for m in models])

    def evaluate(b, which):
        raw = np.einsum("mij,mj->mi", turn[which], b)
        out = []
        per = max(1, MOST_NUMBERS // (2 + d + len(upper[0])))
        for a in range(0, len(which), per):
            out.append(_scan(rows, middle, raw[a:a + per], fold[which[a:a + per]], weight))
        s = np.concatenate(out) / total[which, None]
        h = np.zeros((len(which), d + 1, d + 1))
        h[:, upper[0], upper[1]] = h[:, upper[1], upper[0]] = s[:, d + 2:]
        back = turn[which]
        grad = np.einsum("mji,mj->mi", back, s[:, 1:d + 2])
        h = np.einsum("mji,mjk,mkl->mil", back, h, back, optimize=True)
        value = s[:, 0] + (l1[which] * np.abs(b) + 0.5 * l2[which] * b * b).sum(axis=1)
        return value, grad, h

    def direction(b, grad, h, which):
        step = np.zeros_like(b)
        h = h + np.eye(d + 1) * (1e-12 * np.maximum(np.trace(h, axis1=1, axis2=2), 1e-12))[:, None, None]
        dead = ~np.hstack([used[which], np.ones((len(which), 1), bool)])
        h[dead[:, :, None] | dead[:, None, :]] = 0.0
        grad = np.where(dead, 0.0, grad)
        i, j = np.nonzero(dead)
        h[i, j, j] = 1.0
        smooth = ~(l1[which] > 0).any(axis=1)
        if smooth.any():
            k = np.flatnonzero(smooth)
            full = h[k] + np.einsum("mi,ij->mij", np.where(dead[k], 0.0, l2[which][k]), np.eye(d + 1))
            step[k] = np.linalg.solve(full, -(grad + np.where(dead, 0.0, l2[which]) * b)[k][:, :, None])[:, :, 0]
        if not smooth.all():
            k = np.flatnonzero(~smooth)
            step[k] = _descend(grad[k], h[k], b[k], l1[which][k], l2[which][k])
        return step

    b = np.zeros((n, d + 1))
    taken = np.zeros(n, int)
    kept = {}
    which = np.arange(n)
    value, grad, h = evaluate(b, which)
    step = direction(b, grad, h, which)
    size, tries = np.ones(n), np.zeros(n, int)
    bounds = sorted(set(steps))
    while len(which):
        trial = b[which] + size[which, None] * step
        new, grad, h = evaluate(trial, which)
        better = new <= value[which] + 1e-14 * np.abs(value[which])
        gain = value[which] - new
        now = which[better]
        b[now], value[now] = trial[better], new[better]
        taken[now] += 1
        tries[now] = 0
        size[which[~better]] *= 0.5
        tries[which[~better]] += 1
        for limit in bounds:
            hit = now[taken[now] == limit]
            if len(hit):
                kept.setdefault(limit, b.copy())[hit] = b[hit]
        ended = (better & (gain <= TOLERANCE * np.maximum(1.0, np.abs(new)))) | (tries[which] > HALVINGS) | (taken[which] >= bounds[-1])
        fresh = np.zeros_like(step)
        go = better & ~ended
        if go.any():
            fresh[go] = direction(b[which[go]], grad[go], h[go], which[go])
            size[which[go]] = 1.0
        step = np.where(better[:, None], fresh, step)[~ended]
        which = which[~ended]
    out = {}
    for limit in bounds:
        at_limit = np.where((taken >= limit)[:, None], kept.get(limit, b), b)
        raw = np.einsum("mij,mj->mi", turn, at_limit)
        raw[:, d] -= raw[:, :d] @ middle
        out[limit] = raw
    return out, taken


def confusions(rows: DataFrame, coefficients: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Per model tp, fp, tn, fn on the rows of its own fold; a positive margin predicts 1."""
    def count(x, rest):
        said = x @ coefficients[:, :-1].T + coefficients[:, -1] > 0
        y = rest["label"][:, None] == 1
        own = rest["fold"][:, None] == fold
        return np.stack([(own & a).sum(axis=0) for a in (said & y, said & ~y, ~said & ~y, ~said & y)], axis=1)
    return block_sums(rows, count, 4 * len(coefficients)).reshape(-1, 4)


def f1_scores(cells: np.ndarray) -> np.ndarray:
    tp, fp, _, fn = cells.T
    return np.where(tp > 0, 2 * tp / np.maximum(2 * tp + fp + fn, 1), 0.0)


def accuracies(cells: np.ndarray) -> np.ndarray:
    return (cells[:, 0] + cells[:, 2]) / np.maximum(cells.sum(axis=1), 1)


#: The l1 share of each penalty name.
L1_SHARE = {"l1": 1.0, "l2": 0.0, "elasticnet": 0.5, "none": 0.0}


def cross_validated(rows: DataFrame, combos: list[dict], d: int, folds: int, weight: str | None = None) -> np.ndarray:
    """Mean F1 of each combination of C, penalty and maxIter over the folds 0 to ``folds`` - 1 of the stored rows."""
    paths: dict[tuple, int] = {}
    for c in combos:
        penalty = c.get("penalty", "l2")
        paths.setdefault((None if penalty == "none" else float(c.get("C", 1.0)), L1_SHARE[penalty]), len(paths))
    models = [Model(f, c, l1) for c, l1 in paths for f in range(folds)]
    limits = sorted({int(c.get("maxIter", 100)) for c in combos})
    fitted, taken = fit_models(rows, models, d, limits, weight)
    fold = np.array([m.fold for m in models])
    scores = {}
    for limit in limits:
        if limit > limits[0] and taken.max() <= limits[0]:
            scores[limit] = scores[limits[0]]
        else:
            scores[limit] = f1_scores(confusions(rows, fitted[limit], fold)).reshape(len(paths), folds).mean(axis=1)
    out = []
    for c in combos:
        penalty = c.get("penalty", "l2")
        out.append(scores[int(c.get("maxIter", 100))][paths[None if penalty == "none" else float(c.get("C", 1.0)), L1_SHARE[penalty]]])
    return np.array(out)


def mask_accuracies(rows: DataFrame, masks: list[tuple[bool, ...]], d: int, folds: int, max_iter: int = 100) -> np.ndarray:
    """Mean accuracy over the folds of an unpenalised model per mask of columns, all in the same scans."""
    models = [Model(f, mask=m) for m in masks for f in range(folds)]
    fitted, _ = fit_models(rows, models, d, [max_iter])
    cells = confusions(rows, fitted[max_iter], np.array([m.fold for m in models]))
    return accuracies(cells).reshape(len(masks), folds).mean(axis=1)
