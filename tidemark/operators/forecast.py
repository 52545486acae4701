"""Forecasters: from the last values of a series to the next ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any, Protocol

import numpy as np

CHUNK = 64
CONTEXT = 512


class Forecaster(Protocol):
    """``predict`` gives ``steps`` values that follow the context; ``name`` labels the method.

    ``context`` is the number of values it looks at; no more are collected for it. A
    ``ValueError`` says that this context can't be forecast: the period is left out. A
    forecaster may also have ``predict_many(contexts, steps)`` for many at once, see :class:`Batched`.
    """

    name: str
    version: str
    context: int

    def predict(self, context: np.ndarray, steps: int) -> np.ndarray: ...


class Batched(Protocol):
    """A forecaster that takes many contexts in one call and gives as many arrays, None for one it rejects.

    Contexts come as rows of one matrix, right-aligned, with NaN before shorter ones, and
    their lengths; ``steps`` differ by row. A ``ValueError`` says nothing about single rows: they are asked for one by one.
    """

    def predict_many(self, contexts: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> Sequence[np.ndarray | None]: ...


class LastValue:
    """Repeats the last value of the context, a missing one too."""

    name, version, context = "last-value", "1", 1

    def predict(self, context: np.ndarray, steps: int) -> np.ndarray:
        return np.full(steps, context[-1])

    def predict_many(self, contexts: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> Sequence[np.ndarray | None]:
        return [np.full(n, last) for last, n in zip(contexts[:, -1], steps, strict=True)]


class Drift:
    """Goes on along the line from the first to the last reading of the context."""

    name, version, context = "drift", "1", CONTEXT

    def predict(self, context: np.ndarray, steps: int) -> np.ndarray:
        known = np.flatnonzero(~np.isnan(context))
        if len(known) == 0:
            return np.full(steps, np.nan)
        slope = (context[known[-1]] - context[known[0]]) / (known[-1] - known[0]) if len(known) > 1 else 0.0
        return context[known[-1]] + slope * (len(context) - 1 - known[-1] + np.arange(1, steps + 1))

    def predict_many(self, contexts: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> Sequence[np.ndarray | None]:
        known, width = ~np.isnan(contexts), contexts.shape[1]
        rows = np.arange(len(contexts))
        first, last = known.argmax(1), width - 1 - known[:, ::-1].argmax(1)
        near = np.where(known.any(1), contexts[rows, last], np.nan)
        slope = np.where(last > first, (contexts[rows, last] - contexts[rows, first]) / np.maximum(last - first, 1), 0.0)
        return [v + k * (width - 1 - at + np.arange(1, n + 1)) for v, k, at, n in zip(near, slope, last, steps, strict=True)]


class SeasonalNaive:
    """Repeats the last whole season of the context."""

    version = "1"

    def __init__(self, season: int):
        self.season, self.name, self.context = season, f"seasonal-naive-{season}", season

    def predict(self, context: np.ndarray, steps: int) -> np.ndarray:
        season = context[-min(self.season, len(context)) :]
        return season[np.arange(steps) % len(season)]

    def predict_many(self, contexts: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> Sequence[np.ndarray | None]:
        return [self.predict(x[len(x) - size :], n) for x, size, n in zip(contexts, lengths, steps, strict=True)]


_models: dict[tuple[str, str], Any] = {}


class QuantileModel:
    """A model with ``predict_quantiles`` (mean first), loaded once for each Python worker.

    With ``batched`` the model takes a matrix of contexts, NaN before shorter ones; all are
    forecast as far as the one that needs most, and cut.
    """

    context = CONTEXT

    def __init__(self, name: str, load: Callable[[str, str], Any], device: str = "cpu", version: str = "1", batched: bool = False):
        self.name, self.version, self.load, self.device = name, version, load, device
        if batched:
            self.predict_many = self._many

    def _mean(self, inputs: np.ndarray, steps: int) -> np.ndarray:
        key = (self.name, self.device)
        if key not in _models:
            _models[key] = self.load(*key)
        _, mean = _models[key].predict_quantiles(inputs=inputs, prediction_length=steps, quantile_levels=[0.1, 0.5, 0.9])
        return mean

    def predict(self, context: np.ndarray, steps: int) -> np.ndarray:
        return np.asarray(self._mean(context, steps)[0], float)

    def _many(self, contexts: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> Sequence[np.ndarray | None]:
        mean = self._mean(contexts, int(steps.max()))
        return [np.asarray(m, float)[:n] for m, n in zip(mean, steps, strict=True)]


def clear_models() -> None:
    _models.clear()


def padded(contexts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts as rows of one matrix, right-aligned, NaN before shorter ones; and their lengths."""
    lengths = np.array([len(x) for x in contexts])
    out = np.full((len(contexts), int(lengths.max(initial=0))), np.nan)
    for row, x in zip(out, contexts, strict=True):
        row[len(row) - len(x) :] = x
    return out, lengths


def takes_many(model: Forecaster) -> bool:
    """Whether the forecaster's own ``predict_many`` may be used: not one that it inherits beside a ``predict`` of its own."""
    if "predict_many" in vars(model):
        return True
    return next(("predict_many" in vars(c) for c in type(model).__mro__ if vars(c).keys() & {"predict", "predict_many"}), False)


def predict_each(model: Forecaster, contexts: Sequence[np.ndarray], steps: Sequence[int]) -> list[np.ndarray | None]:
    """One forecast for each context, None for those the forecaster rejects; in one call where it takes many."""
    got: Sequence[np.ndarray | None] | None = None
    if takes_many(model) and contexts:
        try:
            got = model.predict_many(*padded(contexts), np.array(steps))
        except ValueError:
            got = None
    if got is None:
        got = []
        for x, n in zip(contexts, steps, strict=True):
            try:
                got.append(np.asarray(model.predict(x, n), float))
            except ValueError:
                got.append(None)
    # One that is too short or too long is rejected too.
    return [None if y is None or len(y) != n else np.asarray(y, float) for y, n in zip(got, steps, strict=True)]


def forward_many(model: Forecaster, contexts: Sequence[np.ndarray], steps: Sequence[int], chunk: int = CHUNK, limit: int = CONTEXT) -> list[np.ndarray | None]:
    """The values after each context in waves: the next chunk of all that aren't done in one call, each seeing its own chunks before."""
    seen: list[np.ndarray | None] = [np.asarray(x, float) for x in contexts]
    out: list[np.ndarray | None] = [np.zeros(0) for _ in contexts]
    open_ = [i for i, n in enumerate(steps) if n > 0]
    while open_:
        asked = [min(chunk, steps[i] - len(out[i])) for i in open_]
        some = predict_each(model, [seen[i][-limit:] for i in open_], asked)
        for i, y in zip(open_, some, strict=True):
            out[i] = None if y is None else np.concatenate([out[i], y])
            seen[i] = None if y is None else np.concatenate([seen[i], y])[-limit:]
        open_ = [i for i in open_ if out[i] is not None and len(out[i]) < steps[i]]
    return out


def forward(model: Forecaster, context: np.ndarray, steps: int, chunk: int = CHUNK, limit: int = CONTEXT) -> np.ndarray:
    """``steps`` values after the context, at most ``chunk`` at once, each chunk seeing those before."""
    seen, out = np.asarray(context, float), np.zeros(0)
    while len(out) < steps:
        asked = min(chunk, steps - len(out))
        some = np.asarray(model.predict(seen[-limit:], asked), float)
        if len(some) != asked:
            raise ValueError(f"{model.name} gave {len(some)} values of {asked}")
        out, seen = np.concatenate([out, some]), np.concatenate([seen, some])
    return out[:steps]


def backward(model: Forecaster, context: np.ndarray, steps: int, chunk: int = CHUNK, limit: int = CONTEXT) -> np.ndarray:
    """``steps`` values before the context, forecast on the reversed series."""
    return forward(model, np.asarray(context, float)[::-1], steps, chunk, limit)[::-1]
