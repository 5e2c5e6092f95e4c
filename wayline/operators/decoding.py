"""State-space decoding of position from spikes.

Place fields and likelihoods are joins and sums over (time bin, cell, position
bin). The filter and the smoother are recurrences over time: sessions, and chunks of a
long one, run side by side, and only a vector of states goes from chunk to chunk.
Transitions are applied, not multiplied out, so hundreds of states cost no table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions.circular import ratio
from wayline.operators.sequence import framed, previous, scan_chunks


def transitions(states: DataFrame, n_bins: int, spread: float) -> DataFrame:
    """``a, b, p``: transition probabilities from counts of successive states, each with ``spread`` added."""
    steps = previous(states, F.col("s"), "__p").where("__p is not null")
    counts = steps.groupBy(F.col("__p").alias("a"), F.col("s").alias("b")).agg(F.count("*").alias("n"))
    spark = states.sparkSession
    grid = spark.range(n_bins * n_bins).select(F.floor(F.col("id") / n_bins).cast("int").alias("a"), (F.col("id") % n_bins).cast("int").alias("b"))
    dense = grid.join(F.broadcast(counts), ["a", "b"], "left").select("a", "b", (F.coalesce("n", F.lit(0)) + spread).alias("n"))
    rows = dense.groupBy("a").agg(F.sum("n").alias("t"))
    return dense.join(F.broadcast(rows), "a").select("a", "b", (F.col("n") / F.col("t")).alias("p"))


def log_likelihood(counts: DataFrame, fields: DataFrame, dt: float) -> DataFrame:
    """``t, gx, ll``: Poisson log likelihood of each position bin in each time bin, without the term of the counts alone.

    ``counts`` has ``t, cell, n`` of what fired, ``fields`` ``cell, gx, rate`` with
    rates above 0. Cells that did not fire enter by the fields' sums.
    """
    silent = fields.groupBy("gx").agg((-F.sum("rate") * dt).alias("silent"))
    fired = counts.join(fields, "cell").groupBy("t", "gx").agg(F.sum(F.col("n") * F.ln(F.col("rate") * dt)).alias("fired"))
    return fired.join(F.broadcast(silent), "gx").select("t", "gx", (F.col("fired") + F.col("silent")).alias("ll"))


def map_decode(ll: DataFrame) -> DataFrame:
    """``t, gx``: the likeliest position bin; ties to the smaller."""
    return ll.groupBy("t").agg(F.min(F.struct((-F.col("ll")).alias("ll"), "gx")).alias("m")).select("t", F.col("m.gx").alias("gx"))


class Moves:
    """Transitions between states, applied without a table of all pairs where their kind allows."""

    size: int

    def onward(self, p: np.ndarray) -> np.ndarray:
        """Where probabilities ``p`` of states are a step later."""
        raise NotImplementedError

    def back(self, v: np.ndarray) -> np.ndarray:
        """For each state the mean of ``v`` over where it leads."""
        raise NotImplementedError


class Table(Moves):
    """``moves[a][b]``: the probability to go from a to b."""

    def __init__(self, moves: list[list[float]] | np.ndarray) -> None:
        self.moves = np.array(moves, float)
        self.size = len(self.moves)

    def onward(self, p: np.ndarray) -> np.ndarray:
        return self.moves.T @ p

    def back(self, v: np.ndarray) -> np.ndarray:
        return self.moves @ v


class Walk(Moves):
    """A normal step along a line of bins; the same sums as of :func:`random_walk`'s table, by convolution."""

    def __init__(self, n_bins: int, size: float, variance: float) -> None:
        self.size = n_bins
        at = np.arange(1 - n_bins, n_bins) * size
        taps = np.exp(-0.5 * at * at / variance)
        reach = int(np.flatnonzero(taps > 0).max()) - (n_bins - 1)  # further steps are 0 in double precision
        self.taps = taps[n_bins - 1 - reach : n_bins + reach]
        self.sums = self._around(np.ones(n_bins))

    def _around(self, v: np.ndarray) -> np.ndarray:
        r = len(self.taps) // 2
        return np.convolve(v, self.taps)[r : r + self.size]

    def onward(self, p: np.ndarray) -> np.ndarray:
        return self._around(p / self.sums)

    def back(self, v: np.ndarray) -> np.ndarray:
        return self._around(v) / self.sums


class Anywhere(Moves):
    """Every bin alike."""

    def __init__(self, n_bins: int) -> None:
        self.size = n_bins

    def onward(self, p: np.ndarray) -> np.ndarray:
        return np.full(self.size, p.sum() / self.size)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.full(self.size, v.mean())


class Same(Moves):
    """No move."""

    def __init__(self, n_bins: int) -> None:
        self.size = n_bins

    def onward(self, p: np.ndarray) -> np.ndarray:
        return p

    def back(self, v: np.ndarray) -> np.ndarray:
        return v


class Switching(Moves):
    """Kinds of movement over the same bins: from kind a to b with ``switch[a][b]``, the bins by ``kinds[a][b]``."""

    def __init__(self, kinds: list[list[Moves]], switch: list[list[float]]) -> None:
        self.kinds, self.switch, self.n = kinds, switch, kinds[0][0].size
        self.size = len(kinds) * self.n

    def onward(self, p: np.ndarray) -> np.ndarray:
        parts, every = p.reshape(-1, self.n), range(len(self.kinds))
        return np.concatenate([sum(self.switch[a][b] * self.kinds[a][b].onward(parts[a]) for a in every) for b in every])

    def back(self, v: np.ndarray) -> np.ndarray:
        parts, every = v.reshape(-1, self.n), range(len(self.kinds))
        return np.concatenate([sum(self.switch[a][b] * self.kinds[a][b].back(parts[b]) for b in every) for a in every])


def _as_moves(moves: Moves | list[list[float]]) -> Moves:
    return moves if isinstance(moves, Moves) else Table(moves)


#: Time bins of a series that one task runs through, and how many before them it runs through to forget where it began.
CHUNK, OVERLAP = 1 << 12, 1 << 8
#: A chunk's start is right if it differs from the end before it by no more than this.
FORGOTTEN = 1e-12


def _recurrence(rows: DataFrame, session: str, step: Callable[[np.ndarray | None, np.ndarray], np.ndarray], ahead: bool, chunk: int, overlap: int) -> DataFrame:
    """``session, t, p`` of the recurrence p = step(p, v), scaled to a sum of 1, over ``session, t, v``.

    It runs from each session's start, where it gets None, or from its end if
    ``ahead``; see :func:`sequence.scan_chunks`.
    """

    def through(part: pd.DataFrame, p: np.ndarray | None) -> tuple[dict[str, list], np.ndarray | None]:
        done = []
        for v in part["v"]:
            p = step(p, np.asarray(v, float))
            p = p / p.sum()
            done.append(p)
        return {"p": done}, p

    return scan_chunks(rows.select(session, "t", "v"), (session,), "t", through, {"p": "array<double>"}, chunk, overlap, ahead, FORGOTTEN)


def forward_filter(ll: DataFrame, moves: Moves | list[list[float]], session: str = "session", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``session, t, p``: causal posterior over states; ``p`` is an array in order of states.

    ``ll`` has ``session, t`` and ``l``, an array of log likelihoods in order of
    states; ``moves`` is a table, or what applies transitions. The first time bin
    starts uniform. ``chunk`` and ``overlap`` change the work done, not the result.
    """
    moves = _as_moves(moves)

    def step(p: np.ndarray | None, l: np.ndarray) -> np.ndarray:
        seen = np.exp(l - l.max())
        return seen if p is None else seen * moves.onward(p)

    return _recurrence(ll.select(session, F.col("t").cast("long").alias("t"), F.col("l").alias("v")), session, step, False, chunk, overlap)


def backward_smoother(causal: DataFrame, moves: Moves | list[list[float]], session: str = "session", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``session, t, p``: acausal posterior, from the causal one run through from its end."""
    moves = _as_moves(moves)

    def step(p: np.ndarray | None, here: np.ndarray) -> np.ndarray:
        if p is None:
            return here
        expected = moves.onward(here)
        return here * moves.back(np.divide(p, expected, out=np.zeros_like(p), where=expected > 0))

    return _recurrence(causal.select(session, "t", F.col("p").alias("v")), session, step, True, chunk, overlap)


def place_bins(spark: SparkSession, low: float, high: float, movement_var: float) -> DataFrame:
    """``gx, centre``: bins of a line as wide as the root of the movement's variance."""
    size = math.sqrt(movement_var)
    n = max(1, math.ceil((high - low) / size))
    return spark.range(n).select(F.col("id").cast("int").alias("gx"), (F.lit(low) + (F.col("id") + 0.5) * size).alias("centre"))


def kernel_fields(spike_pos: DataFrame, pos: DataFrame, bins: DataFrame, fs: float, bandwidth: float = 3.0, least: float = 1e-15, fine: float = 0.1) -> DataFrame:
    """``cell, gx, rate``: spikes a second at each place bin, by Gaussian kernel densities of spikes and samples.

    ``spike_pos`` has ``cell, x``, ``pos`` has ``x``, ``bins`` ``gx, centre``, a
    bounded number. Positions are first counted in steps of ``fine``, so what is
    spread over the bins doesn't grow with the recording. Null positions don't
    count; ``least`` is the smallest rate.
    """
    near = lambda c: F.exp(-0.5 * F.pow((F.col(c) - F.col("centre")) / bandwidth, 2))
    step = (F.round(F.col("x") / fine) * fine).alias("at")
    stay = pos.where("x is not null").groupBy(step).agg(F.count("*").alias("n"))
    hit = spike_pos.where("x is not null").groupBy("cell", step).agg(F.count("*").alias("n"))
    small = F.broadcast(bins.select("gx", "centre"))
    dwell = stay.crossJoin(small).groupBy("gx").agg(F.sum(F.col("n") * near("at")).alias("dwell"))
    spk = hit.crossJoin(small).groupBy("cell", "gx").agg(F.sum(F.col("n") * near("at")).alias("spk"))
    rate = F.greatest(F.coalesce(ratio(F.col("spk") * fs, F.col("dwell")), F.lit(0.0)), F.lit(least))
    return spk.join(F.broadcast(dwell), "gx").select("cell", "gx", rate.alias("rate"))


def movement_variance(pos: DataFrame, value: str, fs: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, movement_var``: variance of the steps between samples, for a second."""
    step = framed(pos, {"__d": lambda w: F.lead(value).over(w) - F.col(value)}, 0, 1, keys)
    return step.groupBy(*keys).agg((F.var_samp("__d") * fs).alias("movement_var"))


def random_walk(n_bins: int, size: float, variance: float) -> list[list[float]]:
    """Transitions between bins of a line by a normal step; rows sum to 1."""
    at = np.arange(n_bins) * size
    w = np.exp(-0.5 * (at[:, None] - at[None, :]) ** 2 / variance)
    return (w / w.sum(axis=1, keepdims=True)).tolist()


def state_moves(kinds: list[list[list[list[float]]]], switch: list[list[float]]) -> list[list[float]]:
    """Transitions on states times bins: ``kinds[a][b]`` between the bins of states a and b, weighted by ``switch[a][b]``."""
    return np.block([[np.array(kinds[a][b]) * switch[a][b] for b in range(len(switch))] for a in range(len(switch))]).tolist()


def event_states(n_bins: int, size: float, variance: float, stay: float = 0.98) -> list[list[float]]:
    """Moves among continuous, fragmented and stationary states: a random walk, any bin alike, the same bin.

    Between states any bin is as likely as the next, unless both are of the kinds that keep near.
    """
    walk, uniform, same = random_walk(n_bins, size, variance), np.full((n_bins, n_bins), 1 / n_bins).tolist(), np.eye(n_bins).tolist()
    kinds = [[walk, uniform, walk], [uniform, uniform, uniform], [walk, uniform, same]]
    leave = (1 - stay) / 2
    return state_moves(kinds, [[stay if a == b else leave for b in range(3)] for a in range(3)])


def event_moves(n_bins: int, size: float, variance: float, stay: float = 0.98) -> Switching:
    """The moves of :func:`event_states`, applied in as many steps as there are states."""
    walk, anywhere, same = Walk(n_bins, size, variance), Anywhere(n_bins), Same(n_bins)
    leave = (1 - stay) / 2
    return Switching([[walk, anywhere, walk], [anywhere] * 3, [walk, anywhere, same]], [[stay if a == b else leave for b in range(3)] for a in range(3)])


#: The kinds of movement of :func:`event_states`, in order.
MOVEMENTS = ["continuous", "fragmented", "stationary"]


def event_likelihoods(counts: DataFrame, spans: DataFrame, fields: DataFrame, dt: float, session: str = "session") -> DataFrame:
    """``session, t, l``: Poisson log likelihoods of the position bins, in order, in every time bin of each session.

    ``counts`` has ``session, t, cell, n`` of what fired, ``spans`` ``session,
    n_t``, how many time bins it has from 0 on; in a time bin in which nothing
    fired the silence of all cells speaks. Cells without fields don't count.
    """
    rate = F.col("rate") * dt
    silent = fields.groupBy("gx").agg((-F.sum("rate") * dt).alias("silent"))
    line = silent.agg(F.transform(F.array_sort(F.collect_list(F.struct("gx", "silent"))), lambda x: x["silent"]).alias("silent"))  # a row of bins
    cells = fields.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("gx", F.ln(rate).alias("l")))), lambda x: x["l"]).alias("l"))
    n = line.select(F.size("silent")).first()[0] or 0
    terms = counts.join(cells, "cell").groupBy(session, "t").agg(*[F.sum(F.col("n") * F.col("l")[k]).alias(f"__{k}") for k in range(n)])
    bins = spans.select(session, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_t").cast("long") - 1)).alias("t"))
    met = bins.join(terms, [session, "t"], "left").crossJoin(F.broadcast(line))  # one row
    return met.select(session, "t", F.array(*[F.coalesce(f"__{k}", F.lit(0.0)) + F.col("silent")[k] for k in range(n)]).alias("l"))


def classify(counts: DataFrame, spans: DataFrame, fields: DataFrame, dt: float, n_bins: int, size: float, variance: float, session: str = "session") -> DataFrame:
    """``session, t, state, p``: how likely each kind of movement is in each time bin, seen from the session's end.

    See :func:`event_likelihoods` and :func:`event_moves`; ``fields`` has all of ``n_bins`` bins for each cell.
    """
    moves = event_moves(n_bins, size, variance)
    causal = forward_filter(spread(event_likelihoods(counts, spans, fields, dt, session), len(MOVEMENTS)), moves, session)
    return marginals(backward_smoother(causal, moves, session), MOVEMENTS, n_bins, session)


def spread(ll: DataFrame, n_states: int) -> DataFrame:
    """``ll`` with its likelihoods of bins repeated for each state."""
    return ll.withColumn("l", F.flatten(F.array_repeat("l", n_states)))


def marginals(posterior: DataFrame, names: list[str], n_bins: int, session: str = "session") -> DataFrame:
    """``session, t, state, p``: the posterior summed over bins, for each state."""
    total = lambda k: F.aggregate(F.slice("p", k * n_bins + 1, n_bins), F.lit(0.0), lambda s, x: s + x)
    return posterior.select(session, "t", F.inline(F.array(*[F.struct(F.lit(n).alias("state"), total(k).alias("p")) for k, n in enumerate(names)])))


def median_error(decoded: DataFrame, truth: DataFrame) -> DataFrame:
    """``n, median_error`` in position bins."""
    both = decoded.select("t", F.col("gx").alias("a")).join(truth.select("t", F.col("gx").alias("b")), "t")
    return both.agg(F.count("*").alias("n"), F.percentile(F.abs(F.col("a") - F.col("b")).cast("double"), F.lit(0.5)).alias("median_error"))


def direction_mean(df: DataFrame, angle: Column, keys: list[str]) -> DataFrame:
    """``keys, n, mean, variance``: circular mean and one minus the mean resultant length."""
    c, s = F.avg(F.cos(angle)), F.avg(F.sin(angle))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.atan2(s, c).alias("mean"), (1 - F.sqrt(c * c + s * s)).alias("variance"))
