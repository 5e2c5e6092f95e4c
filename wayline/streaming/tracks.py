"""Recurrences and range joins on streams.

The recurrences keep one small row of state for each track or session, whatever
the stream's length. In their plain forms samples of a track must come in order of
micro-batches; in a micro-batch they may lie in any order. In event time
(:func:`in_order` and what builds on it) they may come in any order within the
watermark's delay: those ahead of their turn wait in a list state until a timer at
the watermark releases them, and a key that was idle for long leaves no state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: What the steps of recurrences look like: rows in order and the state before them give columns and the state after.
Step = Callable[[pd.DataFrame, list[float] | None], tuple[dict[str, list], list[float] | None]]


def _gathered(batches: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    """A key's rows of one micro-batch in order."""
    return pd.concat(list(batches)).sort_values(order, kind="stable")


class _InOrder(StatefulProcessor):
    """Rows of a key in order of their time, as the watermark passes them."""

    def __init__(self, key: str, order: str, columns: list[str], waiting: str, step: Step, expire_ms: int) -> None:
        self.key, self.order, self.columns, self.waiting, self.step, self.expire_ms = key, order, columns, waiting, step, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", self.waiting)
        self.carried = handle.getValueState("carried", "carried array<double>, last_ms bigint")

    def _release(self, key: tuple, rows: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        """Lets go of the rows that no earlier one can come before; the rest waits."""
        ready = sorted((r for r in rows if r[0] <= watermark), key=lambda r: r[1])
        rest = [r for r in rows if r[0] > watermark]
        state = self.carried.get() if self.carried.exists() else None
        carried, last = (list(state[0]) or None, state[1]) if state else (None, watermark)
        if ready:
            part = pd.DataFrame(ready, columns=["at_ms", *self.columns])
            made, carried = self.step(part, carried)
            last = max(last, int(part["at_ms"].max()))
            yield pd.DataFrame({self.key: [key[0]] * len(part), self.order: part[self.order], **made})
        if rest:
            self.ahead.put(rest)
        else:
            self.ahead.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.handle.registerTimer(min(r[0] for r in rest))
        elif watermark < last + self.expire_ms:
            self.handle.registerTimer(last + self.expire_ms)
        if rest or watermark < last + self.expire_ms:
            self.carried.update((carried or [], last))
        else:
            self.carried.clear()

    def _waiting(self) -> list[tuple]:
        return [tuple(r) for r in self.ahead.get()] if self.ahead.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [t for part in rows for t in part[["at_ms", *self.columns]].itertuples(index=False, name=None)]
        yield from self._release(key, self._waiting() + new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, self._waiting(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def in_order(
    stream: DataFrame, key: str, order: str, at: str, values: list[str], step: Step, made: str, late: str = "10 seconds", expire_s: float = 3600.0
) -> DataFrame:
    """``key, order`` and the columns ``made`` of a recurrence over a stream whose samples come late and in any order.

    ``at`` is the samples' time, which ascends with ``order``; ``late`` the delay of
    the watermark, beyond which Spark drops a sample. ``step`` gets the samples that
    are due, in order, and the state of the key, a list of numbers or None. A
    key's state goes ``expire_s`` after its last sample; one that comes later starts
    anew. The session's state store must be RocksDB's.
    """
    columns = [order, *values]
    part = stream.select(key, at, F.unix_millis(at).alias("at_ms"), *columns).withWatermark(at, late)
    kind = lambda c: f"{c} {part.schema[c].dataType.simpleString()}"
    waiting = ", ".join(["at_ms bigint", *map(kind, columns)])
    processor = _InOrder(key, order, columns, waiting, step, int(expire_s * 1000))
    schema = StructType.fromDDL(f"{kind(key)}, {kind(order)}, {made}")
    return part.groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")


def jump_filter_in_time(track: DataFrame, step: float, key: str = "trial", at: str = "at", late: str = "10 seconds", expire_s: float = 3600.0) -> DataFrame:
    """As :func:`jump_filter`, by the samples' time ``at``; see :func:`in_order`."""

    def see(rows: pd.DataFrame, last: list[float] | None) -> tuple[dict[str, list], list[float] | None]:
        ok = []
        for i, x, y in zip(rows["i"], rows["x"], rows["y"]):
            known = x is not None and y is not None and x == x and y == y
            good = known and (last is None or (x - last[1]) ** 2 + (y - last[2]) ** 2 <= ((i - last[0]) * step) ** 2)
            last = [float(i), float(x), float(y)] if good else last
            ok.append(bool(good))
        return {"ok": ok}, last

    part = track.select(key, at, F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return in_order(part, key, "i", at, ["x", "y"], see, "ok boolean", late, expire_s)


def causal_posterior_in_time(ll: DataFrame, moves: list[list[float]], session: str = "session", at: str = "at", late: str = "10 seconds", expire_s: float = 3600.0) -> DataFrame:
    """As :func:`causal_posterior`, by the time bins' time ``at``; see :func:`in_order`."""
    into = np.array(moves, dtype=float).T

    def run(rows: pd.DataFrame, p: list[float] | None) -> tuple[dict[str, list], list[float] | None]:
        done = []
        for l in rows["l"]:
            prior = np.full(len(into), 1 / len(into)) if p is None else into @ np.asarray(p)
            joint = prior * np.exp(np.asarray(l, float) - np.max(l))
            p = (joint / joint.sum()).tolist()
            done.append(p)
        return {"p": done}, p

    part = ll.select(session, at, F.col("t").cast("long").alias("t"), "l")
    return in_order(part, session, "t", at, ["l"], run, "p array<double>", late, expire_s)


def jump_filter(track: DataFrame, step: float, key: str = "trial") -> DataFrame:
    """``key, i, ok`` of a stream ``key, i, x, y``: whether a sample is within reach of the last good one.

    That is ``step`` for each sample since then; the first known sample is good, a
    masked one never is. The state is the last good sample.
    """

    def see(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _gathered(batches, "i")
        last, ok = (tuple(state.get) if state.exists else None), []
        for i, x, y in zip(rows["i"], rows["x"], rows["y"]):
            known = not (np.isnan(x) or np.isnan(y))
            good = known and (last is None or (x - last[1]) ** 2 + (y - last[2]) ** 2 <= ((i - last[0]) * step) ** 2)
            last = (int(i), float(x), float(y)) if good else last
            ok.append(bool(good))
        if last is not None:
            state.update(last)
        yield pd.DataFrame({key: [name[0]] * len(rows), "i": rows["i"].to_numpy(), "ok": ok})

    part = track.select(key, F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    kind = part.schema[key].dataType.simpleString()
    return part.groupBy(key).applyInPandasWithState(see, f"{key} {kind}, i long, ok boolean", "i long, x double, y double", "append", GroupStateTimeout.NoTimeout)


def causal_posterior(ll: DataFrame, moves: list[list[float]], session: str = "session") -> DataFrame:
    """``session, t, p`` of a stream ``session, t, l``: the causal posterior, whose last value is the state.

    ``l`` has log likelihoods in order of states; a session starts uniform.
    """
    into = np.array(moves, dtype=float).T

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _gathered(batches, "t")
        p, done = (np.asarray(state.get[0]) if state.exists else None), []
        for l in rows["l"]:
            prior = np.full(len(into), 1 / len(into)) if p is None else into @ p
            joint = prior * np.exp(np.asarray(l) - np.max(l))
            p = joint / joint.sum()
            done.append(p.tolist())
        state.update((p.tolist(),))
        yield pd.DataFrame({session: [name[0]] * len(rows), "t": rows["t"].to_numpy(), "p": done})

    part = ll.select(session, F.col("t").cast("long").alias("t"), "l")
    kind = part.schema[session].dataType.simpleString()
    return part.groupBy(session).applyInPandasWithState(run, f"{session} {kind}, t long, p array<double>", "p array<double>", "append", GroupStateTimeout.NoTimeout)


def lag_pairs(spikes: DataFrame, window_s: float, late: str = "1 hour", keys: tuple[str, ...] = ("tet", "cell")) -> DataFrame:
    """``keys, ia, ib, lag_s``: pairs of later spikes of a cell at most ``window_s`` after one, of ``keys, i, at``.

    On a stream both sides forget what the watermark and the window have passed.
    """
    timed = spikes.withWatermark("at", late) if spikes.isStreaming else spikes
    a = timed.select(*keys, F.col("i").alias("ia"), F.col("at").alias("at_a"))
    b = timed.select(*[F.col(k).alias(f"{k}_b") for k in keys], F.col("i").alias("ib"), F.col("at").alias("at_b"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"{k}_b"))
    near = (F.col("at_b") >= F.col("at_a")) & (F.col("at_b") <= F.col("at_a") + F.expr(f"INTERVAL {int(window_s * 1000)} MILLISECOND"))
    pairs = a.join(b, same & near & (F.col("ib") > F.col("ia")))
    return pairs.select(*keys, "ia", "ib", ((F.unix_micros("at_b") - F.unix_micros("at_a")) / 1e6).alias("lag_s"))
