"""Live rows on keyed state: every site's own history and its neighbours' newest rows live with the site, so no batch reads a history or a board.

One processor per site holds typed state: the place reached (newest slot, session step), the newest rows as a list, the newest row of every slot of the day
and of every neighbour as maps, and the newest row's features, which stand in where the history is too short. An event-time timer clears a site that
has been silent for long. State starts from a stored history (``initial_rows``) or from nothing.

A site that sends more than one Arrow batch at once has its rows parked by day in the state and walked day by day, so memory holds one batch and one day.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from slotline import fixed
from slotline.operators import timeseries as ts
from slotline.session import keep_state_in_rocksdb

KEPT_ROWS = 6
IDLE_DAYS = 366
MEASURES = ["occupancy_clean", "utilization", "queue_length", "parking_stress_index"]
CONTEXT_MEASURES = MEASURES[1:]
PREVIOUS_DAY = list(ts.PREVIOUS_DAY_LAGS)
HISTORY = [*ts.IN_SESSION_LAGS, *ts.ROLLING_MEANS, *PREVIOUS_DAY]
CONTEXT = ["neighbor_utilization_mean", "neighbor_queue_mean", "neighbor_stress_mean", "mean_neighbor_distance"]
OWN, NEAR = 0, 1
DAY_US = 86_400_000_000


def _columns(names: Sequence[str], kind: str = "double") -> str:
    return ", ".join(f"{n} {kind}" for n in names)


def features_of(
    times: np.ndarray, rows: np.ndarray, recent: np.ndarray, last: int | None, step: int, template: np.ndarray, known: dict[int, tuple], width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by ``HISTORY``, session steps, minutes since the row before) of one site's new rows in time order.

    ``recent`` holds the rows before them, ``known`` the newest triple per slot of the day, ``template`` the features of the newest row.
    """
    n, kept = len(times), len(recent)
    whole = np.vstack([recent, rows])
    at = kept + np.arange(n)

    def back(column: int, k: int) -> np.ndarray:
        return np.where(at >= k, whole[np.maximum(at - k, 0), column], np.nan)

    out, place = np.empty((n, len(HISTORY))), 0
    for column, k in ts.IN_SESSION_LAGS.values():
        out[:, place] = np.where(at >= k, back(MEASURES.index(column), k), template[place])
        place += 1
    for column, size in ts.ROLLING_MEANS.values():
        past = np.stack([back(MEASURES.index(column), k) for k in range(1, size + 1)])
        seen = ~np.isnan(past)
        mean = np.where(seen, past, 0.0).sum(axis=0) / np.where(seen.any(axis=0), seen.sum(axis=0), np.nan)
        out[:, place] = np.where(at >= 1, mean, template[place])
        place += 1
    # The row before in the same slot of the day: in this run of rows, or the one the state knows.
    spot = times // width % (DAY_US // width)
    order = np.argsort(spot, kind="stable")
    same = np.full((n, len(PREVIOUS_DAY)), np.nan)
    follows = np.zeros(n, bool)
    follows[1:] = spot[order][1:] == spot[order][:-1]
    same[order[follows]] = rows[order[np.flatnonzero(follows) - 1], 1:]
    for i in order[~follows]:
        same[i] = known.get(int(spot[i]), (np.nan,) * len(PREVIOUS_DAY))
    for c in range(len(PREVIOUS_DAY)):
        filled = np.concatenate([[template[place + c]], same[:, c]])
        newest = np.maximum.accumulate(np.where(np.isnan(filled), 0, np.arange(n + 1)))
        out[:, place + c] = filled[newest][1:]
    before = np.concatenate([[times[0] if last is None else last], times[:-1]])
    joined = times - before == width
    if last is None:
        joined[0] = False
    breaks = np.maximum.accumulate(np.where(joined, -1, np.arange(n)))
    steps = np.where(breaks < 0, step + 1 + np.arange(n), np.arange(n) - np.maximum(breaks, 0))
    return out, steps, (times - before) / 60e6


def context_of(times: np.ndarray, edges: list, near: pd.DataFrame, known: dict[str, tuple]) -> np.ndarray:
    """Weighted measures of each neighbour's newest row at or before ``times``, and the mean distance; ``known`` holds what the state knows."""
    out = np.zeros((len(times), len(CONTEXT)))
    if edges is None or not len(edges):
        return out
    for edge in edges:
        at, values = np.zeros(0, np.int64), np.zeros((0, 3))
        stored = known.get(edge["neighbor"])
        if stored is not None:
            at, values = np.array([stored[0]]), np.array([stored[1:]], float)
        fresh = near[near["neighbor"] == edge["neighbor"]]
        at = np.concatenate([at, fresh["us"].to_numpy(np.int64)])
        values = np.vstack([values, fresh[CONTEXT_MEASURES].to_numpy(float)])
        order = np.argsort(at, kind="stable")
        seen = np.searchsorted(at[order], times, side="right") - 1
        hit = seen >= 0
        if hit.any():
            found = np.nan_to_num(values[order][seen[hit]])
            out[hit, :3] += edge["weight"] * found
            out[hit, 3] += edge["distance"]
    out[:, 3] /= len(edges)
    return out


class SiteProcessor(StatefulProcessor):
    """Rows in, feature rows out; see the module for what the state holds."""

    def __init__(self, minutes: int, carry: list[str], names: list[str], expires: bool) -> None:
        self.width, self.carry, self.names, self.expires = minutes * 60_000_000, carry, names, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "last_slot long, step long")
        self.newest = handle.getValueState("newest", _columns(HISTORY))
        self.recent = handle.getListState("recent", _columns(MEASURES))
        self.same = handle.getMapState("same_slot", "spot int", _columns(PREVIOUS_DAY))
        self.near = handle.getMapState("near", "neighbor string", "us long, " + _columns(CONTEXT_MEASURES))
        self.parked = handle.getMapState("parked", "day long", "frame binary")

    def close(self) -> None:
        pass

    # --- state ---

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.sort_values("us")
        own = rows[rows["kind"] == OWN]
        for r in rows[rows["kind"] == NEAR].itertuples():
            self._see(r.neighbor, int(r.us), [getattr(r, c) for c in CONTEXT_MEASURES])
        if len(own):
            self.recent.put([tuple(float(v) for v in r) for r in own[MEASURES].tail(KEPT_ROWS).to_numpy(float)])
            for us, *triple in own[["us", *CONTEXT_MEASURES]].itertuples(index=False):
                self.same.updateValue((int(us // self.width % (DAY_US // self.width)),), tuple(float(v) for v in triple))
            top = own.iloc[-1]
            self.place.update((int(top["us"]), int(top["step"]) if not pd.isna(top["step"]) else 0))
            self.newest.update(tuple(float(top[c]) for c in HISTORY))
        self._stay()

    def _stay(self) -> None:
        """The watermark, which lags by the days a site may be idle, reaches the site's newest slot when it has been silent for so long."""
        if self.expires and self.place.exists():
            at = self.place.get()[0] // 1000 + 1
            known = list(self.handle.listTimers())
            for t in known:
                if t != at:
                    self.handle.deleteTimer(t)
            if at not in known:
                self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.place, self.newest, self.recent, self.same, self.near, self.parked):
            state.clear()
        return iter([])

    def _see(self, neighbour: str, us: int, measures: list[float]) -> None:
        stored = self.near.getValue((neighbour,)) if self.near.containsKey((neighbour,)) else None
        if stored is None or us >= stored[0]:
            self.near.updateValue((neighbour,), (us, *[float(v) for v in measures]))

    # --- rows ---

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, second = next(rows, None), next(rows, None)
        if second is None:
            if first is not None and len(first):
                yield from self._walk(key[0], first)
        else:
            days = set()
            for frame in (first, second):
                yield from self._park(key[0], frame, days)
            for frame in rows:
                yield from self._park(key[0], frame, days)
            for day in sorted(days):
                frame = self._unpark(day)
                self.parked.removeKey((day,))
                yield from self._walk(key[0], frame)
        self._stay()

    def _unpark(self, day: int) -> pd.DataFrame:
        with pa.ipc.open_stream(self.parked.getValue((day,))[0]) as reader:
            return reader.read_pandas()

    def _park(self, site: str, frame: pd.DataFrame, days: set) -> Iterator[pd.DataFrame]:
        """Rows to the state by day; of several rows for one slot the first stays and the others are late at once."""
        for day, part in frame.groupby(frame["us"] // DAY_US, sort=False):
            day = int(day)
            if day in days:
                part = pd.concat([self._unpark(day), part], ignore_index=True)
            part, late = self._once(part)
            yield from self._late(site, late)
            table = pa.Table.from_pandas(part, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            self.parked.updateValue((day,), (sink.getvalue().to_pybytes(),))
            days.add(day)

    def _once(self, frame: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        again = (frame["kind"] == OWN) & frame[frame["kind"] == OWN].duplicated("us").reindex(frame.index, fill_value=False)
        return frame[~again], frame[again]

    def _late(self, site: str, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(frame):
            out = pd.DataFrame({"system_code": site, "time_slot": frame["time_slot"], "is_late": True}, index=frame.index)
            yield self._shaped(out.assign(**{c: frame[c] for c in [*MEASURES, *self.carry]}))

    def _shaped(self, frame: pd.DataFrame) -> pd.DataFrame:
        return frame.reindex(columns=self.names).astype({"session_step": "Int64"})

    def _walk(self, site: str, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        frame = frame.sort_values(["us", "kind", *MEASURES], ascending=[True, False, *[True] * len(MEASURES)], ignore_index=True)
        place = self.place.get() if self.place.exists() else None
        last, step = (place[0], place[1]) if place else (None, -1)
        own, again = self._once(frame)
        own = own[own["kind"] == OWN]
        late = own[own["us"] <= last] if last is not None else own[:0]
        yield from self._late(site, pd.concat([late, again]))
        near = frame[frame["kind"] == NEAR]
        own = own[own["us"] > last] if last is not None else own
        if len(own):
            yield self._shaped(self._features(site, own, near, last, step))
        for neighbour, part in near.groupby("neighbor"):
            r = part.iloc[-1]
            self._see(neighbour, int(r["us"]), [r[c] for c in CONTEXT_MEASURES])

    def _features(self, site: str, own: pd.DataFrame, near: pd.DataFrame, last: int | None, step: int) -> pd.DataFrame:
        times, rows = own["us"].to_numpy(np.int64), own[MEASURES].to_numpy(float)
        recent = np.array([tuple(r) for r in self.recent.get()], float).reshape(-1, len(MEASURES))
        template = np.array(tuple(self.newest.get()) if self.newest.exists() else [np.nan] * len(HISTORY), float)
        template = np.array([np.nan if v is None else v for v in template], float)
        spots = times // self.width % (DAY_US // self.width)
        known = {int(s): tuple(np.nan if v is None else v for v in self.same.getValue((int(s),))) for s in set(spots.tolist()) if self.same.containsKey((int(s),))}
        features, steps, gaps = features_of(times, rows, recent, last, step, template, known, self.width)
        edges = own["edges"].iloc[-1]
        seen = {}
        if edges is not None:
            wanted = [e["neighbor"] for e in edges]
            seen = {n: tuple(np.nan if v is None else v for v in self.near.getValue((n,))) for n in wanted if self.near.containsKey((n,))}
        context = context_of(times, edges, near, seen)
        self.recent.put([tuple(float(v) for v in r) for r in np.vstack([recent, rows])[-KEPT_ROWS:]])
        newest = {int(s): i for i, s in enumerate(spots)}
        for s, i in newest.items():
            self.same.updateValue((s,), tuple(float(v) for v in rows[i, 1:]))
        self.newest.update(tuple(float(v) for v in features[-1]))
        self.place.update((int(times[-1]), int(steps[-1])))
        out = pd.DataFrame(features, columns=HISTORY, index=own.index).assign(
            system_code=site, time_slot=own["time_slot"], session_step=steps, minutes_from_previous=gaps, is_late=False,
            utilization_delta_30m=rows[:, 1] - features[:, HISTORY.index("lag_utilization_30m")],
            utilization_delta_60m=rows[:, 1] - features[:, HISTORY.index("lag_utilization_60m")],
        )
        context = pd.DataFrame(context, columns=CONTEXT, index=own.index)
        return pd.concat([out, context, own[[*MEASURES, *self.carry]]], axis=1)


_US = "us long, time_slot timestamp, kind int, neighbor string"


def _own_rows(slots: DataFrame, key: str, edges: DataFrame | None, carry: list[str]) -> DataFrame:
    lists = T.ArrayType(T.StructType([T.StructField("neighbor", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("distance", T.DoubleType())]))
    rows = slots
    if edges is not None:
        # k edges per site, in a fixed order so that sums come out alike.
        entry = F.struct(F.col("neighbor_code").cast("string").alias("neighbor"), F.col("weight").cast("double").alias("weight"), F.col("distance").cast("double").alias("distance"))
        listed = edges.groupBy(F.col("system_code").alias("_site")).agg(F.array_sort(F.collect_list(entry)).alias("edges"))
        rows = slots.join(listed, F.col(key) == F.col("_site"), "left")
    around = F.col("edges") if edges is not None else F.lit(None)
    return rows.select(
        F.col(key).cast("string").alias("system_code"), F.unix_micros("time_slot").alias("us"), "time_slot", F.lit(OWN).alias("kind"), F.lit(None).cast("string").alias("neighbor"),
        *[F.col(c).cast("double").alias(c) for c in MEASURES], around.cast(lists).alias("edges"), *carry,
    )


def _near_rows(slots: DataFrame, key: str, edges: DataFrame, like: DataFrame, carry: list[str]) -> DataFrame:
    """Every row once for each site that has its site as a neighbour."""
    asks = edges.select(F.col("neighbor_code").alias("_near"), F.col("system_code").cast("string").alias("_asks"))
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema if f.name in ("occupancy_clean", "edges", *carry)}
    return slots.join(asks, F.col(key) == F.col("_near")).select(
        F.col("_asks").alias("system_code"), F.unix_micros("time_slot").alias("us"), "time_slot", F.lit(NEAR).alias("kind"), F.col(key).cast("string").alias("neighbor"),
        none["occupancy_clean"], *[F.col(c).cast("double").alias(c) for c in CONTEXT_MEASURES], none["edges"], *[none[c] for c in carry],
    )


def initial_rows(history: DataFrame, edges: DataFrame | None = None, key: str = "system_code") -> DataFrame:
    """What a stored ``history`` leaves in the state: ``KEPT_ROWS`` newest rows, the newest row of each slot of the day and of each neighbour, for every site.

    Feature columns that the history has (``HISTORY``, ``session_step``) become the template of rows that come too soon for their own.
    """
    day_slots, width = 24 * 60 // fixed.SLOT_MINUTES, fixed.SLOT_MINUTES * 60
    given = [F.col(c).cast("double").alias(c) if c in history.columns else F.lit(None).cast("double").alias(c) for c in HISTORY]
    step = F.col("session_step").cast("long") if "session_step" in history.columns else F.lit(None).cast("long")
    rows = history.select(
        F.col(key).cast("string").alias("system_code"), F.unix_micros("time_slot").alias("us"), *[F.col(c).cast("double").alias(c) for c in MEASURES], *given, step.alias("step")
    )
    whole = F.struct(*[F.col(c) for c in rows.columns])
    # The newest row per slot of the day is one combined aggregation; of the newest rows each map task passes on no more than are kept.
    spot = F.pmod(F.floor(F.col("us") / (width * 1_000_000)), F.lit(day_slots))
    daily = rows.groupBy("system_code", spot.alias("spot")).agg(F.max_by(whole, "us").alias("r")).select("r.*")
    rank = F.row_number().over(Window.partitionBy("system_code").orderBy(F.desc("us")))
    tail = rows.withColumn("_rank", rank).where(F.col("_rank") <= KEPT_ROWS).drop("_rank")
    own = daily.unionByName(tail).dropDuplicates(["system_code", "us"]).withColumns({"kind": F.lit(OWN), "neighbor": F.lit(None).cast("string")})
    if edges is None:
        return own
    asks = edges.select(F.col("neighbor_code").cast("string").alias("neighbor"), F.col("system_code").cast("string").alias("_asks"))
    last = rows.groupBy("system_code").agg(F.max_by(whole, "us").alias("r")).select("r.*")
    near = last.withColumnRenamed("system_code", "neighbor").join(asks, "neighbor").withColumnRenamed("_asks", "system_code").withColumn("kind", F.lit(NEAR))
    return own.unionByName(near.select(*own.columns))


def feature_stream(
    slots: DataFrame, key: str = "system_code", edges: DataFrame | None = None, history: DataFrame | None = None, carry: Sequence[str] = (), idle_days: int | None = IDLE_DAYS
) -> DataFrame:
    """Feature rows of a stream of slot rows, with neighbour context if ``edges`` are given, starting from ``history`` if there is one.

    Rows not later than a site's newest one are marked late and have no features. ``carry`` columns pass through. Neighbours count with their newest row at or
    before the row's slot; a neighbour that is ahead of the site by whole batches counts with nothing. State of a site goes when the stream is ``idle_days``
    past its newest slot, and rows that are further behind than that are dropped by the watermark; with None nothing expires and nothing is dropped.
    """
    keep_state_in_rocksdb(slots.sparkSession)
    if idle_days is not None:
        slots = slots.withWatermark("time_slot", f"{idle_days} days")
    carry = list(carry)
    rows = _own_rows(slots, key, edges, carry)
    if edges is not None:
        rows = rows.unionByName(_near_rows(slots, key, edges, rows, carry))
    names = ["system_code", "time_slot", "session_step", "minutes_from_previous", "is_late", *HISTORY, "utilization_delta_30m", "utilization_delta_60m", *MEASURES, *CONTEXT]
    kinds = {"system_code": "string", "time_slot": "timestamp", "session_step": "long", "is_late": "boolean"}
    output = ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names) + "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    start = initial_rows(history, edges, key).groupBy("system_code") if history is not None else None
    out = rows.groupBy("system_code").transformWithStateInPandas(
        SiteProcessor(fixed.SLOT_MINUTES, carry, [*names, *carry], idle_days is not None), output, "Append", "EventTime" if idle_days is not None else "None", start
    )
    return out if edges is not None else out.drop(*MEASURES, *CONTEXT)
