"""Connection scans: rides of a timetable stream past blocks of zones.

Zones never meet, so a scenario's zones are dealt into blocks.  The rows of a
block, walks first, then transfers, egress walks, and its scenario's rides in
scanning order, are sorted by Spark and pass through a task batch by batch; a
task keeps the labels of one block, never a timetable.

A leave-one-out scan needs no pass for each service.  A ride that improves
nothing changes nothing, so a day without a service differs from the whole day
only for zones that one of its rides improves.  When a ride first does so, the
zone's labels are copied, and the copy goes on without the ride's trip, a second
one without its route; all copies advance together with the zones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = 10**12
#: Labels (rows times stops) that one task holds, about, and copies that a zone may have in a leave-one-out scan, about.
BLOCK_LABELS, COPIES = 1 << 22, 64
#: Zones of a block, at least, where there are more blocks only to keep all cores busy.
LEAST_ZONES = 64
_WALK, _TRANSFER, _EGRESS, _RIDE = range(4)


class Labels:
    """When each zone of a block can be at each stop; a row of ``at`` is a stop, its columns zones and then copies."""

    def __init__(self, zones: list, copies: bool):
        self.zones, self.copies = zones, copies
        self.place, self.transfers, self.egress = {}, {}, []
        self.at, self.n = np.full((8, max(1, len(zones))), NEVER, np.int64), len(zones)
        # Of each copy: the zone that it was made of, and the number of the service that it does without.
        self.own, self.without = np.arange(self.n), np.full(self.n, -1)
        self.services, self.copied = {}, {}

    def stop(self, value) -> int:
        if value not in self.place:
            self.place[value] = len(self.place)
            if len(self.place) > len(self.at):
                self.at = np.concatenate([self.at, np.full_like(self.at, NEVER)])
        return self.place[value]

    def _copy(self, zones: np.ndarray, service: tuple) -> None:
        number = self.services.setdefault(service, len(self.services))
        made = self.copied.setdefault(number, np.zeros(len(self.zones), bool))
        fresh = zones[~made[zones]]
        made[fresh] = True
        upto = self.n + len(fresh)
        if upto > self.at.shape[1]:
            self.at = np.concatenate([self.at, np.full((len(self.at), max(upto, 2 * self.n) - self.at.shape[1]), NEVER, np.int64)], axis=1)
        self.at[:, self.n : upto] = self.at[:, fresh]
        self.own, self.without = np.append(self.own, fresh), np.append(self.without, np.full(len(fresh), number))
        self.n = upto

    def ride(self, dep: int, arr: int, a, b, services: tuple = ()) -> None:
        """A ride that improves a stop's label relaxes that stop's transfers once; labels from walking or transfers relax nothing."""
        if a not in self.place:
            return
        from_, to = self.place[a], self.stop(b)
        better = self.at[from_, : self.n] <= dep
        if not better.any():
            return
        better &= self.at[to, : self.n] > arr
        if not better.any():
            return
        if self.copies:
            for service in services:
                number = self.services.get(service)
                if number is not None:
                    better &= self.without != number
            before, zones = self.n, np.flatnonzero(better[: len(self.zones)])
            if len(zones):
                for service in services:
                    self._copy(zones, service)
                # A copy made just now is without one of the services of this ride, as are all that the test above left out.
                better = np.append(better, np.zeros(self.n - before, bool))
        rows = np.flatnonzero(better)
        self.at[to, rows] = arr
        for c, seconds in self.transfers.get(b, ()):
            stop = self.stop(c)
            self.at[stop, rows] = np.minimum(self.at[stop, rows], arr + seconds)

    def found(self) -> tuple[np.ndarray, np.ndarray, list]:
        """Places and zones of all labels, and the stops by place."""
        s, z = np.nonzero(self.at[: len(self.place), : len(self.zones)] < NEVER)
        return s, z, list(self.place)

    def minutes(self, start: int) -> dict:
        """By destination, the least minutes to it by riding, of each zone and copy; infinite where there is no way."""
        out: dict = {}
        for to, stop, walk in self.egress:
            best = out.setdefault(to, np.full(self.n, np.inf))
            if stop in self.place:
                label = self.at[self.place[stop], : self.n]
                np.minimum(best, np.where(label < NEVER, (label - start) / 60.0 + walk, np.inf), out=best)
        return out


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of rows that are equal in all columns."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    edges = [*np.flatnonzero(change), len(change)]
    return list(zip(edges, edges[1:], strict=False))


_NAMES = ("block", "kind", "dep", "arr", "seq", "zone", "a", "b", "minutes", "to", "route", "trip")


def _labelled(batches: Iterator[pa.RecordBatch], copies: bool) -> Iterator[tuple]:
    """(scenario, start, Labels) of each block, once all its rows have passed."""
    key, state, near, start = None, None, {}, 0

    def begun() -> Labels:
        own, stops = (pa.chunked_array(part).unify_dictionaries().combine_chunks() for part in list(zip(*near, strict=True))[:2])
        state = Labels(own.dictionary.to_pylist(), copies)
        places = np.array([state.stop(s) for s in stops.dictionary.to_pylist()])
        np.minimum.at(state.at, (places[stops.indices.to_numpy()], own.indices.to_numpy()), np.concatenate([part[2] for part in near]))
        return state

    for batch in batches:
        column = dict(zip(("scenario", *_NAMES), batch.columns, strict=True))
        scenario = column["scenario"].dictionary_encode()
        names = scenario.dictionary.to_pylist()
        codes, block, kind = scenario.indices.to_numpy(), column["block"].to_numpy(), column["kind"].to_numpy()
        for begin, end in _runs(codes, block, kind):
            here = (names[codes[begin]], block[begin])
            if here != key:
                if key is not None:
                    yield key[0], start, state or begun()
                key, state, near = here, None, []
            part = {n: c.slice(begin, end - begin) for n, c in column.items()}
            values = lambda *names, part=part: [part[n].to_pylist() for n in names]
            if kind[begin] == _WALK:
                start = part["dep"][0].as_py()
                # Copies, since a slice would keep the whole batch.
                near.append((part["zone"].dictionary_encode(), part["a"].dictionary_encode(), part["arr"].to_numpy().copy()))
                continue
            state = state or begun()
            if kind[begin] == _TRANSFER:
                for a, b, seconds in zip(*values("a", "b", "arr"), strict=True):
                    state.transfers.setdefault(a, []).append((b, seconds))
            elif kind[begin] == _EGRESS:
                state.egress += zip(*values("to", "a", "minutes"), strict=True)
            elif copies:
                for dep, arr, a, b, route, trip in zip(*values("dep", "arr", "a", "b", "route", "trip"), strict=True):
                    state.ride(dep, arr, a, b, (("route", route), ("trip", trip)))
            else:
                for ride in zip(*values("dep", "arr", "a", "b"), strict=True):
                    state.ride(*ride)
    if key is not None:
        yield key[0], start, state or begun()


def _streams(near: DataFrame, rides: DataFrame, transfers: DataFrame | None, egress: DataFrame | None, copies: bool) -> DataFrame:
    """All rows of each block of zones of a scenario, in the order in which a task takes them.

    ``near``: scenario, start, zone_id, stop_id, label; ``rides``: scenario,
    seq, dep, arr, from_stop, to_stop, and route_id and trip_id where there are
    copies; ``transfers``: scenario, from_stop, to_stop, seconds; ``egress``:
    scenario, stop_id, minutes, destination (null where there is one only).
    """
    spark = near.sparkSession
    scenarios, zones, stops = near.agg(F.countDistinct("scenario"), F.countDistinct("zone_id"), F.countDistinct("stop_id")).first()
    by_memory = -(-zones * max(1, stops) * (COPIES if copies else 1) // BLOCK_LABELS)
    by_cores = min(-(-spark.sparkContext.defaultParallelism // max(1, scenarios)), -(-zones // LEAST_ZONES))
    near = near.withColumn("block", F.pmod(F.xxhash64("zone_id"), F.lit(max(1, by_memory, by_cores))).cast("int"))
    blocks = near.select("scenario", "block").distinct()
    types = dict(near.dtypes) | {"destination": dict(egress.dtypes)["destination"] if egress is not None else "int"}
    kinds = dict(zip(_NAMES, ("int", "int", "long", "long", "long", types["zone_id"], types["stop_id"], types["stop_id"], "double", types["destination"], "string", "string"), strict=True))

    def rows(df: DataFrame, kind: int, **columns) -> DataFrame:
        told = {"block": F.col("block"), "kind": F.lit(kind)} | {n: F.col(c) for n, c in columns.items()}
        return df.select("scenario", *[(told[n] if n in told else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])

    out = rows(near, _WALK, dep="start", arr="label", zone="zone_id", a="stop_id")
    if transfers is not None:
        out = out.unionAll(rows(transfers.join(blocks, "scenario"), _TRANSFER, arr="seconds", a="from_stop", b="to_stop"))
    if egress is not None:
        out = out.unionAll(rows(egress.join(blocks, "scenario"), _EGRESS, a="stop_id", minutes="minutes", to="destination"))
    services = {"route": "route_id", "trip": "trip_id"} if copies else {}
    out = out.unionAll(rows(rides.filter("arr >= dep").join(blocks, "scenario"), _RIDE, dep="dep", arr="arr", seq="seq", a="from_stop", b="to_stop", **services))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return out.repartition(parts, "scenario", "block").sortWithinPartitions("scenario", "block", "kind", "dep", "arr", "seq")


def arrivals(near: DataFrame, rides: DataFrame, transfers: DataFrame | None = None) -> DataFrame:
    """(scenario, zone_id, stop_id, seconds): when each zone's people can be at each stop; arguments as :func:`_streams` takes them."""
    types = dict(near.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        of = {n: first.schema.field(n).type for n in ("scenario", "zone", "a")}
        for scenario, _, state in _labelled((b for part in ([first], batches) for b in part), copies=False):
            s, z, stops = state.found()
            columns = [pa.array([scenario] * len(s), of["scenario"]), pa.array(state.zones, of["zone"]).take(pa.array(z)), pa.array(stops, of["a"]).take(pa.array(s)), pa.array(state.at[s, z])]
            yield pa.RecordBatch.from_arrays(columns, ["scenario", "zone_id", "stop_id", "seconds"])

    schema = f"scenario {types['scenario']}, zone_id {types['zone_id']}, stop_id {types['stop_id']}, seconds long"
    return _streams(near, rides, transfers, None, copies=False).mapInArrow(read, schema)


def without_each(near: DataFrame, rides: DataFrame, transfers: DataFrame | None, egress: DataFrame) -> DataFrame:
    """(scenario, zone_id, destination, kind, id, ride): minutes by riding, of each zone (kind baseline), and without each route and trip where they differ.

    ``ride`` is null where there is no way; arguments as :func:`_streams` takes them.
    """
    types = dict(near.dtypes) | {"destination": dict(egress.dtypes)["destination"]}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        of = {n: first.schema.field(n).type for n in ("scenario", "zone", "to")}
        for scenario, start, state in _labelled((b for part in ([first], batches) for b in part), copies=True):
            names, zones = [("baseline", ""), *state.services], len(state.zones)
            for to, minutes in state.minutes(start).items():
                keep = np.flatnonzero((np.arange(state.n) < zones) | (minutes != minutes[state.own]))
                told = pa.array(state.without[keep] + 1)
                ride = pa.array(minutes[keep], mask=np.isinf(minutes[keep]))
                columns = [pa.array([scenario] * len(keep), of["scenario"]), pa.array(state.zones, of["zone"]).take(pa.array(state.own[keep])), pa.array([to] * len(keep), of["to"])]
                columns += [pa.array([n[k] for n in names], pa.string()).take(told) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*columns, ride], ["scenario", "zone_id", "destination", "kind", "id", "ride"])

    schema = f"scenario {types['scenario']}, zone_id {types['zone_id']}, destination {types['destination']}, kind string, id string, ride double"
    return _streams(near, rides, transfers, egress, copies=True).mapInArrow(read, schema)
