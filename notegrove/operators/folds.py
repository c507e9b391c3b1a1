"""Logs of actions folded to states, however many a key has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files


class Machine:
    """States by number; for each action the state that each state turns to, and how much a counter rises then. Unknown actions change nothing."""

    def __init__(self, states: list, actions: dict[str, dict]):
        """``actions``: of each action, what states turn to, as ``{state: state}`` or ``{state: (state, rise)}``; states not named stay."""
        self.states = states
        at = {s: k for k, s in enumerate(states)}
        self.to, self.rise = {}, {}
        for a, moves in actions.items():
            to, rise = np.arange(len(states)), np.zeros(len(states), np.int64)
            for s, t in moves.items():
                t, r = t if isinstance(t, tuple) and t not in at else (t, 0)
                to[at[s]], rise[at[s]] = at[t], r
            self.to[a], self.rise[a] = to, rise


def _composed(to: np.ndarray, rise: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One map for each run of rows that begins at ``first``: neighbours are composed two by two, all runs at once, until each run is one row."""
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(to))))
    while len(run) > len(first):
        start = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        place = np.arange(len(run)) - np.repeat(start, np.diff(np.append(start, len(run))))
        odd = np.flatnonzero(place % 2)
        rise[odd - 1] += np.take_along_axis(rise[odd], to[odd - 1], axis=1)
        to[odd - 1] = np.take_along_axis(to[odd], to[odd - 1], axis=1)
        stay = place % 2 == 0
        run, to, rise = run[stay], to[stay], rise[stay]
    return to, rise


def maps(events: DataFrame, key: str, machine: Machine, order: tuple[str, ...] = ("ts", "event_id"), action: str = "action") -> DataFrame:
    """``key``, parts: the maps (place, to, rise, n) that the actions of each key, in ``order``, make of all states, a few in a row.

    Events are dealt by ranges of (key, order), so a key with very many of them is spread over many tasks. Each task composes the maps of a key's
    actions to one map of all states, and only these maps (one for each task that a key is in) are brought together. Nulls in ``order`` come first.
    """
    schema = T.StructType([events.schema[key], T.StructField("place", T.IntegerType()), T.StructField("to", T.ArrayType(T.IntegerType())), T.StructField("rise", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())])
    size = len(machine.states)

    names = list(machine.to)
    tos = np.stack([*(machine.to[n] for n in names), np.arange(size)])  # the last one is that of unknown actions
    rises = np.stack([*(machine.rise[n] for n in names), np.zeros(size, np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the key that the last batch ended with, and its map so far

        def rows(keys: pa.Array, place: int, to: np.ndarray, rise: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * size)
            maps = (pa.ListArray.from_arrays(ends, pa.array(x.ravel(), t)) for x, t in ((to, pa.int32()), (rise, pa.int64())))
            return pa.RecordBatch.from_arrays([keys, pa.array([place] * len(n), pa.int32()), *maps, pa.array(n, pa.int64())], names=schema.names)

        for b in batches:
            if not b.num_rows:
                continue
            key, place = b.column(0), b.column(2)[0].as_py()
            code = pc.index_in(b.column(1), value_set=pa.array(names, b.schema.field(1).type))
            code = pc.fill_null(code, len(names)).to_numpy(zero_copy_only=False)
            number = pc.fill_null(key.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
            to, rise = _composed(tos[code], rises[code], first)
            n, keys = np.diff(np.append(first, len(number))), key.take(pa.array(first))
            if held is not None:
                if held[0][0].as_py() == keys[0].as_py():
                    rise[0] = held[2][0] + rise[0][held[1][0]]
                    to[0] = to[0][held[1][0]]
                    n[0] += held[3][0]
                else:
                    yield rows(held[0], place, *held[1:])
            if len(n) > 1:
                yield rows(keys[:-1], place, to[:-1], rise[:-1], n[:-1])
            held = keys[-1:], to[-1:], rise[-1:], n[-1:]
        if held is not None:
            yield rows(held[0], place, *held[1:])

    dealt = events.select(key, action, *order).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    found = dealt.select(key, action, F.spark_partition_id().alias("place")).mapInArrow(run, schema)
    # ranges are in order, so the number of a partition is the place of its maps
    return found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "to", "rise", "n"))).alias("parts"))


def applied(found: DataFrame, key: str, states: DataFrame | None = None) -> DataFrame:
    """``key``, state (number), count, n: where ``maps`` lead from ``states`` (key, state, count, n), or from the first state for keys that these don't have."""
    zero = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("n"))
    if states is not None:
        found = found.join(states, key, "left").select(key, "parts", F.struct(F.coalesce("state", F.lit(0)).alias("state"), F.coalesce("count", F.lit(0).cast("long")).alias("count"), F.coalesce("n", F.lit(0).cast("long")).alias("n")).alias("zero"))
        zero = F.col("zero")
    step = lambda s, x: F.struct(F.get(x["to"], s["state"]).alias("state"), (s["count"] + F.get(x["rise"], s["state"])).alias("count"), (s["n"] + x["n"]).alias("n"))
    return found.select(key, F.aggregate("parts", zero, step).alias("s")).select(key, "s.*")


def folded(events: DataFrame, key: str, machine: Machine, order: tuple[str, ...] = ("ts", "event_id"), action: str = "action") -> DataFrame:
    """``key``, state (number), count, n: where the actions of each key, in ``order``, lead from the first state (see ``maps``)."""
    return applied(maps(events, key, machine, order, action), key)


def numbered(rows: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """``rows`` with ``name`` (long): the place of each in its group by ``order`` (columns or orders), from 0.

    Rows are dealt by ranges of (group, order), so a group of most rows is many tasks' work: each numbers what it has of a group, and only the counts of these parts are summed up in order.
    """
    dealt = files.stored(rows.repartitionByRange(F.col(group), *order).withColumn("_place", F.spark_partition_id()))
    counts = dealt.groupBy(group, "_place").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_place")) - F.col("_n")
    local = F.row_number().over(W.partitionBy(group, "_place").orderBy(*order)) - 1
    at = F.struct(group, "_place").alias("_at")  # a group that is null is one too
    j = dealt.withColumn("_k", local).withColumn("_at", at).join(counts.withColumn("_before", before).select(at, "_before"), "_at")
    return j.select(*rows.columns, (F.col("_k") + F.col("_before")).cast("long").alias(name))


def named(states: list, column: str = "state"):
    """The name of a state's number."""
    return F.element_at(F.array(*[F.lit(s) for s in states]), F.col(column) + 1)


def stepped(rows: DataFrame, key: str, machine: Machine, actions: DataFrame) -> DataFrame:
    """``key``, was, status, refused: what one action for each key (``actions``: key, action) makes of the states of ``rows`` (key, status), by the machine's rules; refused if these don't allow it, the status being kept, or if there is no such row."""
    moves = {f"{s}|{a}": machine.states[int(to[k])] for a, to in machine.to.items() for k, s in enumerate(machine.states) if to[k] != k}
    known = F.create_map(*[F.lit(x) for kv in moves.items() for x in kv])
    j = actions.select(key, "action").join(rows.select(key, F.col("status").alias("was")), key, "left")
    to = F.try_element_at(known, F.concat_ws("|", "was", "action"))
    return j.select(key, "was", F.coalesce(to, "was").alias("status"), to.isNull().alias("refused"))
