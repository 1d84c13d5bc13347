"""Places and running sums of rows by key in a distributed order.

The rows are dealt to tasks by ranges of (key, order), so that a key with very many rows lies in many tasks. A first pass
brings one line for each partition to the driver (its first and last key and what the last key has run up to there), a
second pass numbers the rows from what the partitions before have left. No key is ever gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import cut

MASK = 2**64 - 1


def _number(batch: pa.RecordBatch, sums: list[str], state: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places and running sums of one batch; `state` ([key, rows so far, sums so far]) goes on to the next."""
    keys = batch.column("__key").to_numpy()
    n = len(keys)
    new = np.r_[state[0] is None or keys[0] != state[0], keys[1:] != keys[:-1]]
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(new, at, -1))
    place = np.where(start < 0, at + state[1], at - start)
    running = []
    for i, name in enumerate(sums):
        total = np.cumsum(batch.column(name).to_numpy().view(np.uint64), dtype=np.uint64)
        before = np.where(start > 0, total[start - 1], np.uint64(0))
        running.append(total - before + np.where(start < 0, np.uint64(state[2][i]), np.uint64(0)))
    state[:] = [keys[-1], int(place[-1]) + 1, [int(r[-1]) for r in running]]
    return place, running


def _tails(sums: list[str]):
    def run(batches):
        state, first, lines, pid = [None, 0, [0] * len(sums)], None, 0, None
        for batch in batches:
            if batch.num_rows:
                first = int(batch.column("__key")[0].as_py()) if first is None else first
                pid = batch.column("__pid")[0].as_py()
                _number(batch, sums, state)
                lines += batch.num_rows
        if pid is not None:
            held = [str(x) for x in state[2]]
            yield pa.RecordBatch.from_pylist([{"pid": pid, "first": first, "last": int(state[0]), "n": state[1], "whole": state[1] == lines, "sums": held}], pa.schema([("pid", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_()), ("sums", pa.list_(pa.string()))]))

    return run


def _places(sums: list[str], left: dict[int, tuple]):
    def run(batches):
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                key, n, held = left.get(batch.column("__pid")[0].as_py(), (None, 0, [0] * len(sums)))
                state = [key, n, list(held)]
            place, running = _number(batch, sums, state)
            out = {name: batch.column(name) for name in batch.schema.names if name not in ("__key", "__pid")}
            out["at"] = pa.array(place.astype(np.int64))
            for name, total in zip(sums, running):
                out[f"{name}_sum"] = pa.array(total.view(np.int64))
                out[f"{name}_before"] = pa.array((total - batch.column(name).to_numpy().view(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_pydict(out)

    return run


def placed(df: DataFrame, key: list[str], order: list[Column], sums: list[str] | tuple = ()) -> DataFrame:
    """`df` with `at` (long, from 0), the place of each row among those of its key in the given order, and for each long column
    of `sums` its running sum modulo 2**64 with and without the row itself (`<name>_sum`, `<name>_before`).

    df: a checkpointed table. Rows that are equal in key and order stand in the order in which the table holds them.
    """
    sums, names = list(sums), df.columns
    # The row's own place in the table parts rows that are equal in all else, however many they are.
    by = [*[F.col(k).asc_nulls_first() for k in key], *order, F.col("__tie")]
    ordered = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    ordered = cut(ordered.select(*names, F.xxhash64(*key).alias("__key")))
    ordered = ordered.withColumn("__pid", F.spark_partition_id())
    tails = ordered.select("__key", "__pid", *sums).mapInArrow(_tails(sums), "pid int, first long, last long, n long, whole boolean, sums array<string>")
    left, before = {}, None
    for t in sorted(tails.collect()):
        own = (t.last, t.n, [int(x) for x in t.sums])
        if before and before[0] == t.first:
            left[t.pid] = before
            if t.whole:
                own = (t.last, t.n + before[1], [(a + b) & MASK for a, b in zip(own[2], before[2])])
        before = own
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema if f.name not in ("__key", "__pid")]
    schema += ["at long", *[f"`{s}{end}` long" for s in sums for end in ("_sum", "_before")]]
    return ordered.mapInArrow(_places(sums, left), ", ".join(schema))
