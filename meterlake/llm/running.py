"""Running sums along a key's rows in order, dealt by ranges, so that one key's rows may lie in many tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.scratch import table


def _along(values: list[int], kept: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of the columns at ``values`` since the key (the first column) last changed, in the task's part of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, have = TaskContext.get().partitionId(), None, [0] * len(values)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            sums = []
            for j, at in enumerate(values):
                total = np.concatenate([[0], np.cumsum(batch.column(at).to_numpy(), dtype=np.int64)])
                before = total[starts]
                if keys[0] == last:
                    before[0] -= have[j]
                sums.append(total[1:] - before[group])
                have[j] = int(sums[-1][-1])
            last = keys[-1]
            columns = [*(batch.column(i) for i in kept), pa.array(np.full(n, part, np.int32)), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, [*(batch.schema.names[i] for i in kept), "_part", *(f"_s{j}" for j in range(len(values)))])

    return run


def running_sums(rows: DataFrame, key: str, order: list, sums: dict[str, str], keep: list[str]) -> DataFrame:
    """``key``, the columns ``keep``, and for each of ``sums`` (new name: column of non-negative longs) its sum over the key's rows up to this one.

    ``key`` is a long without nulls; ``order`` may name columns that aren't kept. Rows are dealt by ranges of (key, order) and
    summed within a task; what a key has in tasks before is added afterwards. Only a key at the edge of a range
    reaches over several tasks, so that such sums are no more than twice the tasks, whatever the input.
    Rows that are equal in key and order stay in one task.
    """
    spark = rows.sparkSession
    first = [key, *(k for k in keep if k != key)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = list(dict.fromkeys([*first, *sums.values()]))
    dealt = rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).select(named)
    kinds = [f"{c} {dealt.schema[c].dataType.simpleString()}" for c in first]
    schema = ", ".join([*kinds, "_part int", *(f"_s{j} long" for j in range(len(sums)))])
    made = [F.col(f"_s{j}") for j in range(len(sums))]
    stored = table(dealt.mapInArrow(_along([named.index(c) for c in sums.values()], list(range(len(first)))), schema), "running")
    edges = sorted(stored.groupBy("_part").agg(F.min(key), F.max(key)).collect())
    over = {b[1] for a, b in zip(edges, edges[1:], strict=False) if a[2] == b[1]}
    carried, seen = [], {}
    if over:
        ends = stored.where(F.col(key).isin(*over)).groupBy(key, "_part").agg(*(F.max(c) for c in made)).collect()
        for k, part, *totals in sorted(ends):
            before = seen.get(k, [0] * len(sums))
            carried.append((k, part, *before))
            seen[k] = [a + b for a, b in zip(before, totals, strict=True)]
    if not carried:
        return stored.select(*first, *(c.alias(name) for c, name in zip(made, sums, strict=True)))
    carry = spark.createDataFrame(carried, ", ".join([f"{key} long", "_part int", *(f"_c{j} long" for j in range(len(sums)))]))
    joined = stored.join(F.broadcast(carry), [key, "_part"], "left")
    return joined.select(*first, *((c + F.coalesce(F.col(f"_c{j}"), F.lit(0))).alias(name) for j, (c, name) in enumerate(zip(made, sums, strict=True))))
