"""Ordered per-key scans for rules that depend on all rows before.

Rows are partitioned by key and sorted by Spark (the sort spills); Python sees them as a stream of Arrow batches and keeps
only the state of the current key. A key is never collected, however long it is.
"""

from __future__ import annotations

from typing import Any, Callable, Iterable, Protocol, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


class Scan(Protocol):
    """State of one key: `step` takes one row, `finish` ends the key; both return output rows."""

    def step(self, row: dict[str, Any]) -> Iterable[tuple]: ...

    def finish(self) -> Iterable[tuple]: ...


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], factory: Callable[[tuple], Scan],
                 schema: T.StructType | str, dealt: bool = False) -> DataFrame:
    """`dealt` says that the rows of a key are in one partition already."""
    keys = list(keys)
    spark = df.sparkSession
    out_schema = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
    columns = [f.name for f in out_schema.fields]
    names = df.columns

    def run(batches):
        current, state = None, None
        for batch in batches:
            out: list[tuple] = []
            data = [batch[n].tolist() for n in names]
            for values in zip(*data):
                row = dict(zip(names, values))
                # A null key arrives as NaN or None, depending on its type; nulls are one key.
                key = tuple(None if row[k] != row[k] else row[k] for k in keys)
                if key != current:
                    if state is not None:
                        out.extend(state.finish())
                    current, state = key, factory(key)
                out.extend(state.step(row))
            if out:
                yield pd.DataFrame(out, columns=columns)
        if state is not None:
            rest = list(state.finish())
            if rest:
                yield pd.DataFrame(rest, columns=columns)

    ordered = (df if dealt else df.repartition(*keys)).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, out_schema)


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Places in a sorted table where a new key begins; nulls are one key."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = table[k]
        a, b = column.slice(0, len(column) - 1), column.slice(1)
        apart = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(a.type):
            apart = pc.and_(apart, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
        new[1:] |= pc.or_(apart, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]):
    """Tables of whole keys with the places where each begins, from batches sorted by key. It holds a batch and the rows of one key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        begin = group_starts(table, keys)
        last = int(begin[-1])
        if last:
            yield table.slice(0, last), begin[:-1]
        held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.zeros(1, np.int64)


def ordered_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], factory: Callable[[], Callable[..., int]],
                    columns: Sequence[str], name: str, dealt: bool = False) -> DataFrame:
    """`ordered_scan` for a rule that gives every row one number, from some columns of doubles: `factory` makes the rule of a key. The rows
    themselves pass through as Arrow batches, untouched. `dealt`: as in `ordered_scan`."""
    keys = list(keys)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])

    def run(batches):
        current, rule = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            begin = group_starts(pa.Table.from_batches([batch]), keys).tolist()
            data = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in columns]
            numbers: list[int] = []
            for a, b in zip(begin, [*begin[1:], batch.num_rows]):
                key = tuple(None if v != v else v for v in (batch.column(k)[a].as_py() for k in keys))
                if rule is None or key != current:
                    current, rule = key, factory()
                numbers.extend(map(rule, *[d[a:b] for d in data]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int32())], [*batch.schema.names, name])

    ordered = (df if dealt else df.repartition(*keys)).sortWithinPartitions(*keys, *order)
    return ordered.mapInArrow(run, schema)
