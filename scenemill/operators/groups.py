"""Groups of rows solved in numpy: one exchange, whole groups in Arrow batches, no call a group from the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Columns = dict[str, np.ndarray]
#: Rows that a result batch holds at least, unless the groups end.
BATCH = 20_000


def as_numpy(column: pa.Array) -> np.ndarray:
    """Values of a column; vectors of one length become rows of a matrix, nulls NaN or None."""
    if pa.types.is_list(column.type):
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        if len(sizes) and column.null_count == 0 and (sizes == sizes[0]).all() and pa.types.is_floating(column.type.value_type):
            return column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)
        return np.array([*column.to_pylist(), None], object)[:-1]
    return column.to_numpy(zero_copy_only=False)


def solved(rows: DataFrame, keys: list[str], order: list[str], solve: Callable[[Columns], Columns], schema: str | T.StructType) -> DataFrame:
    """What ``solve`` gives for the columns of each group, whose rows come in the order.

    Null keys are a group of their own. A group is a keyframe, an instance or a scene, so it has a bound.
    """
    out = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)
    number = F.xxhash64(*(F.struct(F.isnull(k), k) for k in keys))
    dealt = rows.withColumn("__group", number).repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, *order)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        held: list[Columns] = []
        size = 0

        def result() -> pa.RecordBatch:
            columns = []
            for f in arrow:
                parts = [h[f.name] for h in held]
                if any(p.dtype == object or p.ndim > 1 for p in parts):
                    columns.append(pa.array([x.tolist() if isinstance(x, np.ndarray) else x for p in parts for x in p], f.type))
                else:
                    columns.append(pa.array(np.concatenate(parts), f.type, from_pandas=True))
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        def groups(t: pa.Table, last: bool) -> Iterator[tuple[int, int]]:
            group = t.column("__group").to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            ends = np.append(cut[1:], len(group))
            yield from zip(cut[: None if last else -1].tolist(), ends[: None if last else -1].tolist())

        def work(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest, held, size
            done = 0
            values = {n: as_numpy(t.column(n).combine_chunks()) for n in names}
            for a, b in groups(t, last):
                found = {k: np.asarray(v) for k, v in solve({n: v[a:b] for n, v in values.items()}).items()}
                held.append(found)
                size += len(next(iter(found.values())))
                done = b
                if size >= BATCH:
                    yield result()
                    held, size = [], 0
            rest = t.slice(done) if done < t.num_rows else None

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if t.num_rows:
                yield from work(t, False)
        if rest is not None and rest.num_rows:
            yield from work(rest, True)
        if size:
            yield result()

    return dealt.mapInArrow(run, out)


def first_of(group: Columns, *names: str) -> Columns:
    """The first value of columns that are constant in a group, as arrays of one."""
    return {n: group[n][:1] for n in names}
