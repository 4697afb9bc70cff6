"""First-k records and profiles per key when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States and bytes that one task's table holds before it is spilled downstream and begun anew.
TABLE_STATES, TABLE_BYTES = 1 << 19, 64 << 20
#: Rows gathered before they are merged into the table.
BATCH_ROWS = 1 << 17


def smallest_states(t: pa.Table, k: int) -> pa.Table:
    """The ``k`` smallest distinct tuples of the columns after the first, for each value of the first one.

    Nulls come first; NaN comes last, as Spark orders it.
    """
    if not t.num_rows:
        return t
    t = t.combine_chunks()
    codes = pc.dictionary_encode(t.column(0).chunk(0)).indices
    by, cols = [("g", "ascending")], {"g": codes}
    for i, name in enumerate(t.column_names[1:]):
        c = t.column(name).chunk(0)
        if pa.types.is_floating(c.type):
            cols[f"n{i}"] = pc.fill_null(pc.is_nan(c), False)
            by.append((f"n{i}", "ascending"))
        elif pa.types.is_boolean(c.type):
            c = c.cast(pa.int8())
        cols[f"c{i}"] = c
        by.append((f"c{i}", "ascending"))
    order = pc.sort_indices(pa.table(cols), sort_keys=by, null_placement="at_start")
    g = codes.take(order).to_numpy(zero_copy_only=False)
    first = np.ones(len(g), bool)
    first[1:] = g[1:] != g[:-1]
    new = first.copy()
    for i in range(t.num_columns - 1):
        c = cols[f"c{i}"].take(order)
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        null_a, null_b = pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(null_a, null_b))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    rank = np.cumsum(new)
    rank -= np.repeat(rank[first], np.diff(np.append(np.flatnonzero(first), len(g)))) - 1
    kept = new & (rank <= k)
    return t.take(pa.array(np.sort(order.to_numpy()[kept])))


def combining(k: int, table_states: int = TABLE_STATES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map-side combiner: one bounded table of states per task, spilled downstream whenever it is full.

    A spilled state is merged with the others of its key after the shuffle, so spilling never changes the result. Rows
    that repeat a state end here, and a key holds at most ``k`` states of a table whatever its number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: pa.Table | None = None
        waiting: list[pa.RecordBatch] = []
        n = 0

        def merged() -> pa.Table:
            new = pa.Table.from_batches(waiting)
            waiting.clear()
            return smallest_states(pa.concat_tables([table, new]) if table is not None else new, k)

        for b in batches:
            if not b.num_rows:
                continue
            waiting.append(b)
            n += b.num_rows
            # as many new rows as there are states: each state is sorted again a constant number of times
            if n >= max(min(BATCH_ROWS, table_states), table.num_rows if table is not None else 0):
                table, n = merged(), 0
                if table.num_rows > table_states or table.nbytes > TABLE_BYTES:
                    yield from table.combine_chunks().to_batches(max_chunksize=20_000)
                    table = None
        if waiting:
            table = merged()
        if table is not None:
            yield from table.combine_chunks().to_batches(max_chunksize=20_000)

    return run


def first_k_per_key(df: DataFrame, key: str, order: list[str], k: int, table_states: int = TABLE_STATES) -> DataFrame:
    """The ``k`` smallest distinct ``order`` tuples of every non-null ``key``, with their position from 1.

    Map-side combining: each task keeps a bounded table of mergeable states (:func:`combining`), and only what it spills
    and what it holds at the end is shuffled. A key holding a third of all rows, or one record delivered a million
    times, sends at most ``k`` states per table, whatever ``k`` is; the states of a key are then ranked after one exchange.

    Nulls: a null key yields nothing; a null in an order column sorts first. Repeated rows (same key and order tuple)
    count once. Empty input gives an empty result. Columns not named are never read. Key and order columns are of
    primitive types.
    """
    names = [f"__o{i}" for i in range(len(order))]
    states = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), *[F.col(c).alias(n) for c, n in zip(order, names)])
    compact = states.mapInArrow(combining(k, table_states), states.schema)
    # one exchange: its clustering by key also serves the distinct states and the rank
    distinct = compact.repartition(F.col("__key")).dropDuplicates(["__key", *names])
    w = Window.partitionBy("__key").orderBy(*names)
    firsts = distinct.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return firsts.select(F.col("__key").alias(key), *[F.col(n).alias(c) for n, c in zip(names, order)], F.col("__r").alias("position"))


def key_profile(df: DataFrame, key: str, at: str, aggs: dict[str, Column] | None = None) -> DataFrame:
    """Count, first and last time (and further algebraic aggregates) per non-null key; partial hash aggregation only.

    Repeated rows are counted as delivered; de-duplicate before if one record may be delivered again.
    """
    base = [F.count(F.lit(1)).alias("n_rows"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen")]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*base, *[c.alias(n) for n, c in (aggs or {}).items()])
