"""Streams of sorted rows taken apart by key within a task, for kernels that need a key's rows together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys, or evenly, to two tasks a core at least.

    Adaptive execution joins partitions of few bytes, whatever work Python has with them, but not where their number is given.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def _differs(a, b) -> np.ndarray:
    return pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.not_equal(a, b)).to_numpy(zero_copy_only=False)


def key_runs(batches, keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """`(key values, rows)` of each run of equal keys over Arrow batches that are sorted by them; a run may go on over batches, and is held until it ends."""
    held, name = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for k in keys:
            change[1:] |= _differs(batch.column(k).slice(1), batch.column(k).slice(0, n - 1))
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and now != name:
                yield name, pa.Table.from_batches(held)
                held = []
            name = now
            held.append(batch.slice(a, b - a))
    if held:
        yield name, pa.Table.from_batches(held)


def whole_runs(batches, keys: list[str], most: int = 1 << 16) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """`(rows, sizes)` of Arrow batches that are sorted by keys: about `most` rows of runs of equal keys at a time, each run whole, and how many rows each has."""
    held: list[pa.RecordBatch] = []
    size = 0

    def together(parts):
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
        change = np.zeros(rows.num_rows, bool)
        change[0] = True
        for k in keys:
            change[1:] |= _differs(rows.column(k).slice(1), rows.column(k).slice(0, rows.num_rows - 1))
        return rows, np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        last, size = batch.slice(batch.num_rows - 1), size + batch.num_rows
        if size < most or held and all(last.column(k)[0].as_py() == held[0].column(k)[0].as_py() for k in keys):  # or one run goes on over the whole batch
            held.append(batch)
            continue
        rows, begins = together([*held, batch])
        end = int(begins[-1])
        held, size = [rows.slice(end)], rows.num_rows - end
        if end:
            yield rows.slice(0, end), np.diff(begins)
    if held:
        rows, begins = together(held)
        yield rows, np.diff(np.append(begins, rows.num_rows))
