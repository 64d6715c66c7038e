"""The N best items of every group, by partition lower bounds.

Each task keeps, per group, the N best of the rows it reads; the score of the N-th of them is a
lower bound of the group's N-th best score.  The highest bound of each group is joined to the
survivors, rows below it leave, and only the rest is ranked.  A group with a third of all rows
reaches the ranking with at most N rows per block of input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.storage import materialize

BOUND = "_bound"


def _group_numbers(rows: pa.Table, group: list[str]) -> np.ndarray:
    """A number per row, equal for rows of one group; nulls are equal."""
    number = np.zeros(rows.num_rows, np.int64)
    for name in group:
        codes = rows.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.unique(number * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
    return number


def _best(rows: pa.Table, group: list[str], order: list[str], n: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(rows, group numbers, ranks from 0) of the first ``n`` distinct rows of each group.

    Order is score descending, the others ascending with nulls first, strings by their bytes;
    all values stay in Arrow, so large integers are exact.
    """
    rows = rows.group_by(rows.column_names, use_threads=False).aggregate([])
    number = _group_numbers(rows, group)
    sorted_by = rows.select(order).rename_columns([f"o{i}" for i in range(len(order))]).append_column("g", pa.array(number))
    keys = [("g", "ascending"), ("o0", "descending"), *((f"o{i}", "ascending") for i in range(1, len(order)))]
    at = pc.sort_indices(sorted_by, sort_keys=keys, null_placement="at_start").to_numpy()
    number = number[at]
    begins = np.concatenate([[True], number[1:] != number[:-1]]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(begins)
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    keep = rank < n
    return rows.take(pa.array(at[keep])), number[keep], rank[keep]


def block_survivors(df: DataFrame, group: list[str], score: str, ties: list[str], key: str, n: int, block_rows: int = 200_000) -> DataFrame:
    """Rows that are among the first ``n`` of their group within their block of input.

    ``_bound`` is the block's N-th best score of the group, null where it has fewer rows.  A
    block ends with its partition, or when ``block_rows`` rows are left after thinning, so
    memory is bounded whatever the number of groups.
    """
    order = [score, *ties, *([] if key in ties else [key])]
    columns = list(dict.fromkeys([*group, *order]))
    schema = T.StructType([*df.select(*columns).schema.fields, T.StructField(BOUND, df.schema[score].dataType, True)])

    def closed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, number, rank = _best(rows, group, order, n)
        place = np.full(number.max(initial=-1) + 1, -1, np.int64)
        place[number[rank == n - 1]] = np.flatnonzero(rank == n - 1)
        last = place[number]
        bounds = rows.column(score).take(pa.array(last, pa.int64(), mask=last < 0))
        yield from rows.append_column(BOUND, bounds).combine_chunks().to_batches()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                size += batch.num_rows
            if size >= block_rows:
                thinned = _best(pa.concat_tables(held), group, order, n)[0]
                held, size = [thinned], thinned.num_rows
                if size >= block_rows // 2:
                    yield from closed(thinned)
                    held, size = [], 0
        if size:
            yield from closed(pa.concat_tables(held))

    return df.select(*columns).mapInArrow(blocks, schema)


def top_items(df: DataFrame, group: list[str], score: str, ties: list[str], key: str, n: int = 5) -> DataFrame:
    """(group columns, key, score, ties, item_rank) of the first ``n`` rows of every group.

    Order is score descending, then ``ties`` ascending (strings in binary order), then ``key``.
    Rows with a null score or null key are left out; a null in a group column is a group of its
    own; null ties come first.  A re-delivered item (same key, score and ties) counts once.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(key).isNotNull())
    survivors = materialize(block_survivors(rows, group, score, ties, key, n), "block-survivors")
    bounds = survivors.groupBy(*group).agg(F.max(BOUND).alias("_least")).where("_least is not null")
    bounds = bounds.select(*(F.col(g).alias(f"_g_{i}") for i, g in enumerate(group)), "_least")
    same = [survivors[g].eqNullSafe(bounds[f"_g_{i}"]) for i, g in enumerate(group)]
    kept = survivors.join(bounds, same, "left").where(F.col("_least").isNull() | (F.col(score) >= F.col("_least")))
    columns = list(dict.fromkeys([*group, key, score, *ties]))
    ranked = Window.partitionBy(*group).orderBy(F.col(score).desc(), *(F.col(c).asc() for c in [*ties, key]))
    return kept.select(*columns).distinct().withColumn("item_rank", F.row_number().over(ranked)).where(F.col("item_rank") <= n)
