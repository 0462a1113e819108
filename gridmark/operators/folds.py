"""Folds of many small groups without a cost for each group."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fold`` over the rows (tuples of all columns) of each group, in ``order``.

    Rows are dealt and sorted by the keys, and a partition is one pass: a grouped map would start
    pandas anew for each of thousands of groups of a few rows.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    at = [df.columns.index(k) for k in keys]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            yield from b.astype(object).where(b.notna(), None).itertuples(index=False, name=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for _, group in itertools.groupby(rows(batches), key=lambda r: tuple(r[i] for i in at)):
            out += fold(list(group))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
