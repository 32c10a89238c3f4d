"""Ordered folds: rules whose next step depends on what was decided before.

Rows of one key meet in one task, sorted, and stream through it batch by batch; only the rule's own small state is held, so
a key may have any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, out: str) -> DataFrame:
    """``df`` with the columns ``out`` (a schema) that ``step(state, row) -> (state, values)`` gives, key by key in order.

    ``start()`` makes a key's first state. Rows are tuples in the order of ``df.columns``. Null keys form a key of their own.
    """
    names = df.columns
    at = [names.index(k) for k in keys]
    new = [c.split()[0] for c in out.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for batch in batches:
            values = []
            for row in batch.itertuples(index=False, name=None):
                key = tuple(None if row[i] != row[i] else row[i] for i in at)
                if key != last:
                    last, state = key, start()
                state, got = step(state, row)
                values.append(got)
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(values, columns=new)], axis=1)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [out])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
