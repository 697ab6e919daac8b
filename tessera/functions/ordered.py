"""Sequential rules over sorted groups, with a carried state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def in_order(df: DataFrame, keys, order, start, schema: str) -> DataFrame:
    """The keys and one row of schema for each row of df, by a rule that reads a group's rows in order.

    start() gives a group's rule: a function of the order columns (the first ones sort) that
    remembers what it needs and returns a tuple. Groups are sorted in their partitions and read
    batch by batch, so no group is ever held whole and time grows with its rows.
    """
    sorted_ = df.select(*keys, *order).repartition(*keys).sortWithinPartitions(*keys, order[0], *[c for c in order[1:] if dict(df.dtypes)[c] != "array<int>"])
    names, kinds = [c.split()[0] for c in schema.split(", ")], dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rule = None, None
        for batch in batches:
            found, out = [], []
            for row in zip(*(batch[c].tolist() for c in (*keys, *order))):
                key = tuple(None if k != k else k for k in row[: len(keys)])
                if held != key:
                    held, rule = key, start()
                found.append(key)
                out.append(rule(*row[len(keys) :]))
            yield pd.DataFrame({**{k: [f[i] for f in found] for i, k in enumerate(keys)}, **{n: [o[i] for o in out] for i, n in enumerate(names)}})

    return sorted_.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema)
