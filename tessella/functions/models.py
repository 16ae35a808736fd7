"""Seams for models: a Python function over batches of texts becomes a column, loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F, types as T


def batch_column(load: Callable[[], Callable], returns: T.DataType):
    """load() gives a function from lists (one for each argument) to a list of results; the result is a column function."""
    @F.pandas_udf(returns)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for columns in batches:
            yield pd.Series(model(*[c.tolist() for c in columns]))

    return run


