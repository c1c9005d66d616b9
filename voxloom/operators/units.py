"""User functions over pending units of work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_units(pending: DataFrame, key: list[str], column: str, fn: Callable[[object], str]) -> DataFrame:
    """Apply ``fn`` to ``column`` of every pending unit: one row with a result or an error.

    One failing unit does not stop the others; failed units stay pending and run again next time.
    """
    types = ", ".join(f"{k} {pending.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            results, errors = [], []
            for value in pdf[column]:
                try:
                    results.append(fn(value))
                    errors.append(None)
                except Exception as e:  # any failure belongs to its unit
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf[key].assign(result=results, error=errors)

    out = pending.select(*key, column).mapInPandas(run, f"{types}, result string, error string")
    return out.withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("failed"))
