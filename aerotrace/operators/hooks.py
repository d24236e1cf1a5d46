"""Hook for model scorers: load once per task, then score batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def score(df: DataFrame, load: Callable[[], object], infer: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``infer(model, batch)`` to Arrow batches; ``load()`` runs once per task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield infer(model, b)

    return df.mapInPandas(run, schema)
