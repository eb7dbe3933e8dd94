"""Order-dependent folds: each key's rows pass through in order, batch by batch, with only a small state kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def scan_sorted(df: DataFrame, key: str, order: list[str], start: Callable[[], Any],
                step: Callable[[Any, pd.DataFrame, bool], pd.DataFrame], schema: str, whole: str | None = None) -> DataFrame:
    """Fold ``step(state, rows, last)`` over the rows of each key, sorted by ``order``.

    A key's rows are never gathered: the sort spills, Arrow batches stream through, and rows are handed over batch
    by batch. With ``whole`` set, rows that share its value (one frame) always arrive in one call.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, held = None, None, None
        for pdf in batches:
            cuts = pdf[key].ne(pdf[key].shift()).cumsum()
            for _, part in pdf.groupby(cuts, sort=False):
                k = part[key].iloc[0]
                if k != current:
                    if held is not None:
                        yield step(state, held, True)
                    current, state, held = k, start(), None
                if whole is None:
                    yield step(state, part, False)
                    continue
                if held is not None:
                    part = pd.concat([held, part], ignore_index=True)
                tail = part[whole] == part[whole].iloc[-1]
                held = part[tail]
                if (~tail).any():
                    yield step(state, part[~tail], False)
        if held is not None:
            yield step(state, held, True)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
