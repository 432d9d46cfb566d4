"""User-supplied refinement of uncertain classifications."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REFINABLE = ("unclear", "possibly_supported")

FrameRefiner = Callable[[DataFrame], DataFrame]
BatchRefiner = Callable[[pd.DataFrame], pd.DataFrame]


def refine(df: DataFrame, refiner: FrameRefiner | None) -> DataFrame:
    """Hand only uncertain rows to the refiner; all other rows pass untouched.

    The contract is enforced by the split itself: deterministic negative or
    ineligible findings never reach the refiner, and it must return the same
    columns.
    """
    if refiner is None:
        return df
    open_class = F.col("sponsorship_classification").isin(*REFINABLE)
    refined = refiner(df.where(open_class))
    if refined.schema.simpleString() != df.schema.simpleString():
        raise ValueError("a refiner must return the schema it was given")
    return df.where(~F.coalesce(open_class, F.lit(False))).unionByName(refined)


def batch_refiner(batch: BatchRefiner) -> FrameRefiner:
    """Wrap a function over pandas batches; it runs inside tasks, via Arrow."""

    def over_frame(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield batch(rows)

        return df.mapInPandas(run, df.schema)

    return over_frame
