"""Adapter for sequential kernels: rows of each key in order, in batches, with state carried from batch to batch.

A task holds one Arrow batch and one kernel at a time, so neither long nor many series need memory."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


class Fold:
    """State of one key. rows() gets its next rows and returns rows of the result; end() returns what is left."""

    def rows(self, part: pd.DataFrame) -> pd.DataFrame | None:
        raise NotImplementedError

    def end(self) -> pd.DataFrame | None:
        return None


class PerRow(Fold):
    """A kernel with a value for each row, added as a column."""

    def __init__(self, value: Callable[[tuple], object], inputs: list[str], name: str):
        self.value, self.inputs, self.name = value, inputs, name

    def rows(self, part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(**{self.name: [self.value(*x) for x in zip(*(part[c].tolist() for c in self.inputs), strict=True)]})


def ordered_fold(df: DataFrame, by: str, at: list[str], make: Callable[[], Fold], schema) -> DataFrame:
    """Applies make()'s kernel to the rows of each key, ordered by `at`."""

    def run(batches):
        current, state = None, None
        for pdf in batches:
            for key, part in pdf.groupby(by, sort=False, dropna=False):
                if state is None or key != current:
                    if state is not None and (left := state.end()) is not None and len(left):
                        yield left
                    current, state = key, make()
                if (out := state.rows(part)) is not None and len(out):
                    yield out
        if state is not None and (left := state.end()) is not None and len(left):
            yield left

    return df.repartition(by).sortWithinPartitions(by, *at).mapInPandas(run, schema)


def with_column(df: DataFrame, name: str, kind: str):
    """Schema of df with one more column."""
    from pyspark.sql.types import StructType

    return StructType(list(df.drop(name).schema.fields)).add(name, kind)
