"""Rhythm windows on a stream of annotations: an extension beyond the batch operators.

The state of a record is its open onsets (those whose offset has not come) and the first reference after each; a window
goes out when its offset arrives. Marks of a record must arrive in order of sample; a mark that comes late is left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.operators.annotations import criteria

_OUT = "record_id string, window_id int, onset int, offset int, qrs int"
_STATE = "last int, n int, onset int, qrs int"


def stream_windows(annotations: DataFrame, onset: Mapping[str, object], offset: Mapping[str, object], reference: Mapping[str, object], key: str = "record_id") -> DataFrame:
    """Sinus windows of a streaming annotation table, in append mode.

    Between an onset and its offset no other onset may lie, so only the latest onset can still give a window; the state of
    a record is four numbers, whatever its length.
    """
    a = annotations.filter(F.col("sample").isNotNull()).select(
        F.col(key).cast("string").alias("record_id"), F.col("sample").cast("int").alias("sample"),
        F.coalesce(criteria(annotations, onset), F.lit(False)).alias("is_on"), F.coalesce(criteria(annotations, offset), F.lit(False)).alias("is_off"),
        F.coalesce(criteria(annotations, reference), F.lit(False)).alias("is_ref"),
    )

    def step(key_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n, on, ref = state.get if state.exists else (-1, 0, -1, -1)
        rows = pd.concat(list(frames)).sort_values("sample", kind="stable")
        out = []
        for s, marks in rows.groupby("sample", sort=True):
            if s < last:
                continue
            last = int(s)
            if on >= 0 and s > on and marks["is_off"].any():
                if on < ref < s:
                    n += 1
                    out.append((key_[0], n, on, last, ref))
                on, ref = -1, -1
            elif on >= 0 and ref < 0 and s > on and marks["is_ref"].any():
                ref = last
            if marks["is_on"].any():
                on, ref = last, -1
        state.update((last, n, on, ref))
        yield pd.DataFrame(out, columns=["record_id", "window_id", "onset", "offset", "qrs"])

    return a.groupBy("record_id").applyInPandasWithState(step, _OUT, _STATE, "append", "NoTimeout")
