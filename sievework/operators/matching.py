"""Greedy matching without replacement, kept inside bounded groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def nearest_pairs(cases: DataFrame, controls: DataFrame, by: str, value: str, id_col: str) -> DataFrame:
    """Each case of a cohort, largest value first, takes the nearest control that is still free.

    Inherently sequential inside a cohort; cohorts are spread over tasks, and must be small.
    """

    def solve(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        free = dict(zip(b[id_col], b[value], strict=True))
        out = []
        for row in a.sort_values([value, id_col], ascending=[False, True]).itertuples():
            if free:
                own = getattr(row, value)
                near = min(free, key=lambda k: (abs(free[k] - own), k))
                out.append((key[0], getattr(row, id_col), near, abs(free.pop(near) - own)))
        return pd.DataFrame(out, columns=[by, "case_id", "control_id", "distance"])

    kinds = dict(cases.dtypes)
    schema = f"{by} {kinds[by]}, case_id {kinds[id_col]}, control_id {kinds[id_col]}, distance {kinds[value]}"
    cols = [by, id_col, value]
    return cases.select(*cols).groupBy(by).cogroup(controls.select(*cols).groupBy(by)).applyInPandas(solve, schema)
