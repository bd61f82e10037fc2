"""Comparing result tables without regard to the order of rows and columns."""

import pandas as pd


def _clean(v):
    if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
        return None
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(_clean(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)
