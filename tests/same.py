"""Comparison of two frames as sets of rows, doubles to six digits."""

import math

import pandas as pd


def rows(df):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{float(v):.5f}".replace("-0.00000", "0.00000")
        except (TypeError, ValueError):
            return pd.Timestamp(v).isoformat() if hasattr(v, "year") else str(v)

    names = sorted(df.columns)
    return sorted(tuple(cell(v) for v in r) for r in df[names].astype(object).where(df[names].notna(), None).itertuples(index=False))
