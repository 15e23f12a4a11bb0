"""Classes from user expressions: threshold terms and class formulas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

_TERM = re.compile(r"(?:(-?\d+(?:\.\d+)?)\*)?(mean|median|mode|sd|std|mad|prctile\((\d+(?:\.\d+)?)\))")


def threshold(text: str, value: str, n: int = 0, mean: float | None = None) -> Column:
    """An aggregate from terms like ``0.5*mean + 2*std prctile(90)``, which are added; unknown terms are an error.

    ``mad``, the mean distance from the mean, needs the mean; percentiles, linear between samples
    that stand at (i - 1/2) / n, need the number of rows n.  ``threshold_of`` finds both.
    """
    out = F.lit(0.0)
    for text_term in text.replace("+", " ").split():
        term = _TERM.fullmatch(text_term)
        if not term:
            raise ValueError(f"unknown threshold term {text_term!r}")
        name = term[2]
        if name.startswith("prctile"):
            at = min(max(n * float(term[3]) / 100 + 0.5, 1), max(n, 1))
            stat = F.percentile(value, F.lit((at - 1) / (n - 1) if n > 1 else 0.0))
        elif name == "mad":
            stat = F.avg(F.abs(F.col(value) - F.lit(mean)))
        else:
            stat = {"mean": F.avg, "median": F.median, "mode": F.mode, "sd": F.stddev_samp, "std": F.stddev_samp}[name](value)
        out = out + F.lit(float(term[1] or 1)) * stat
    return out


def threshold_of(df: DataFrame, text: str, value: str) -> DataFrame:
    """One row (threshold) of a threshold over a table's column."""
    first = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).first()
    return df.agg(threshold(text, value, first["n"], first["mean"]).alias("threshold"))


def formula(text: str, names: list[str]) -> Column:
    """A class from columns ``names``: numbers, + - * / and brackets only."""
    if not re.fullmatch(rf"(?:\s|[-+*/()]|\d+(?:\.\d+)?|{'|'.join(map(re.escape, names))})+", text):
        raise ValueError(f"not a class formula: {text!r}")
    return F.expr(text)
