"""Band expressions: [+-] (number[*Cnn] or Cnn) joined by + and -."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import store
from .align import band_column

MAX_TERMS = 10
_TERM = re.compile(r"\s*([+-]?)\s*(?:(\d+(?:\.\d*)?|\.\d+)\s*(?:\*\s*[Cc](\d{1,2}))?|[Cc](\d{1,2}))\s*")


@dataclass(frozen=True)
class Combination:
    """bias + sum of coefficient x band."""

    terms: tuple[tuple[float, int], ...]
    bias: float

    @property
    def bands(self) -> list[int]:
        """Distinct bands in the order of first use."""
        return list(dict.fromkeys(b for _, b in self.terms))

    def column(self) -> Column:
        out = F.lit(self.bias)
        for k, b in self.terms:
            out = out + F.lit(k) * F.col(band_column(b))
        return out


def parse(text: str) -> Combination:
    """The combination that ``text`` writes; ValueError for anything else."""
    terms, bias, at, first = [], 0.0, 0, True
    while at < len(text):
        m = _TERM.match(text, at)
        if not m or m.end() == at or not (first or m[1]):
            raise ValueError(f"no band expression at {text[at:]!r}")
        sign = -1.0 if m[1] == "-" else 1.0
        band = m[3] or m[4]
        if band is None:
            bias += sign * float(m[2])
        else:
            if not 1 <= int(band) <= 16:
                raise ValueError(f"no band C{band}")
            terms.append((sign * float(m[2] or 1), int(band)))
        at, first = m.end(), False
    if not terms or len(terms) > MAX_TERMS:
        raise ValueError("an expression has 1 to 10 bands")
    return Combination(tuple(terms), bias)


def parse_rgb(text: str) -> list[Combination]:
    """Three expressions joined by semicolons; fewer are an error, more are ignored."""
    parts = text.split(";")
    if len(parts) < 3:
        raise ValueError("three expressions are needed")
    return [parse(p) for p in parts[:3]]


def required_bands(text: str) -> list[int]:
    """Ascending bands of all expressions of a text."""
    return sorted({b for p in text.split(";") for b in parse(p).bands})


def band_expr(wide: DataFrame, text: str, out: str = "value") -> DataFrame:
    """``wide`` with the expression's value; missing where any of its bands is."""
    return wide.withColumn(out, parse(text).column())


def recipes(pixels: DataFrame, terms: DataFrame) -> DataFrame:
    """Many expressions at once: terms(recipe, band, coeff, bias, n_terms) with one row per band used.

    Terms are broadcast only where Spark knows them to be small; else the pixels of a band are dealt to many tasks.
    """
    joined = store.with_facts(pixels, terms, "band")
    whole = F.count("value") == F.first("n_terms")
    return joined.groupBy("recipe", "scene_id", "y", "x").agg(F.when(whole, F.first("bias") + F.sum(F.col("coeff") * F.col("value"))).alias("value"))
