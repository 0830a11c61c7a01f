"""The rounding contract of documents: seconds 3 places, dB 2, Hz 1, BPM 1, ratios 3, money 4.

Halves go up, on the binary value: ``floor(x * 10^d + 0.5) / 10^d``. Engines differ in ``round`` on halves; this form gives the
same result in all of them. It isn't Python's ``round`` on exact ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = {"seconds": 3, "db": 2, "hz": 1, "bpm": 1, "ratio": 3, "usd": 4}


def rounded(x: Column | str, kind: str | int) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10 ** (kind if isinstance(kind, int) else PLACES[kind]))
    return F.floor(x * scale + 0.5).cast("double") / scale


def rounded_sql(x: str, kind: str | int) -> str:
    """The same as an SQL expression."""
    scale = f"{10 ** (kind if isinstance(kind, int) else PLACES[kind])}.0"
    return f"(floor(({x}) * {scale}::double + 0.5) / {scale}::double)"


def half_even(x: Column | str) -> Column:
    """Nearest integer, ties to the even one."""
    return F.bround(F.col(x) if isinstance(x, str) else x, 0).cast("long")
