"""Sizes as text: '5GB', '1.5 KB', '300B' (units of 1024)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}
_FORM = re.compile(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*([KMGT]?B)\s*", re.IGNORECASE)


def parse_size(text: str) -> int:
    """Bytes; fractions of a byte are cut off.  Any other form is a ValueError."""
    found = _FORM.fullmatch(text)
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(float(found[1]) * UNITS[found[2].upper()])


def size_column(text: Column) -> Column:
    """The same for a column; null where the form is another."""
    form = r"^\s*(\d+(?:\.\d*)?|\.\d+)\s*([KMGT]?B)\s*$"
    upper = F.upper(text)
    unit = F.regexp_extract(upper, form, 2)
    factor = F.lit(None).cast("double")
    for name, value in UNITS.items():
        factor = F.when(unit == name, F.lit(float(value))).otherwise(factor)
    return F.floor(F.regexp_extract(upper, form, 1).try_cast("double") * factor).cast("long")
