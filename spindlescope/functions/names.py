"""String, date, math and array helpers shared by the operators; all are column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model-name prefixes per vendor, tried in this order.
VENDOR_PREFIXES = (("S", "Seagate"), ("HG", "HGST"), ("T", "Toshiba"), ("W", "WDC"), ("Hi", "Hitachi"))


def smart_id(column: str) -> int | None:
    """The attribute number in a column name such as ``smart_187_raw``."""
    found = re.match(r"smart_(\d+)_", column)
    return int(found.group(1)) if found else None


def split_list(text: str) -> list[str]:
    return [part.strip() for part in text.split(",") if part.strip()]


def vendor_of(model: Column) -> Column:
    """Vendor by model-name prefix, ``Unknown`` for anything else."""
    out = None
    for prefix, vendor in VENDOR_PREFIXES:
        hit = model.startswith(prefix)
        out = F.when(hit, vendor) if out is None else out.when(hit, vendor)
    return out.otherwise("Unknown")


def normalized_twin(column: str) -> str:
    return column.replace("raw", "normalized")


def is_suffixed_copy(column: Column, base: str) -> Column:
    """True for names like ``date_3`` made from ``date``."""
    return column.rlike(f"^{base}_\\d+$")


def day_from_path(path: Column) -> Column:
    """Snapshot day from a file name ``YYYY-MM-DD.csv``."""
    return F.to_date(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})\.csv$", 1))


def snap_to_zero(value: Column, eps: float = 1e-10) -> Column:
    return F.when(F.abs(value) < eps, F.lit(0.0)).otherwise(value)


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """0-based equal-width bin; the upper edge belongs to the last bin."""
    if high <= low:
        return F.lit(0).cast("long")
    width = (high - low) / bins
    raw = F.floor((value - F.lit(low)) / F.lit(width))
    return F.greatest(F.lit(0), F.least(raw, F.lit(bins - 1))).cast("long")


def log_ratio(p: Column, q: Column, eps: float = 1e-10) -> Column:
    """p * ln(p / q) with both sides shifted off zero."""
    return (p + eps) * F.ln((p + eps) / (q + eps))


def pad_to(values: Column, length: int, pad: float) -> Column:
    return F.concat(values, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(values))))


def prime_factors(n: int) -> list[int]:
    """Prime factors of ``n`` in ascending order."""
    found, candidate = [], 2
    while n > 1:
        if n % candidate:
            candidate = n if candidate * candidate > n else candidate + 1
        else:
            found.append(candidate)
            n //= candidate
    return found
