"""Window and stride arguments."""

from __future__ import annotations

import numbers

import pandas as pd

TIME, SEQUENCE = "time", "sequence"
#: Units of the short notation, in microseconds.
UNITS = (("D", 86_400_000_000), ("h", 3_600_000_000), ("m", 60_000_000))


def parse_time(arg: str | pd.Timedelta) -> int:
    """Microseconds of a Timedelta or of a string with a unit."""
    if isinstance(arg, str):
        if arg.strip().replace(".", "", 1).lstrip("+-").isdigit():
            raise ValueError(f"time argument {arg!r} has no unit")
        arg = pd.Timedelta(arg)
    if not isinstance(arg, pd.Timedelta):
        raise TypeError(f"expected a time string or Timedelta, got {type(arg).__name__}")
    return arg.value // 1000


def kind_of(arg) -> str | None:
    """Whether an argument counts time or index values; None for none."""
    if arg is None:
        return None
    if isinstance(arg, str | pd.Timedelta):
        return TIME
    if isinstance(arg, numbers.Real) and not isinstance(arg, bool):
        return SEQUENCE
    raise TypeError(f"window and stride are strings, Timedeltas or numbers, not {type(arg).__name__}")


def parse(arg) -> int | float | None:
    """Microseconds or a plain number."""
    kind = kind_of(arg)
    return None if kind is None else parse_time(arg) if kind == TIME else arg


def short(us: int) -> str:
    """Compact notation of microseconds, such as 15D, 1h30m, 7.5s, NEG_2h, 1D_2h."""
    sign, left, parts = ("NEG_" if us < 0 else ""), abs(int(us)), []
    for unit, size in UNITS:
        n, left = divmod(left, size)
        if n:
            parts.append(f"{n}{unit}")
    ms = left // 1000
    if ms:
        parts.append(f"{ms / 1000:g}s" if ms % 1000 else f"{ms // 1000}s")
    if parts and parts[0].endswith("D") and len(parts) > 1:
        parts[0] += "_"
    return sign + "".join(parts)


def label(arg) -> str:
    """How a window shows in column names."""
    return short(parse_time(arg)) if kind_of(arg) == TIME else str(arg)
