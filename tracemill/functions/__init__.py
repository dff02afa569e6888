"""Column functions on signals, enums and header values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantise(signal: Column | str, bits: int) -> Column:
    """Zero the low bits of each sample, rounding half up and saturating at 16 bits."""
    half, top = 1 << (bits - 1), (32767 >> bits) << bits
    return F.transform(signal, lambda x: F.least(F.shiftleft(F.shiftright(x.cast("int") + half, bits), bits), F.lit(top)))


def picoamps(signal: Column | str, digitisation: Column, offset: Column, range_: Column) -> Column:
    return F.transform(signal, lambda x: (x + offset) * range_ / digitisation)


def window_of(signal: Column | str, first: int, last: int) -> Column:
    """Samples first to last, counted from 1, both included."""
    return F.slice(signal, first, last - first + 1)


def enum_code(label: Column, labels: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, labels)), label) - 1


def enum_label(code: Column, labels: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, labels)), code.cast("int"))
