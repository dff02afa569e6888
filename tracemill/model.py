"""The data model: reads with a signal, their header attributes, and auxiliary columns with types."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The eight primary columns, in their fixed order, with the names of their types in text files.
PRIMARY = {
    "read_id": ("char*", T.StringType()),
    "read_group": ("uint32_t", T.LongType()),
    "digitisation": ("double", T.DoubleType()),
    "offset": ("double", T.DoubleType()),
    "range": ("double", T.DoubleType()),
    "sampling_rate": ("double", T.DoubleType()),
    "len_raw_signal": ("uint64_t", T.LongType()),
    "raw_signal": ("int16_t*", T.ArrayType(T.ShortType(), False)),
}
#: Types of auxiliary columns. Unsigned ones take the next wider type.
AUX_TYPES = {
    "char*": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(),
    "int8_t": T.ByteType(), "int16_t": T.ShortType(), "int32_t": T.IntegerType(), "int64_t": T.LongType(),
    "uint8_t": T.ShortType(), "uint16_t": T.IntegerType(), "uint32_t": T.LongType(), "uint64_t": T.DecimalType(20, 0),
}
NULL = "."
#: Order of a record: its file, then its place in the file.
ORDER = ("file_ord", "rec_ord")


class SignalError(ValueError):
    """A request or an input that an operator refuses."""


class HeaderMismatch(SignalError):
    """Headers that cannot be reconciled."""


def aux_type(name: str) -> T.DataType:
    if name.startswith("enum{"):
        return T.ShortType()
    if name in AUX_TYPES:
        return AUX_TYPES[name]
    if name.endswith("*") and name[:-1] in AUX_TYPES:
        return T.ArrayType(AUX_TYPES[name[:-1]])
    raise SignalError(f"unknown type {name}")


def enum_labels(name: str) -> list[str] | None:
    return name[5:-1].split(",") if name.startswith("enum{") else None


@dataclass
class ReadSet:
    """Records with their header. header: a dict of attributes per read group; aux: auxiliary column to type name, in order."""

    df: DataFrame
    header: list[dict[str, str | None]]
    aux: dict[str, str] = field(default_factory=dict)
    version: str = "0.2.0"
    tag: str = "signal"  # the word before _version in the file's first line
    path: str = ""
    form: str = "text"  # how the path is stored: text or parquet
    codec: str = "none"

    @property
    def lossy(self) -> bool:
        return not self.aux

    def columns(self) -> list[str]:
        return [*PRIMARY, *self.aux]

    def with_(self, **changes) -> ReadSet:
        return ReadSet(**{**self.__dict__, **changes})
