"""Fixed-layout schemas and their registry."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: names of field types: width in bits and whether the sign counts at the edge
TYPES = {"uint8": (8, False), "uint16": (16, False), "uint32": (32, False), "uint64": (64, False), "int8": (8, True), "int16": (16, True), "int32": (32, True), "int64": (64, True), "float64": (64, True)}


class SchemaError(ValueError):
    """A schema or field that is unknown, or that contradicts itself."""


@dataclass(frozen=True)
class Field:
    """``least`` and ``most`` bound the values; without them any 64-bit pattern may occur.

    ``scale`` turns a decimal or floating number into an integer on load (0.05 with
    the scale 10000 is 500).  ``stored`` names the column that the field is made from,
    a number or, with ``dated``, a time without zone that becomes the number YYYYMMDD.
    """

    name: str
    offset: int = 0
    type: str = "uint64"
    scale: int = 1
    least: int | None = None
    most: int | None = None
    stored: str | None = None
    dated: bool = False

    def load(self) -> Column:
        """The field, made from its stored column."""
        x = F.col(f"`{self.stored}`")
        if self.dated:
            return F.date_format(x, "yyyyMMdd").cast("bigint").alias(self.name)
        return (x if self.type != "float64" and self.scale == 1 else F.round(x * self.scale)).cast("bigint").alias(self.name)

    def stored_where(self, kind: str, value: int) -> Column | None:
        """A condition on the stored column that holds wherever the field compares so with ``value``; None if there is none.

        Numbers are rounded on load, so bounds are half a unit, and a little, wider.
        """
        if self.stored is None:
            return None
        x = F.col(f"`{self.stored}`")
        if self.dated:
            try:
                day = date(value // 10000, value // 100 % 100, value % 100)
            except ValueError:
                return None
            at = lambda d: F.expr(f"timestamp_ntz'{d.isoformat()}'")
            low, high = x >= at(day), x < at(day + timedelta(kind != "lt"))
        else:
            low, high = x >= (value - 0.6) / self.scale, x <= (value + 0.6) / self.scale
        return {"gt": low, "ge": low, "lt": high, "le": high, "eq": low & high}[kind]

    def bounds(self) -> tuple[int, int]:
        bits, sign = TYPES[self.type]
        if self.least is not None and self.most is not None:
            return self.least, self.most
        return (0, (1 << bits) - 1) if not sign and bits < 64 else (0, (1 << 64) - 1)


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[Field, ...]
    stride: int = 0

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise SchemaError(f"{self.name}: field names repeat")
        for f in self.fields:
            if f.type not in TYPES:
                raise SchemaError(f"{self.name}.{f.name}: no such type: {f.type}")
            if self.stride and f.offset + TYPES[f.type][0] // 8 > self.stride:
                raise SchemaError(f"{self.name}.{f.name}: beyond the stride of {self.stride}")

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SchemaError(f"{self.name} has no field {name}")

    def view(self, stored: DataFrame) -> DataFrame:
        """The fields, made from the table that stores them."""
        return stored.select(*[f.load() for f in self.fields if f.stored])

    def to_spark(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, T.LongType(), True, {"offset": f.offset, "type": f.type, "scale": f.scale}) for f in self.fields])


class SchemaRegistry:
    def __init__(self):
        self._schemas: dict[str, Schema] = {}

    def register(self, schema: Schema, replace: bool = False) -> Schema:
        if schema.name in self._schemas and not replace:
            raise SchemaError(f"{schema.name} is registered already")
        self._schemas[schema.name] = schema
        return schema

    def get(self, name: str) -> Schema:
        if name not in self._schemas:
            raise SchemaError(f"no such schema: {name}")
        return self._schemas[name]

    def find_field(self, schema: str, field: str) -> Field | None:
        """The field, or None if there is no such schema or field."""
        try:
            return self.get(schema).field(field)
        except SchemaError:
            return None
