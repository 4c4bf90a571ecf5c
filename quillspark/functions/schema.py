"""The type language of declared outputs: ``string``, ``integer``, ``number``, ``boolean``, ``list[...]``, ``{a: T}``, ``enum[...]``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCALARS = {"str": "string", "text": "string", "string": "string", "varchar": "string", "int": "integer", "integer": "integer", "float": "number", "decimal": "number", "number": "number", "bool": "boolean", "boolean": "boolean"}
_SPARK = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


@dataclass(frozen=True)
class Kind:
    name: str
    item: "Kind | None" = None
    fields: tuple[tuple[str, "Kind"], ...] = ()
    allowed: tuple[str, ...] = ()

    def spark(self) -> T.DataType:
        if self.name == "list":
            return T.ArrayType(self.item.spark())
        if self.name == "object":
            return T.StructType([T.StructField(n, k.spark()) for n, k in self.fields])
        return _SPARK["string" if self.name == "enum" else self.name]

    def accepts(self, value) -> bool:
        """Whether a Python value is of this kind; a boolean is no number."""
        if self.name == "string":
            return isinstance(value, str)
        if self.name == "enum":
            return isinstance(value, str) and value in self.allowed
        if self.name == "boolean":
            return isinstance(value, bool)
        if self.name == "integer":
            return isinstance(value, int) and not isinstance(value, bool)
        if self.name == "number":
            return isinstance(value, (int, float)) and not isinstance(value, bool)
        if self.name == "list":
            return isinstance(value, (list, tuple)) and all(self.item.accepts(v) for v in value)
        return isinstance(value, dict) and {n for n, _ in self.fields} == set(value) and all(k.accepts(value[n]) for n, k in self.fields)

    def check(self, value: Column) -> Column:
        """The part of the check that the column's type leaves open: presence, and membership of enums."""
        if self.name == "enum":
            return F.coalesce(value.isin(*self.allowed), F.lit(False))
        if self.name == "list":
            return value.isNotNull() & F.forall(value, self.item.check)
        if self.name == "object":
            out = value.isNotNull()
            for n, k in self.fields:
                out = out & k.check(value[n])
            return out
        return value.isNotNull()


def _parts(text: str) -> list[str]:
    """Split at commas outside brackets and braces."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "[{") - (c in "]}")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


def parse(text: str) -> Kind:
    """The kind that ``text`` names; enum values and field names keep their case."""
    text = text.strip()
    low = text.lower()
    if low in _SCALARS:
        return Kind(_SCALARS[low])
    if low.startswith("list[") and text.endswith("]"):
        inner = text[5:-1].strip()
        if not inner:
            raise ValueError("a list needs an element type")
        return Kind("list", item=parse(inner))
    if low.startswith("enum[") and text.endswith("]"):
        return Kind("enum", allowed=tuple(v.strip("'\" ") for v in _parts(text[5:-1])))
    if text.startswith("{") and text.endswith("}"):
        fields = []
        for part in _parts(text[1:-1]):
            name, colon, kind = part.partition(":")
            if not colon:
                raise ValueError(f"a field needs a type: {part!r}")
            fields.append((name.strip(), parse(kind)))
        return Kind("object", fields=tuple(fields))
    raise ValueError(f"unknown type: {text!r}")


def parse_schema(schema: dict[str, str]) -> dict[str, Kind]:
    return {name: parse(kind) for name, kind in schema.items()}


def spark_schema(kinds: dict[str, Kind]) -> T.StructType:
    return T.StructType([T.StructField(n, k.spark()) for n, k in kinds.items()])
