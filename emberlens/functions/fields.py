"""Typed access to a field, for schemaless records and for ordinary columns.

Each accessor gives NULL where the field is missing or of another type, which the
predicates turn into false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlens.plans.language import Path


def dotted(path: str) -> Path:
    return tuple(path.split("."))


def _step(name: str) -> str:
    return f"['{name}']" if '"' in name else f'["{name}"]'


class Field:
    """Accessors of one field: each a nullable Column."""

    number: Column
    text: Column
    flag: Column
    #: Present and not JSON null; an explicit JSON null. Both never NULL.
    present: Column
    null: Column
    #: The text used as a group key: NULL for missing and null.
    display: Column
    #: A timestamp column's own value, or NULL.
    instant: Column


def _typed(dtype: T.DataType, value: Column) -> Field:
    f, none = Field(), lambda kind: F.lit(None).cast(kind)
    f.number = value.cast("double") if isinstance(dtype, T.NumericType) else none("double")
    f.text = value if isinstance(dtype, T.StringType) else none("string")
    f.flag = value if isinstance(dtype, T.BooleanType) else none("boolean")
    f.present, f.null = value.isNotNull(), F.lit(False)
    nested = isinstance(dtype, T.StructType | T.ArrayType | T.MapType)
    f.display = none("string") if isinstance(dtype, T.NullType) else F.to_json(value) if nested else value.cast("string")
    f.instant = value.cast("timestamp") if isinstance(dtype, T.TimestampType | T.TimestampNTZType | T.DateType) else none("timestamp")
    return f


def double_text(x: Column) -> Column:
    """The shortest digits that tell a double, plain from 1e-5 to below 1e16, else as in ``1.5e-7``."""
    text = x.cast("string")
    sign, bare = F.when(text.startswith("-"), "-").otherwise(""), F.ltrim(text, F.lit("-"))
    power = F.substring_index(text, "E", -1).try_cast("int")
    head = F.substring_index(bare, "E", 1)
    whole, part = F.substring_index(head, ".", 1), F.substring_index(head, ".", -1)
    part = F.when(part == "0", "").otherwise(part)
    digits = F.concat(whole, part)
    more = power - F.length(part)
    large = F.when(more >= 0, F.concat(digits, F.repeat(F.lit("0"), more), F.lit(".0"))).otherwise(
        F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits)))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    wide = F.concat(whole, F.when(part == "", "").otherwise(F.concat(F.lit("."), part)), F.lit("e"), power.cast("string"))
    shown = F.when(power.between(7, 15), large).when(power.between(-5, -4), small).otherwise(wide)
    return F.when(text.contains("E"), F.concat(sign, shown)).otherwise(text)


def number_text(token: Column) -> Column:
    """A JSON number as a group key: whole numbers of 64 bits as they are spelled, others as doubles."""
    whole = token.rlike("^-?[0-9]+$") & (token != "-0")
    fits = token.try_cast("decimal(38,0)").between(F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("18446744073709551615").cast("decimal(38,0)"))
    return F.when(whole & fits, token).otherwise(double_text(token.try_cast("double")))


def _variant(value: Column, path: Path, spelled: Column | None = None) -> Field:
    """``spelled``: the record's own JSON, which tells ``5`` from ``5.0`` in group keys."""
    f = Field()
    where = "$" + "".join(map(_step, path))
    here = F.try_variant_get(value, where, "variant")
    kind = F.schema_of_variant(here)
    is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    # The value first: only what can be a number is asked for its type.
    as_number = F.try_variant_get(value, where, "double")
    f.number = F.when(as_number.isNotNull() & is_number, as_number)
    f.text = F.when(kind == "STRING", F.try_variant_get(value, where, "string"))
    f.flag = F.when(kind == "BOOLEAN", F.try_variant_get(value, where, "boolean"))
    f.null = F.coalesce(F.is_variant_null(here), F.lit(False))
    f.present = here.isNotNull() & ~f.null
    shown = F.when(kind == "STRING", F.try_variant_get(value, where, "string"))
    if spelled is not None:
        # Whole numbers have one spelling, but for zero (-0), so they need no second look at the text.
        shown = shown.when((kind == "BIGINT") & (as_number != 0), F.to_json(here))
        shown = shown.when(is_number, number_text(F.coalesce(F.get_json_object(spelled, where.replace('"', "'")), F.to_json(here))))
    f.display = F.when(f.present, shown.otherwise(F.to_json(here)))
    f.instant = F.lit(None).cast("timestamp")
    return f


class RecordFields:
    """Fields of a VARIANT column that holds one JSON object a row."""

    def __init__(self, value: str = "v", raw: str | None = "raw") -> None:
        self.value, self.raw = value, raw

    def __call__(self, path: Path) -> Field:
        return _variant(F.col(self.value), path, F.col(self.raw) if self.raw else None)


class ColumnFields:
    """Fields of an ordinary schema: columns, struct members, and what is inside VARIANT columns."""

    def __init__(self, schema: T.StructType) -> None:
        self.schema = schema

    def __call__(self, path: Path) -> Field:
        kind: T.DataType = self.schema
        value: Column | None = None
        for i, name in enumerate(path):
            if isinstance(kind, T.VariantType):
                return _variant(value, path[i:])
            if not isinstance(kind, T.StructType) or name not in kind.names:
                return _typed(T.NullType(), F.lit(None))
            value = F.col(f"`{name}`") if value is None else value.getField(name)
            kind = kind[name].dataType
        return _variant(value, ()) if isinstance(kind, T.VariantType) else _typed(kind, value)
