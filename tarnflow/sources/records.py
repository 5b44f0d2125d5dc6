"""Record definitions: a small description language as schemas, and reading of rows
written under an older or newer definition.

    module links { class Link { ustring URL; boolean isRelative; vector<Anchor> to; } }

Types: boolean, byte, int, long, float, double, ustring, buffer, ``vector<T>``,
``map<K, V>`` and classes defined before.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The names of the simple types.
SIMPLE = {
    "boolean": T.BooleanType(),
    "byte": T.ByteType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "ustring": T.StringType(),
    "buffer": T.BinaryType(),
}

TOKEN = re.compile(r"[\w.]+|[{}<>,;]")
COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*|include\s+\"[^\"]*\"\s*;?", re.DOTALL)


def parse_records(text: str) -> dict[str, T.StructType]:
    """The schema of every class by its name and by ``module.name``."""
    words = TOKEN.findall(COMMENT.sub(" ", text))
    found: dict[str, T.StructType] = {}
    module = ""

    def take(expected: str | None = None) -> str:
        if not words or (expected and words[0] != expected):
            raise ValueError(f"expected {expected or 'a name'} at {' '.join(words[:5])!r}")
        return words.pop(0)

    def kind() -> T.DataType:
        name = take()
        if name in SIMPLE:
            return SIMPLE[name]
        if name == "vector":
            take("<")
            inner = kind()
            take(">")
            return T.ArrayType(inner)
        if name == "map":
            take("<")
            key = kind()
            take(",")
            value = kind()
            take(">")
            return T.MapType(key, value)
        if name in found or f"{module}.{name}" in found:
            return found.get(f"{module}.{name}", found.get(name))
        raise ValueError(f"unknown type {name!r}")

    while words:
        word = take()
        if word == "module":
            module = take()
            take("{")
        elif word == "class":
            name, fields = take(), []
            take("{")
            while words and words[0] != "}":
                of = kind()
                fields.append(T.StructField(take(), of))
                take(";")
            take("}")
            found[name] = found[f"{module}.{name}"] = T.StructType(fields)
        elif word != "}":
            raise ValueError(f"unexpected {word!r}")
    return found


def conform(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value of one type as another: fields that are not there are null, unknown
    fields go, nested records too; a simple type that cannot be cast is null."""
    if isinstance(want, T.StructType):
        if not isinstance(have, T.StructType):
            return F.lit(None).cast(want)
        known = {f.name: f.dataType for f in have.fields}
        fields = [conform(value[f.name], known[f.name], f.dataType).alias(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(value, lambda x: conform(x, have.elementType, want.elementType))
    if isinstance(want, T.MapType) and isinstance(have, T.MapType) and have.keyType == want.keyType:
        return F.transform_values(value, lambda _, x: conform(x, have.valueType, want.valueType))
    simple = not isinstance(have, (T.ArrayType, T.MapType, T.StructType)) and not isinstance(want, (T.ArrayType, T.MapType))
    return value.cast(want) if have == want else value.try_cast(want) if simple else F.lit(None).cast(want)


def read_versioned(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """Rows written under any definition as those of ``wanted``."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*(conform(F.col(f.name), have[f.name], f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields))
