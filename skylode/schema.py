"""Field roles: what a column is to the engine, kept as StructField metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROLES = ("text", "keyword", "long", "double", "binary", "texts", "keywords", "longs", "sparse", "stored")


def infer_role(kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, T.BooleanType):
        return "keyword"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "long"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(kind, T.BinaryType):
        return "binary"
    if isinstance(kind, T.ArrayType):
        return {"text": "texts", "keyword": "keywords", "long": "longs"}.get(infer_role(kind.elementType), "stored")
    return "stored"


@dataclass
class Mapping:
    """Explicit roles by column; a column that is named twice, or a role that does not exist, is an error."""

    roles: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, role: str) -> Mapping:
        if name in self.roles:
            raise ValueError(f"field {name!r} is already mapped")
        if role not in ROLES:
            raise ValueError(f"no such role: {role!r}")
        self.roles[name] = role
        return self

    def add_array(self, name: str, element: str) -> Mapping:
        return self.add(name, {"text": "texts", "keyword": "keywords", "long": "longs"}.get(element, element))

    def apply(self, df: DataFrame) -> DataFrame:
        """df with each column's role in its metadata: the mapped one, else that of its type."""
        missing = set(self.roles) - set(df.columns)
        if missing:
            raise ValueError(f"no such columns: {sorted(missing)}")
        for f in df.schema.fields:
            role = self.roles.get(f.name, f.metadata.get("role") or infer_role(f.dataType))
            df = df.withMetadata(f.name, {**f.metadata, "role": role})
        return df


def role(df: DataFrame, name: str) -> str:
    f = df.schema[name]
    return f.metadata.get("role") or infer_role(f.dataType)


def field_infos(df: DataFrame) -> list[dict[str, str]]:
    """Name, type and role of every column."""
    return [{"name": f.name, "type": f.dataType.simpleString(), "role": role(df, f.name)} for f in df.schema.fields]
