"""Readers and writers: JSON objects with any fields, tab-separated logs, tagged news files, Parquet with a codec."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODECS = {"none": "none", "lz4": "lz4", "zstd": "zstd", "snappy": "snappy"}
CODEC_IDS = {0x02: "none", 0x82: "lz4", 0x90: "zstd"}


def write(df: DataFrame, path: str, codec: str | int = "zstd", mode: str = "errorifexists") -> None:
    """Columns to Parquet with a codec by name or number; row groups keep minima and maxima."""
    name = CODEC_IDS.get(codec, codec)
    if name not in CODECS:
        raise ValueError(f"no such codec: {codec!r}")
    df.write.mode(mode).option("compression", CODECS[name]).parquet(path)


def flatten_json(value: str, depth: int = 64) -> list[dict]:
    """One object's values as rows of field, role and value; objects flatten to a.b, arrays repeat a field, nulls go.

    Strings are text, booleans the keywords true and false, integers long, other numbers double. What is no object, or
    is nested deeper than ``depth``, is an error.
    """
    top = json.loads(value)
    if not isinstance(top, dict):
        raise ValueError("not a JSON object")
    out: list[dict] = []

    def put(name: str, v, level: int) -> None:
        if level > depth:
            raise ValueError(f"nested deeper than {depth}")
        if isinstance(v, dict):
            for k, x in v.items():
                put(f"{name}.{k}" if name else k, x, level + 1)
        elif isinstance(v, list):
            for x in v:
                put(name, x, level + 1)
        elif v is not None:
            role = "keyword" if isinstance(v, bool) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "text"
            out.append({"field": name, "role": role, "value": str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, float) else str(v)})

    put("", top, 0)
    return out


def flatten_fields(df: DataFrame, column: str, keep: Iterable[str] = ()) -> DataFrame:
    """JSON objects of a column with unknown fields -> (keep..., field, role, value), an Arrow batch at a time."""
    import pyarrow as pa

    keep = list(keep)

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, v in enumerate(batch.column("__json").to_pylist()):
                own = flatten_json(v) if v is not None else []
                rows += own
                at += [i] * len(own)
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(index) for c in keep] + [pa.array([r[c] for r in rows], pa.string()) for c in ("field", "role", "value")], names=[*keep, "field", "role", "value"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "field string, role string, value string"])
    return df.select(*keep, F.col(column).alias("__json")).mapInArrow(run, schema)


def parse_json(df: DataFrame, column: str, schema: T.StructType | str, id_column: str | None = None) -> DataFrame:
    """JSON objects with known fields -> columns (nested ones as a.b), in the JVM; ``_id`` from another column if asked."""
    parsed = df.select("*", F.from_json(column, schema, {"mode": "FAILFAST"}).alias("__o"))
    kind = parsed.schema["__o"].dataType
    out = parsed.select(*[F.col(c) for c in df.columns if c != column], *_leaves(F.col("__o"), kind, ""))
    return out.withColumn("_id", F.col(id_column).cast("string")) if id_column else out


def _leaves(c: Column, kind: T.StructType, prefix: str) -> list[Column]:
    out: list[Column] = []
    for f in kind.fields:
        name = f"{prefix}{f.name}"
        out += _leaves(c[f.name], f.dataType, name + ".") if isinstance(f.dataType, T.StructType) else [c[f.name].alias(name)]
    return out


def parse_json_array(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """JSON arrays of objects -> one row an object."""
    kind = schema if isinstance(schema, str) else schema.simpleString()
    one = df.select(F.explode(F.from_json(column, f"array<struct<{kind}>>" if not kind.startswith("struct") else f"array<{kind}>", {"mode": "FAILFAST"})).alias("__o"))
    return one.select(*_leaves(F.col("__o"), one.schema["__o"].dataType, ""))


def read_log(spark: SparkSession, path: str, columns: dict[str, tuple[int, str]], width: int = 62) -> DataFrame:
    """Tab-separated rows of ``width`` columns or more; columns names (place, type) of those that are wanted."""
    parts = F.split("value", "\t", -1)
    rows = spark.read.text(path).where(F.size(parts) >= width)
    return rows.select(*[F.get(parts, F.lit(at)).cast(kind).alias(name) for name, (at, kind) in columns.items()])


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """Tagged news files -> doc_id, title, body of each <REUTERS> element; a file without tags is one document."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parts = F.regexp_extract_all("value", F.lit(r"(?s)<REUTERS\b.*?</REUTERS>"), F.lit(0))
    docs = files.select("file", F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(F.array("value"))).alias("place", "raw"))
    tag = lambda name: F.regexp_extract("raw", rf"(?s)<{name}>(.*?)</{name}>", 1)
    number = F.regexp_extract("raw", r'NEWID="(\d+)"', 1)
    body = F.when(F.col("raw").contains("<BODY>"), tag("BODY")).otherwise(F.regexp_replace("raw", r"(?s)<[^>]*>", " "))
    return docs.select(F.when(number != "", number.cast("long")).otherwise(F.xxhash64("file", "place")).alias("doc_id"), tag("TITLE").alias("title"), F.trim(body).alias("body"))
