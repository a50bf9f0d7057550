"""Closed contracts: nested JSON by a schema that refuses unknown keys at every level, and its export as JSON Schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: JSON Schema's name of each plain type.
PLAIN = {T.StringType: "string", T.BooleanType: "boolean", T.DoubleType: "number", T.FloatType: "number", T.IntegerType: "integer", T.LongType: "integer", T.ShortType: "integer", T.ByteType: "integer"}


def json_schema(kind: T.DataType, nullable: bool = False) -> dict:
    """The JSON Schema of a type: objects have no further properties, what isn't nullable is required."""
    if isinstance(kind, T.StructType):
        out = {"type": "object", "properties": {f.name: json_schema(f.dataType, f.nullable) for f in kind}, "required": [f.name for f in kind if not f.nullable], "additionalProperties": False}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": json_schema(kind.elementType, kind.containsNull)}
    elif isinstance(kind, T.MapType):
        out = {"type": "object", "additionalProperties": json_schema(kind.valueType, kind.valueContainsNull)}
    elif isinstance(kind, T.TimestampType):
        out = {"type": "string", "format": "date-time"}
    elif isinstance(kind, T.DecimalType):
        out = {"type": "number"}
    else:
        out = {"type": PLAIN[type(kind)]}
    return {"anyOf": [out, {"type": "null"}]} if nullable else out


def export(spark: SparkSession, schemas: dict[str, T.StructType], path: str, version: str = "1.0") -> None:
    """Each schema by name as JSON Schema, a line each."""
    rows = [(n, json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": n, "version": version} | json_schema(s), sort_keys=True)) for n, s in sorted(schemas.items())]
    spark.createDataFrame(rows, "name string, schema string").coalesce(1).write.mode("overwrite").json(path)


def unknown_keys(text: Column, kind: T.DataType, at: str = "") -> Column:
    """The paths of keys in a JSON text that ``kind`` doesn't have, at any depth: "vitals[].extra"."""
    none = F.expr("cast(array() as array<string>)")
    if isinstance(kind, T.StructType):
        own = F.coalesce(F.json_object_keys(text), none)
        here = F.transform(F.array_except(own, F.array(*[F.lit(n) for n in kind.names])), lambda k: F.concat(F.lit(f"{at}." if at else ""), k))
        below = [unknown_keys(F.get_json_object(text, f"$['{f.name}']"), f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind if _nested(f.dataType)]
        return F.concat(here, *below) if below else here
    if isinstance(kind, T.ArrayType) and _nested(kind.elementType):
        items = F.coalesce(F.from_json(text, "array<string>"), F.expr("cast(array() as array<string>)"))
        return F.array_distinct(F.flatten(F.transform(items, lambda x: unknown_keys(x, kind.elementType, f"{at}[]"))))
    if isinstance(kind, T.MapType) and _nested(kind.valueType):
        values = F.map_values(F.coalesce(F.from_json(text, "map<string,string>"), F.expr("cast(map() as map<string,string>)")))
        return F.array_distinct(F.flatten(F.transform(values, lambda x: unknown_keys(x, kind.valueType, f"{at}{{}}"))))
    return none


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) or (isinstance(kind, T.ArrayType) and _nested(kind.elementType)) or (isinstance(kind, T.MapType) and _nested(kind.valueType))


def missing_keys(value: Column, kind: T.DataType, at: str = "") -> Column:
    """The paths of required values that a parsed value doesn't have."""
    none = F.expr("cast(array() as array<string>)")
    if isinstance(kind, T.StructType):
        here = [F.when(value.isNotNull() & value[f.name].isNull(), f"{at}.{f.name}" if at else f.name) for f in kind if not f.nullable]
        below = [F.coalesce(missing_keys(value[f.name], f.dataType, f"{at}.{f.name}" if at else f.name), none) for f in kind if _nested(f.dataType)]
        own = F.filter(F.array(*here), lambda x: x.isNotNull()) if here else none
        return F.concat(own, *below) if below else own
    if isinstance(kind, T.ArrayType) and _nested(kind.elementType):
        return F.array_distinct(F.flatten(F.transform(value, lambda x: missing_keys(x, kind.elementType, f"{at}[]"))))
    return none


def parsed(rows: DataFrame, text: str, schema: T.StructType) -> DataFrame:
    """``rows`` with value (null if refused) and refused: unknown and missing keys by path, or "not JSON of these types"."""
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    out = rows.withColumns({"_value": F.from_json(text, loose, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_none"}), "_unknown": unknown_keys(F.col(text), schema)})
    broken = F.col("_value").isNull() | F.json_object_keys(text).isNull()
    refused = F.when(broken, F.array(F.lit("not JSON of these types"))).otherwise(F.concat("_unknown", F.coalesce(missing_keys(F.col("_value"), schema), F.expr("cast(array() as array<string>)"))))
    out = out.withColumn("refused", refused)
    return out.withColumn("value", F.when(F.size("refused") == 0, F.col("_value"))).drop("_value", "_unknown")
