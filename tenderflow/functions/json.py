"""JSON values: reading what may be malformed, and writing safe values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_or_null(text: Column) -> Column:
    """The text as a variant; null where it is missing or malformed."""
    return F.try_parse_json(text)


def json_safe(value: Column, kind: T.DataType) -> Column:
    """The value with times as ISO text (microseconds only where there are some), bytes as hex and the key _id as id, at any depth."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        return F.when(F.date_format(value, "SSSSSS") == "000000", whole).otherwise(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    if isinstance(kind, T.DateType):
        return value.cast("string")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        renamed = value if not isinstance(kind.keyType, T.StringType) else F.transform_keys(value, lambda k, _: F.when(k == "_id", "id").otherwise(k))
        return F.transform_values(renamed, lambda _, v: json_safe(v, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [json_safe(value[f.name], f.dataType).alias("id" if f.name == "_id" else f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def safe_rows(df: DataFrame) -> DataFrame:
    """All columns as JSON-safe values."""
    return df.select(*[json_safe(df[f"`{f.name}`"], f.dataType).alias("id" if f.name == "_id" else f.name) for f in df.schema.fields])


def margin_bands(text: Column, otherwise: dict[str, float]) -> Column:
    """Key to margin of a document {bands: [{key, margin}], accessories_derived}, the last of equal keys; the derived one, where there is one, is accessories.

    Bands without key or margin count for nothing; where none is left, and where the document is missing or malformed, the defaults hold.
    """
    data = F.from_json(text, "bands array<struct<key: string, margin: double>>, accessories_derived double")
    derived = F.when(data["accessories_derived"].isNotNull(), F.array(F.struct(F.lit("accessories").alias("key"), data["accessories_derived"].alias("margin"))))
    none = F.array().cast("array<struct<key: string, margin: double>>")
    listed = F.concat(F.coalesce(data["bands"], none), F.coalesce(derived, none))
    listed = F.filter(listed, lambda b: b["key"].isNotNull() & b["margin"].isNotNull())
    last = F.aggregate(listed, F.create_map().cast("map<string, double>"), lambda m, b: F.map_concat(F.map_filter(m, lambda k, _: k != b["key"]), F.create_map(b["key"], b["margin"])))
    return F.when(F.size(listed) > 0, last).otherwise(F.create_map(*[F.lit(x) for pair in otherwise.items() for x in pair]))
