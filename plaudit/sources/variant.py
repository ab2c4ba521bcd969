"""JSON lines whose fields change from record to record, by way of the VARIANT type.

A line is parsed once into a variant.  Each declared field takes the first of its paths that holds
a value of its type, a single value also where a list is declared.  What no field took, because it
is unknown or of another type, stays in ``rescued`` as JSON; lines that are no JSON objects stay in
``_corrupt_record``.  So no top-level field is lost (a path into an object takes the whole object),
and no second pass infers a schema.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import CORRUPT


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    paths: tuple[str, ...]  # such as "text" or "text.body"


#: The extractor's results over its versions: lists or single values, under old and new names.
EXTRACTED = (
    Field("sentence", "string", ("sentence", "text", "text.body")),
    Field("aspect", "array<string>", ("aspect", "aspects")),
    Field("sentiment", "array<string>", ("sentiment", "polarity")),
    Field("confidence", "array<double>", ("confidence", "probs")),
)


def _got(v: Column, path: str, kind: str) -> Column:
    whole = F.try_variant_get(v, f"$.{path}", kind)
    if kind == "string":
        # Objects and lists would turn into text; they are values of another type.
        shape = F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))
        return F.when(~shape.startswith("OBJECT") & ~shape.startswith("ARRAY"), whole)
    if kind.startswith("array<"):
        one = _got(v, path, kind[6:-1])
        return F.coalesce(whole, F.when(one.isNotNull(), F.array(one)))
    return whole


def typed(df: DataFrame, line: str, fields: Sequence[Field]) -> DataFrame:
    """``df`` without ``line``, with one column per field, ``rescued`` and ``_corrupt_record``."""
    parsed = df.withColumn("__v", F.try_parse_json(line))
    is_object = F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False))
    parsed = parsed.withColumn("__v", F.when(is_object, F.col("__v")))
    v = F.col("__v")
    values, taken = [], []
    for field in fields:
        options = [(path, _got(v, path, field.type)) for path in field.paths]
        values.append(F.coalesce(*[value for _, value in options]).alias(field.name))
        used = None
        for path, value in options:
            used = F.when(value.isNotNull(), path.split(".")[0]) if used is None else used.when(value.isNotNull(), path.split(".")[0])
        taken.append(used)
    left = F.map_filter(v.cast("map<string,variant>"), lambda k, x: ~F.array_contains(F.array_compact(F.array(*taken)), k))
    kept = [c for c in df.columns if c != line]
    return parsed.select(
        *kept, *values, F.when(F.size(left) > 0, F.to_json(left)).alias("rescued"),
        F.when(v.isNull(), F.col(line)).alias(CORRUPT),
    )


def read_drifting(spark: SparkSession, path: str, fields: Sequence[Field]) -> DataFrame:
    """JSON lines of mixed shapes; empty lines are no records."""
    lines = spark.read.text(path).where(F.length(F.btrim("value")) > 0)
    return typed(lines, "value", fields)
