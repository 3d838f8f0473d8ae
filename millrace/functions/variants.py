"""JSON in text columns as Variant: parsed once, typed out by path, and its schema summed up over a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a Variant column of a JSON text; null where the text is null or broken."""
    return df.withColumn(name, F.try_parse_json(text))


def typed(variant: str, path: str, kind: str) -> Column:
    """What stands at a path, as a type; null where there is nothing, a JSON null, or what the type can't take."""
    return F.try_variant_get(variant, path, kind)


def told(variant: str, path: str) -> Column:
    """What a path holds: value, null (a JSON null), nothing, or broken, where the text was null or no JSON."""
    at = F.variant_get(variant, path, "variant")
    return F.when(F.col(variant).isNull(), "broken").when(at.isNull(), "nothing").when(F.is_variant_null(at), "null").otherwise("value")


def schema_by(df: DataFrame, by: list[str], variant: str, name: str = "schema") -> DataFrame:
    """The schema that all of a group's values fit, merged where the rows are; VARIANT where they differ in kind."""
    return df.groupBy(*by).agg(F.schema_of_variant_agg(variant).alias(name))
