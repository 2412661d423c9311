"""Record types and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entity types, their aliases, and detection sources with their priorities.
ENTITY_TYPES = ["PERSON", "EMAIL", "PHONE", "ID", "NUMBER", "CARD", "IBAN", "DATE", "BIRTH_DATE", "AMOUNT", "IP", "URL", "ADDRESS", "COMPANY", "SECRET", "API_KEY", "CUSTOM", "OTHER"]
ALIASES = {"SSN": "ID", "CREDIT_CARD": "CARD", "CURRENCY": "AMOUNT", "IP_ADDRESS": "IP"}
PRIORITIES = {"manual": 50, "dictionary": 40, "validatedRule": 30, "strongRule": 25, "model": 20, "bundledList": 20, "rule": 10, "propagated": 5}
STRONG_CONFIDENCE = 0.8

SPAN = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("detector", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
    ]
)
SPANS = T.ArrayType(SPAN)
MAPPING = T.StructType([T.StructField("original", T.StringType()), T.StructField("placeholder", T.StringType()), T.StructField("type", T.StringType())])
MAPPINGS = T.ArrayType(MAPPING)
RANGE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
RANGES = T.ArrayType(RANGE)
REPLACEMENT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("placeholder", T.StringType())])
REPLACEMENTS = T.ArrayType(REPLACEMENT)
SCHEMA_VERSION = 1


class InvalidArgument(ValueError):
    """A request that cannot be carried out as it is."""


class Unsupported(RuntimeError):
    """A feature that needs a plug-in which isn't there."""


def entity_type(name: str) -> str | None:
    """The canonical name of a type or alias; None for an unknown one."""
    return name if name in ENTITY_TYPES else ALIASES.get(name)


def entity_type_column(name: Column) -> Column:
    known = F.when(name.isin(ENTITY_TYPES), name)
    for alias, canonical in ALIASES.items():
        known = known.when(name == alias, canonical)
    return known


def priority(source: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, value in PRIORITIES.items():
        out = F.when(source == name, value).otherwise(out)
    return out
