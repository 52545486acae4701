"""Search in an API's schema answer: types, their fields and arguments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import has_keyword

#: Words that mark a field as made for imputed data.
KEYWORDS = ("imput", "reconcil", "provisional", "stale", "confidence", "reconstruct")
SCHEMA = "types array<struct<name:string,kind:string,description:string,fields:array<struct<name:string,description:string,args:array<struct<name:string,description:string>>>>>>"


def all_fields(answer: DataFrame) -> DataFrame:
    """One row for each field of each type."""
    t = answer.select(F.explode("types").alias("t"))
    return t.select(F.col("t.name").alias("type"), F.explode("t.fields").alias("f")).select("type", F.col("f.name").alias("field"), F.col("f.description").alias("description"), F.col("f.args").alias("args"))


def matching_fields(answer: DataFrame, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """Fields with a keyword in their type, name, description or an argument."""
    args = F.transform(F.coalesce("args", F.array()), lambda a: F.concat_ws(" ", a["name"], a["description"]))
    text = F.concat_ws(" ", F.col("type"), F.col("field"), F.col("description"), F.array_join(args, " "))
    return all_fields(answer).filter(has_keyword(text, keywords)).select("type", "field", "description")
