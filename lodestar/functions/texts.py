"""Column functions for result tables as people write them: headers, numbers, names of files, methods and combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stripped(df: DataFrame) -> DataFrame:
    """df with white space taken off the ends of its column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def found_column(df: DataFrame, *names: str) -> str:
    """The column that has one of the names, whatever its case and white space; the first name that fits counts."""
    have = {" ".join(c.lower().split()): c for c in reversed(df.columns)}
    for name in names:
        if (key := " ".join(name.lower().split())) in have:
            return have[key]
    raise ValueError(f"none of the columns {', '.join(map(repr, names))} in {df.columns}")


def number(text: Column, missing: float | None = None) -> Column:
    """The number that a text spells; null (or `missing`) where it spells none."""
    found = F.trim(text).try_cast("double")
    return found if missing is None else F.coalesce(found, F.lit(float(missing)))


def combination(text: Column) -> Column:
    """Model names joined by ' + ', however the plus signs were spaced."""
    return F.regexp_replace(F.trim(text), r"\s*\+\s*", " + ")


def file_parts(name: Column) -> Column:
    """A struct of the dataset and profile in '<dataset>_profile_<n>.csv'; nulls for other names."""
    pattern = r"^(.+)_profile_?([0-9]+)\.csv$"
    fits = name.rlike(pattern)
    dataset = F.replace(F.regexp_extract(name, pattern, 1), F.lit("_20_variants"), F.lit(""))
    return F.struct(F.when(fits, dataset).alias("dataset"), F.when(fits, F.regexp_extract(name, pattern, 2).cast("int")).alias("profile"))


def method_parts(text: Column) -> Column:
    """A struct of bits, pieces, least and most bits, variance share and search mode in '<bits>m..min..max..var..,mode'."""
    part = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.struct(
        part(r"^[A-Za-z]+([0-9]+)").cast("int").alias("bits"),
        part(r"m([0-9]+)").cast("int").alias("pieces"),
        part(r"min([0-9]+)").cast("int").alias("least"),
        part(r"max([0-9]+)").cast("int").alias("most"),
        part(r"var([0-9.]+)").cast("double").alias("variance"),
        part(r",([A-Z]+)$").alias("mode"),
    )


def settings(text: Column) -> Column:
    """A map of the settings in 'name=value,name=value'."""
    return F.str_to_map(F.regexp_replace(text, r"\s", ""), F.lit(","), F.lit("="))
