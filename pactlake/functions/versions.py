"""Version names such as `v12` and their numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pactlake.schemas import VERSION_NAME


def version_name(text: Column) -> Column:
    """Drop a `.json` suffix; null when what is left is not a version name."""
    bare = F.regexp_replace(text, r"\.json\z", "")
    return F.when(bare.rlike(VERSION_NAME), bare)


def version_num(name: Column) -> Column:
    """The number of a valid version name; null for other text and for numbers beyond INT, which
    lint reports and registration rejects."""
    return F.when(name.rlike(VERSION_NAME), F.substr(name, F.lit(2)).try_cast("int"))


def out_of_range(name: Column) -> Column:
    """A valid version name with a number beyond INT."""
    return F.coalesce(name.rlike(VERSION_NAME) & version_num(name).isNull(), F.lit(False))


def version_of(num: Column) -> Column:
    return F.concat(F.lit("v"), num.cast("string"))
