"""Ids that a retried task computes again to the same value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pactlake.schemas import RUN_SLOTS


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped id from the parts; random ids would change when a lost task is run again."""
    text = F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])
    return F.regexp_replace(F.md5(text), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def iso_time(time: Column) -> Column:
    """ISO text in UTC with milliseconds, as the history stores times."""
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def run_slot(run_id: Column) -> Column:
    """The folder of a run's rows."""
    return F.pmod(F.xxhash64(run_id), F.lit(RUN_SLOTS)).cast("int")
