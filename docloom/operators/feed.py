"""Change feeds, claims and limits: the batch forms.

Nulls and edge cases: a null time is neither late nor early and counts with nothing; a null key is a key; rows that tie in an order share no defined place, so orders must be
total; repeated rows are rows like any other; an empty table gives an empty result; an input column named like an added one is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import latest


def _refuse(df: DataFrame, added: list[str]) -> None:
    if clash := sorted(set(added) & set(df.columns)):
        raise ValueError(f"columns {clash} of the input would be lost")


def apply_changes(changes: DataFrame, key: str, order: list[str], removed: str = "removed") -> DataFrame:
    """The state after all changes: the last change of each key, without those that remove it."""
    return latest(changes, [key], order).where(~F.col(removed)).drop(removed)


def admission(df: DataFrame, time: str, now, past: str = "INTERVAL 30 DAYS", future: str = "INTERVAL 1 DAY") -> DataFrame:
    """df with verdict: expired if older than `past` before now or over `future` ahead, else ok."""
    _refuse(df, ["verdict"])
    late = (F.col(time) < now - F.expr(past)) | (F.col(time) > now + F.expr(future))
    return df.withColumn("verdict", F.when(late, "E_EXPIRED").otherwise("ok"))


def counts_before(df: DataFrame, key: str, time: str, spans: dict[str, int]) -> DataFrame:
    """For each row how many rows of its key lie less than so many seconds back, itself included (the bound itself is out)."""
    _refuse(df, list(spans))
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at)
    return df.withColumns({n: F.count("*").over(w.rangeBetween(1 - s * 1_000_000, 0)) for n, s in spans.items()})


def changes_only(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before of their key; the first always stays."""
    by = Window.partitionBy(key).orderBy(*order)
    now = F.struct(F.col(value).alias("v"))  # a struct, so that a null value isn't taken for a missing row
    seen = df.select(F.struct("*").alias("row"), F.lag(now).over(by).alias("before"), now.alias("now"))
    return seen.where(~F.col("before").eqNullSafe(F.col("now"))).select("row.*")


def ledger(lines: DataFrame) -> DataFrame:
    """id and cost of (id, type, cost, place): what was charged, or the last reservation by place where nothing was."""
    charged = F.sum(F.when(F.col("type") == "charge", F.col("cost")))
    reserved = F.max_by("cost", F.when(F.col("type") == "reserve", F.col("place")))
    return lines.groupBy("id").agg(F.coalesce(charged, reserved).alias("cost"))
