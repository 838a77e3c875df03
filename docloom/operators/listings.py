"""Presence over successive listings: a slowly changing state of each document, as rows that are valid from one listing until another.

A document is live or trashed in the listings that name it (live wins) and absent from the first one that doesn't, once it has been named; absent after trashed means purged. Only
changes make rows, so a history grows with what is listed and never holds a row for each document and listing.

Nulls and edge cases: rows without doc or listing are left out; repeated rows are one; kinds other than live count as trashed; listings are numbered without gaps by the caller, and a
listing that names nothing counts when it is said to be the last; an empty table gives no rows; columns are named in the docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIVE, TRASHED, ABSENT, PURGED = "live", "trashed", "absent", "purged"


def _once(seen: DataFrame) -> DataFrame:
    rows = seen.where("doc IS NOT NULL AND listing IS NOT NULL")
    return rows.groupBy("doc", F.col("listing").cast("long").alias("listing")).agg(F.when(F.bool_or(F.col("kind") == LIVE), LIVE).otherwise(TRASHED).alias("state"))


def history(seen: DataFrame, last: int) -> DataFrame:
    """doc, state, valid_from and valid_to (exclusive; null: still) of rows (doc, listing, kind), where `last` is the number of the newest listing."""
    by = Window.partitionBy("doc").orderBy("listing")  # a row for each listing of a document
    named = _once(seen).withColumns({"following": F.lead("listing").over(by), "before": F.lag("listing").over(by), "was": F.lag("state").over(by)})
    begins = named.where(F.col("before").isNull() | (F.col("before") < F.col("listing") - 1) | (F.col("was") != F.col("state"))).select("doc", "state", F.col("listing").alias("valid_from"))
    gone = named.where(F.coalesce("following", F.lit(last + 1)) > F.col("listing") + 1).select("doc", F.when(F.col("state") == TRASHED, PURGED).otherwise(ABSENT).alias("state"), (F.col("listing") + 1).alias("valid_from"))
    line = Window.partitionBy("doc").orderBy("valid_from")
    return begins.unionByName(gone).withColumn("valid_to", F.lead("valid_from").over(line))


def merge(past: DataFrame, seen: DataFrame, listing: int) -> DataFrame:
    """The history with one more listing: open rows end where the state changes, and new ones begin. seen has doc and kind of that listing."""
    now = _once(seen.select("doc", "kind").withColumn("listing", F.lit(listing))).select("doc", F.col("state").alias("now"))
    open_ = past.where("valid_to IS NULL").join(now, "doc", "full")
    missing = F.when(F.col("state").isin(TRASHED, PURGED), PURGED).otherwise(ABSENT)
    state = F.coalesce("now", missing)
    stays = F.col("state").eqNullSafe(state)
    held = open_.where("valid_from IS NOT NULL").select("doc", "state", "valid_from", F.when(~stays, F.lit(listing).cast("long")).alias("valid_to"))
    new = open_.where(~stays).select("doc", state.alias("state"), F.lit(listing).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return past.where("valid_to IS NOT NULL").unionByName(held).unionByName(new)
