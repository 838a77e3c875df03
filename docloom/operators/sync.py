"""Sets of rows kept in step: merged catalogs, newest claims and roles, what may be collected, acknowledgements and picks.

Nulls and edge cases: null keys match nothing and are left out where rows are matched; ties go as each docstring says; repeated rows count once where rows are
picked by key; empty tables give empty results. Columns are named in the docstrings, others don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Seconds of silence before a claim is taken over, days that jobs and attachments are kept.
SILENCE, JOB_DAYS, ORPHAN_DAYS, PHONE_DAYS = 15 * 60, 30, 30, 180
DAY = 86_400
LAST = 2**63 - 1


def merged_catalog(local: DataFrame, remote: DataFrame) -> DataFrame:
    """key, action (insert, update, same or delete), sha, pinned and unread: local has key, sha, pinned, unread and remote key, sha, replaces.

    A row that stays keeps pinned; one with another sha is unread; a new one takes pinned from the row that it replaces; what remote doesn't list goes.
    """
    here = local.where("key IS NOT NULL").select("key", F.col("sha").alias("had"), "pinned", "unread", F.lit(True).alias("here"))
    there = remote.where("key IS NOT NULL").select("key", "sha", "replaces", F.lit(True).alias("there"))
    old = here.select(F.col("key").alias("replaces"), F.col("pinned").alias("old_pin"))
    # most rows replace none: they stay out of the join, where all of them would come to one task
    none = there.where("replaces IS NULL").select("key", "sha", "there", F.lit(None).cast("boolean").alias("old_pin"))
    there = there.where("replaces IS NOT NULL").join(old, "replaces", "left").select("key", "sha", "there", "old_pin").unionByName(none)
    rows = here.join(there, "key", "full_outer")
    changed = ~F.col("sha").eqNullSafe(F.col("had"))
    action = F.when(F.col("there").isNull(), "delete").when(F.col("here").isNull(), "insert").when(changed, "update").otherwise("same")
    pinned = F.when(F.col("here").isNull(), F.coalesce("old_pin", F.lit(False))).otherwise(F.col("pinned"))
    unread = F.when(F.col("there").isNull(), F.col("unread")).when(F.col("here").isNull() | changed, True).otherwise(F.col("unread"))
    return rows.select("key", action.alias("action"), F.coalesce("sha", "had").alias("sha"), pinned.alias("pinned"), unread.alias("unread"))


def newest_accepted(updates: DataFrame, seen: DataFrame) -> DataFrame:
    """key, n and id of the update of each key that is newest by n (a null n is newer than all, then the greatest id), if it is beyond what was seen (key, n)."""
    newest = updates.where("key IS NOT NULL").groupBy("key").agg(F.max(F.struct(F.coalesce("n", F.lit(LAST)).alias("n"), "id")).alias("u"))
    rows = newest.join(seen.groupBy("key").agg(F.max("n").alias("seen")), "key", "left")
    return rows.where(F.col("seen").isNull() | (F.col("u.n") > F.col("seen"))).select("key", F.nullif(F.col("u.n"), F.lit(LAST)).alias("n"), "u.id")


def roles(claims: DataFrame, devices: DataFrame, now: int, silence: int = SILENCE) -> DataFrame:
    """account, device, role and waits_for of each device that claims an account: claims has account, device, ms and file, devices device, role and seen.

    The newest claim's device is primary, others mirror it. It waits for another one that was heard within `silence`, if that isn't a mirror or a phone, and is
    the latest other claimer or says itself that it is primary. Claims of a device are combined first, so an account's window holds its devices.
    """
    own = claims.where("account IS NOT NULL AND device IS NOT NULL").groupBy("account", "device").agg(F.max(F.struct("ms", "device", "file")).alias("c"))
    known = devices.groupBy("device").agg(F.max_by(F.struct("role", "seen"), "seen").alias("d"))
    place = F.row_number().over(Window.partitionBy("account").orderBy(F.desc("c")))
    rows = own.join(known, "device", "left").withColumn("place", place)
    heard = F.when(F.col("d").isNull(), F.col("c.ms")).otherwise(F.coalesce("d.seen", F.lit(0)))
    says = F.coalesce(F.col("d.role"), F.lit(""))
    awaited = (F.col("place") > 1) & ~says.isin("mirror", "phone") & ((F.col("place") == 2) | (says == "primary")) & (F.lit(now) - heard < silence)
    blocked = rows.where(awaited).groupBy("account").agg(F.min_by("device", "place").alias("waits_for"))
    first = F.col("place") == 1
    rows = rows.join(blocked, "account", "left")
    return rows.select("account", "device", F.when(~first, "mirror").when(F.col("waits_for").isNotNull(), "waiting").otherwise("primary").alias("role"), F.when(first, F.col("waits_for")).alias("waits_for"))


def done_jobs(terminal: DataFrame, senders: DataFrame, acks: DataFrame, now: int) -> DataFrame:
    """job of terminal (job, at) that may be collected: its sender (job, device) acknowledged it (device, job), or anyone where the sender isn't known, or it is 30 days old."""
    acked = acks.groupBy("job").agg(F.lit(True).alias("any_ack"))
    by_sender = acks.select("job", "device").distinct().withColumn("own_ack", F.lit(True))
    rows = terminal.join(senders.groupBy("job").agg(F.max("device").alias("device")), "job", "left").join(acked, "job", "left").join(by_sender, ["job", "device"], "left")
    acknowledged = F.when(F.col("device").isNull(), F.col("any_ack")).otherwise(F.col("own_ack")).isNotNull()
    return rows.where(acknowledged | (F.lit(now) - F.col("at") > JOB_DAYS * DAY)).select("job").distinct()


def collection(files: DataFrame, done: DataFrame, attachments: DataFrame, silent: DataFrame, now: int) -> DataFrame:
    """file and reason of files (file, kind, device, ref, at) that may go: job-done, orphan-att, phone-silent or old-claim; the first reason counts.

    Files of jobs (job, cancel, status) go with their job; an attachment (ref) goes if all jobs that name it (job, sha) are done, or with none after 30 days; a device
    that is silent (device) loses its device and acks files; of claims all but the newest go.
    """
    jobs = files.where(F.col("kind").isin("job", "cancel", "status")).join(done.select(F.col("job").alias("ref")), "ref", "left_semi").select("file", F.lit(1).alias("rank"), F.lit("job-done").alias("reason"))
    uses = attachments.join(done.select("job", F.lit(True).alias("done")), "job", "left").groupBy(F.col("sha").alias("ref")).agg(F.bool_and(F.col("done").isNotNull()).alias("all_done"))
    att = files.where("kind = 'att' AND ref IS NOT NULL").join(uses, "ref", "left")
    old = F.lit(now) - F.col("at") > ORPHAN_DAYS * DAY
    att = att.where(F.col("all_done") | (F.col("all_done").isNull() & old)).select("file", F.when(F.col("all_done"), 1).otherwise(2).alias("rank"), F.when(F.col("all_done"), "job-done").otherwise("orphan-att").alias("reason"))
    quiet = files.where(F.col("kind").isin("device", "acks")).join(silent.select("device"), "device", "left_semi").select("file", F.lit(3).alias("rank"), F.lit("phone-silent").alias("reason"))
    claims = files.where("kind = 'claim'")
    newest = claims.agg(F.max(F.struct("at", "device", "file")).alias("newest"))  # one row
    stale = claims.join(F.broadcast(newest)).where(F.struct("at", "device", "file") < F.col("newest")).select("file", F.lit(4).alias("rank"), F.lit("old-claim").alias("reason"))
    return jobs.unionByName(att).unionByName(quiet).unionByName(stale).groupBy("file").agg(F.min_by("reason", "rank").alias("reason"))


def acknowledged(jobs: DataFrame, most: int = 10_000) -> DataFrame:
    """device, n and ids_sha (of the ids in order, joined by commas) of the newest `most` jobs (device, id, at) of each device; a list holds `most` ids at most."""
    place = F.row_number().over(Window.partitionBy("device").orderBy(F.desc("at"), F.desc("id")))
    newest = jobs.where("device IS NOT NULL").select("device", "id", "at").withColumn("place", place).where(F.col("place") <= most)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",")
    return newest.groupBy("device").agg(F.count("*").alias("n"), F.sha2(ids, 256).alias("ids_sha"))
