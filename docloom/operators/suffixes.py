"""Longest-suffix match: the registrable part of hosts by a table of suffix rules.

A host's suffixes are exploded and meet the rules by equality; the longest rule that fits counts. A rule `*.x` stands for any one label before x, a rule `!x` takes
x out of such a rule. A host's key is the suffix and the label before it.

Nulls and edge cases: a null host has no key; an address, a single label and a host that is a suffix itself are their own key; a host that no rule fits is matched by its last
label; repeated hosts are kept, repeated rules are one; an empty table of rules leaves the last two labels; an input column named like an added one is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADDRESS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$"


def host_keys(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts (host and others) with host_key; rules has rule."""
    if "host_key" in hosts.columns:
        raise ValueError("column host_key of the input would be lost")
    labels = F.split("h", r"\.")
    names = hosts.select(F.col("host").alias("h")).where(F.col("h").contains(".") & ~F.col("h").rlike(ADDRESS)).distinct()
    tails = names.select("h", F.size(labels).alias("n"), F.posexplode(F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))).alias("i", "tail"))
    # How many labels the suffix has where a rule names this tail: the tail's own, one more under a wildcard, one less at an exception.
    kinds = rules.select(F.regexp_replace("rule", r"^(?:\*\.|!)", "").alias("tail"), F.when(F.startswith("rule", F.lit("*.")), 1).when(F.startswith("rule", F.lit("!")), -1).otherwise(0).alias("more")).distinct()
    met = tails.join(kinds, "tail").withColumn("length", F.col("n") - F.col("i") + F.col("more")).where("length <= n")
    best = met.groupBy("h").agg(F.max(F.struct((F.col("more") < 0).alias("exception"), "length")).alias("m"))
    long = names.join(best.select("h", "m.length"), "h", "left").withColumn("take", F.coalesce("length", F.lit(1)) + 1)
    keyed = long.select("h", F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - F.col("take") + 1), F.size(labels)), ".").alias("host_key"))
    return hosts.join(keyed, F.col("host") == F.col("h"), "left").drop("h").withColumn("host_key", F.coalesce("host_key", "host"))
