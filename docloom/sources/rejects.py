"""Lines read as rows of a schema, where what can't be read becomes a reject with a code and a reason: kept and rejected rows add up to the lines.

Nulls and edge cases: a null line is empty; an empty value is null, which any column may be; a file with more bad lines than it may have is rejected as a whole, its good
lines too; an empty table gives no rows; keys and file may be null; columns are named in the docstrings, others are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The share of bad lines that a file may have.
BAD_SHARE = 0.5
EMPTY, FIELDS, VALUE, FILE = "E_EMPTY", "E_FIELDS", "E_VALUE", "E_FILE"


def parsed(lines: DataFrame, schema: T.StructType, bad_share: float = BAD_SHARE) -> DataFrame:
    """key, file, line, code, reason (both null: kept) and row (null: rejected) of lines (key, file, line)."""
    ddl = lambda kind: ", ".join(f"`{f.name}` {kind or f.dataType.simpleString()}" for f in schema.fields)
    line = F.coalesce("line", F.lit(""))
    fields = F.from_csv(line, ddl("string"), {"mode": "PERMISSIVE"})
    typed = F.from_csv(line, ddl(None), {"mode": "PERMISSIVE"})
    each = lines.select("key", "file", "line", F.size(F.split(F.regexp_replace(line, r'"(?:[^"\\]|\\.)*"', "x"), ",")).alias("n"), fields.alias("raw"), typed.alias("row"))
    wrong = F.filter(F.array(*[F.when(F.col("raw")[f.name].isNotNull() & F.col("row")[f.name].isNull(), F.lit(f.name)) for f in schema.fields]), lambda x: x.isNotNull())
    judged = each.withColumn("wrong", wrong)
    code = F.when(F.trim(F.coalesce("line", F.lit(""))) == "", EMPTY).when(F.col("n") != len(schema.fields), FIELDS).when(F.size("wrong") > 0, VALUE)
    reason = F.when(code == EMPTY, "no value").when(code == FIELDS, F.concat("n", F.lit(f" fields of {len(schema.fields)}"))).when(code == VALUE, F.concat(F.lit("not readable: "), F.array_join("wrong", ", ")))
    judged = judged.select("key", "file", "line", code.alias("own"), reason.alias("why"), "row")
    files = judged.groupBy(F.col("file").alias("of")).agg((F.count("own") / F.count("*")).alias("bad")).where(F.col("bad") > bad_share)
    found = judged.join(files, F.col("file").eqNullSafe(F.col("of")), "left")
    code = F.coalesce("own", F.when(F.col("bad").isNotNull(), FILE))
    reason = F.coalesce("why", F.when(F.col("bad").isNotNull(), F.concat(F.lit("bad lines: "), F.round(F.col("bad") * 100).cast("int"), F.lit(" %"))))
    kept = F.struct(*[F.col("row")[f.name].alias(f.name) for f in schema.fields])
    return found.select("key", "file", "line", code.alias("code"), reason.alias("reason"), F.when(code.isNull(), kept).alias("row"))
