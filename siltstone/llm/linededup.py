"""Line deduplication over overlapping windows of three consecutive lines.

A window is three neighbouring lines of one text, split at ``\\n``.  Equal
windows are found over the whole table by a 128-bit hash; of each repeated
window the first occurrence, by (doc_id, line number), stays, and the lines
that any later occurrence covers are removed.  Overlapping windows merge, since
a line goes when at least one of them covers it.

Everything is DataFrame code.  Hot windows are pre-aggregated before the
shuffle that counts them; the join that marks later occurrences is an equi-join
whose hot keys adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

WINDOW = 3


def dedup_lines(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the text deduplicated, plus n_lines and n_removed.

    Texts of fewer lines than a window, null and empty texts stay as they are
    (null has no lines).  Windows of blank lines only don't count.  Rows that
    share doc_id and text are one occurrence and are treated alike; a null
    doc_id comes after all others.  Columns called n_lines, n_removed or
    beginning with ``_ld_`` are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", *[c for c in docs.columns if c.startswith("_ld_")])
    keyed = docs.withColumns(
        {"_ld_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)), "_ld_text": F.xxhash64("text")}
    )
    lines = F.split("text", "\n")
    occurrences = (
        keyed.where(F.instr("text", "\n") > 0)
        .select("_ld_id", "_ld_text", lines.alias("_ld_lines"))
        .where(F.size("_ld_lines") >= window)
        .select(
            "_ld_id",
            "_ld_text",
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(0), F.size("_ld_lines") - window),
                    lambda i: F.concat_ws("\n", *[F.get(F.col("_ld_lines"), i + k) for k in range(window)]),
                )
            ).alias("_ld_at", "_ld_window"),
        )
        .where(F.col("_ld_window").rlike(r"\S"))
        .select("_ld_id", "_ld_text", "_ld_at", F.xxhash64("_ld_window").alias("_ld_a"), F.xxhash64(F.lit(11), "_ld_window").alias("_ld_b"))
    )
    scratch = Scratch(spark, "lines")
    occurrences = scratch.save(occurrences, "windows")
    # Written out, so that both sides of the join below are plain exchanges: only those can be split.
    first = scratch.save(
        occurrences.groupBy("_ld_a", "_ld_b")
        .agg(F.count("*").alias("_ld_n"), F.min(F.struct("_ld_id", "_ld_text", "_ld_at")).alias("_ld_first"))
        .where(F.col("_ld_n") > 1)
        .select("_ld_a", "_ld_b", "_ld_first"),
        "first",
    )
    here = F.struct("_ld_id", "_ld_text", "_ld_at")
    later = (
        occurrences.join(first.hint("merge"), ["_ld_a", "_ld_b"])
        .where(here != F.col("_ld_first"))
        .select("_ld_id", "_ld_text", "_ld_at")
        .groupBy("_ld_id", "_ld_text")
        .agg(F.sort_array(F.collect_set("_ld_at")).alias("_ld_later"))
    )
    # Merge: the covered lines of a text, from the window starts.
    covered = F.array_distinct(
        F.flatten(F.transform("_ld_later", lambda p: F.sequence(p, p + window - 1)))
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), "_ld_covered")
    rest = F.array_join(F.transform(kept, lambda i: F.get(F.col("_ld_lines"), i)), "\n")
    covers = scratch.save(later.select("_ld_id", "_ld_text", covered.alias("_ld_covered")), "covered")
    scratch.drop("windows", "first")
    changed = F.col("_ld_covered").isNotNull()
    return (
        keyed.join(covers.hint("merge"), ["_ld_id", "_ld_text"], "left")
        .withColumn("_ld_lines", lines)
        .withColumns(
            {
                "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size("_ld_lines")).cast("bigint"),
                "n_removed": F.when(changed, F.size("_ld_covered")).otherwise(0).cast("bigint"),
                "text": F.when(changed, rest).otherwise(F.col("text")),
            }
        )
        .select(*docs.columns, "n_lines", "n_removed")
    )


ORACLE_SQL = """
WITH d AS (SELECT doc_id, text, coalesce(doc_id, 9223372036854775807) AS k FROM documents),
t AS (SELECT DISTINCT k, text, string_split(text, chr(10)) AS l FROM d WHERE text IS NOT NULL),
w AS (SELECT k, text, unnest(range(1, len(l) - 1)) AS i, l FROM t WHERE len(l) >= 3),
o AS (SELECT k, text, i, array_to_string(l[i:i+2], chr(10)) AS w FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY k, hash(text), i) AS rn FROM o
      WHERE regexp_matches(w, '[^ \\t\\n\\x0B\\f\\r]')),
c AS (SELECT DISTINCT k, text, unnest(range(i, i + 3)) AS p FROM f WHERE rn > 1),
g AS (SELECT k, text, list(p) AS ps FROM c GROUP BY ALL)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
       coalesce(len(g.ps), 0)::BIGINT AS n_removed,
       CASE WHEN g.ps IS NULL THEN d.text ELSE coalesce(array_to_string(
         list_filter(string_split(d.text, chr(10)), lambda x, j: NOT list_contains(g.ps, j)), chr(10)), '') END AS text
FROM d LEFT JOIN g ON g.k = d.k AND g.text = d.text
"""
