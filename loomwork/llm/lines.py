"""Operator 1, line dedup: repeated three-line windows lose their later occurrences.

Every three consecutive lines of a text form a window, known by 96 bits of hash. A window's first
occurrence is the least (id, hash of the text, position); every other occurrence is later, and the
lines it covers go. Covered stretches that touch are merged. Each line that goes equals an earlier
line that the same rule judges, so of every repeated passage one copy stays.

Only DataFrame functions: windows are counted with partial sums before the shuffle, and a window
that stands in a large share of all texts is one row of the joined side, so that Spark can split
the other side where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, read

SPAN = 3


def _windows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th, pos (from 0) and hashes h, g of each window."""
    lines = F.transform(F.split(text_col, "\n", -1), lambda s: F.xxhash64(s))
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), lines.alias("l")).where(F.size("l") >= SPAN)
    window = F.transform(
        F.sequence(F.lit(1), F.size("l") - (SPAN - 1)), lambda i: F.struct(*(F.element_at("l", (i + k).cast("int")).alias(f"l{k}") for k in range(SPAN)))
    )
    parts = [f"w.l{k}" for k in range(SPAN)]
    return rows.select("id", "th", F.posexplode(window).alias("pos", "w")).select("id", "th", "pos", F.xxhash64(*parts).alias("h"), F.hash(*parts).alias("g"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with text_col cut to its kept lines, and n_lines and n_removed (long) after its columns.

    Lines end at line feeds and count as they stand, empty ones too. Texts of fewer than three lines,
    empty and null ones stay as they are (a null has no lines). Rows that agree in id and text are one
    text and keep the same lines; a null id comes before all others. Columns of df named n_lines or
    n_removed are replaced. A text of which all lines go becomes empty; no row is dropped.
    """
    i, th, s, l, k, m = free_names(df, "__id", "__th", "__s", "__l", "__k", "__n")
    windows = _windows(df, id_col, text_col)
    here = F.struct("id", "th", "pos")
    first = windows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("first")).where("n > 1").drop("n")
    later = windows.join(first, ["h", "g"]).where(~here.eqNullSafe(F.col("first")))
    starts = later.groupBy(F.col("id").alias(i), F.col("th").alias(th)).agg(F.array_sort(F.collect_set("pos")).alias(s))
    joined = df.join(starts, df[id_col].eqNullSafe(F.col(i)) & (F.xxhash64(df[text_col]) == F.col(th)), "left")
    lines = F.split(df[text_col], "\n", -1)
    n = F.when(df[text_col].isNull(), 0).otherwise(F.size(lines))
    begin = F.concat(F.array(F.lit(0)), F.transform(s, lambda p: p + SPAN))
    end = F.concat(F.col(s), F.array(n))
    kept = F.flatten(F.zip_with(begin, end, lambda a, b: F.when(b > a, F.slice(F.col(l), a + 1, b - a)).otherwise(F.array().cast("array<string>"))))
    out = joined.withColumn(l, F.when(F.col(s).isNotNull(), lines)).withColumn(k, F.when(F.col(s).isNotNull(), kept)).withColumn(m, n)
    names = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    text = F.when(F.col(s).isNull(), df[text_col]).otherwise(F.array_join(k, "\n")).alias(text_col)
    removed = F.when(F.col(s).isNull(), 0).otherwise(F.col(m) - F.size(k)).cast("long").alias("n_removed")
    return out.select(*(text if c == text_col else df[c] for c in names), F.col(m).cast("long").alias("n_lines"), removed)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i AS pos, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS g
      FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later CROSS JOIN (VALUES (0), (1), (2)) AS t(k)),
line AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS s FROM d),
kept AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY pos) AS text, count(*) AS n FROM line ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       CAST(coalesce(len(d.l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(d.l), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN kept k USING (doc_id)
"""
