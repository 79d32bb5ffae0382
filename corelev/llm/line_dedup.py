"""Line de-duplication with DataFrame functions only.

Lines are exploded and normalised, their hashes counted by distinct document, lines over
the threshold dropped, and the rest joined again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelev.llm.common import table, written

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks (x20, x09-x0D) at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id",
               text_col: str = "text", stats: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``.

    A line's key is ``line_key``; keys of at least ``min_chars`` code points found in at least
    ``min_docs`` distinct documents lose all their lines except in the largest id that holds them.
    ``stats`` names two added columns (lines before dropping, lines dropped), which replace
    columns of the same name; None adds none.

    Null or empty text is one empty line and stays as it is. Repeated rows (same id) count as one
    document and are treated alike; rows with a null id count as one document, never the largest
    unless they are the only ones. An empty table gives an empty table. Other columns pass through.

    Each line key is first reduced to one row per (key, document) and then counted with map-side
    partial sums, so a line that a third of all documents hold is never gathered in one task. The
    text moves once, in the join with the dropped positions of its own document.
    """
    keep = [c for c in docs.columns if c != text_col and not (stats and c in stats)]
    text = F.col(f"`{text_col}`")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(keep)],
                       F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_row"), text.isNull().alias("_null"),
                       F.split(F.coalesce(text, F.lit("")), "\n").alias("_lines"))
    key = line_key(F.col("_line"))
    lines = (rows.select("_id", "_row", F.posexplode("_lines").alias("_pos", "_line"))
             .where(F.length(key) >= min_chars)
             .select("_id", "_row", "_pos", F.unhex(F.md5(key)).alias("_key")))
    lines = written(lines, "line_keys")  # read twice; the keys cost more than the table
    often = (lines.select("_key", "_id").distinct().groupBy("_key")
             .agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_last"))
             .where(F.col("_n") >= min_docs).select("_key", "_last"))
    gone = (lines.join(often, "_key").where(~F.col("_id").eqNullSafe(F.col("_last")))
            .groupBy(F.col("_id").alias("_gid"), F.col("_row").alias("_grow"))
            .agg(F.collect_set("_pos").alias("_gone")))
    both = rows.join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_row") == F.col("_grow")), "left")
    size = F.size("_lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), size - 1), F.col("_gone")), lambda i: F.get("_lines", i))
    new = F.when(F.col("_null"), F.lit(None).cast("string")).otherwise(
        F.array_join(F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(kept), "\n"))
    named = {c: F.col(f"_o{i}") for i, c in enumerate(keep)} | {text_col: new}
    out = [named[c].alias(c) for c in docs.columns if c in named]
    if stats:
        out += [size.cast("long").alias(stats[0]), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(stats[1])]
    return both.select(*out)


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
o AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.doc_id, k.line, k.pos, o.key IS NOT NULL AND k.doc_id <> o.last AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line de-duplication over all ``documents``: line counts and the digest of the kept text."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
