"""Line deduplication across documents, in DataFrame operations only.

Every line of every text is exploded to a 128-bit hash of its normalised form; distinct
documents are counted for each hash; lines over the threshold go from every document but
the one with the largest doc_id, and what stays is put together by position.

Defined cases: an empty table gives no rows, and texts of any length are read whole.
A null or empty text is one empty line. A null doc_id names no document: such
a row counts for no line and keeps its text. Rows that repeat a doc_id are one document when
documents are counted, and each row keeps or loses its own lines. Extra columns are carried
along by `dedup_lines`; a column named like one of its outputs is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecpress.llm.common import SPACES, ascii_lower, materialize, shuffled

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of each line whose key is long enough to count.

    row tells rows apart that share a doc_id but not the text.
    """
    pieces = docs.where("doc_id is not null and text is not null").select(
        "doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    return (
        pieces.where(F.length("line") >= min_chars)
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def repeated_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lines: doc_id, h1, h2. (h1, h2, n_docs, keeper) of each line key that at least min_docs
    documents hold.

    The distinct (key, document) pairs are dealt by both, so that a line of a third of all
    documents spreads over all tasks; only per-task counts then meet by key.
    """
    pairs = lines.select("h1", "h2", "doc_id").distinct()
    return (
        pairs.groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text replaced by what stays, and the numbers of lines before and of those
    dropped (long) under `names`. Texts are split and hashed once, and the hashes written."""
    lines = materialize(_lines(docs, min_chars), "lines")
    repeated = materialize(repeated_lines(lines, min_docs), "repeated")
    found = shuffled(repeated.select("h1", "h2", "keeper"))
    drops = (
        lines.join(found, ["h1", "h2"])
        .where("doc_id <> keeper")
        .groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row"))
        .agg(F.collect_set("pos").alias("__drop"))
    )
    drops = shuffled(materialize(drops, "drops"))
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.join(drops, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__row")), "left")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    rows = rows.withColumn("__n", n_lines)
    keep = F.array_except(F.sequence(F.lit(0), F.col("__n") - 1), F.col("__drop"))
    lines = F.split("text", "\n", -1)
    joined = F.array_join(F.transform(keep, lambda i: F.get(F.col("__lines"), i)), "\n")
    touched = F.col("__drop").isNotNull()
    return (
        rows.withColumn("__lines", F.when(touched, lines))
        .withColumn("text", F.when(touched, joined).otherwise(F.col("text")))
        .withColumn(names[0], F.col("__n").cast("long"))
        .withColumn(names[1], F.when(touched, F.size("__drop")).otherwise(0).cast("long"))
        .drop("__id", "__row", "__drop", "__n", "__lines")
    )


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query op7: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL for the same rows.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS dropped
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
