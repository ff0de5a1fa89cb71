"""Chat formatting by multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users; the mask lists the character spans of the speaker's
own turns (text and end mark), on which a model would be trained. System turns are the same
for everyone and belong to no participant.

Turns are numbered within their conversation, however long that is: a sort by range over
(conversation, turn, role, text) spreads a conversation over as many tasks as it needs, each
task numbers what it has, and what a task has of a conversation that began before it is offset
by the counts of the tasks before. Only conversations that pass a task's border need that, at
most two for each task. Every PART turns are rendered as one row, so that a conversation of
any length never meets in one group; `join_parts` puts the rows of a dialogue together for
those that want it whole. One row for each conversation, participant and part; a conversation
of up to PART turns has one part, whatever its turns are numbered.

Defined cases: an empty table gives no rows, and texts of any length are kept whole.
A null conv_id is a conversation of its own; a null turn comes first; a null
role is the speaker `unknown`; a null text is empty. Turns with equal numbers are ordered by
role and text, and repeated rows are rendered each. A conversation of system turns alone has
no participant and gives no row. `<|` within texts and names is broken up as `< |`, so that
no text can forge a mark. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecpress.llm.common import materialize

PART = 256
SYSTEM = "system"
END = "<|end|>\n"


def _plain(col: Column, default: str) -> Column:
    return F.replace(F.coalesce(col, F.lit(default)), F.lit("<|"), F.lit("< |"))


def _numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, role, text, n): n from 0 in each conversation."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), _plain(F.col("role"), "unknown").alias("role"), _plain(F.col("text"), "").alias("text"))
    order = ["conv_id", "turn", "role", "text", "__salt"]  # the last parts rows that are alike
    rows = rows.withColumn("__salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", "role", "text", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("place"))
    rows = materialize(rows, "turns")
    ends = rows.groupBy("task").agg(F.min_by("conv_id", "place").alias("a"), F.max_by("conv_id", "place").alias("b"))
    borders = ends.select(F.explode(F.array("a", "b")).alias("border")).distinct()
    pieces = rows.groupBy("conv_id", "task").agg(F.count("*").alias("n"))
    pieces = pieces.join(F.broadcast(borders), F.col("conv_id").eqNullSafe(F.col("border")), "left_semi")  # two for each task
    before = "sum(n) over (partition by conv_id order by task rows between unbounded preceding and 1 preceding)"
    offsets = pieces.select(F.col("conv_id").alias("__c"), F.col("task").alias("__t"), F.expr(before).alias("offset")).where("offset > 0")
    own = rows.withColumn("own", F.expr("row_number() over (partition by conv_id, task order by place) - 1"))
    own = own.join(F.broadcast(offsets), F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("task") == F.col("__t")), "left")  # one for each task
    return own.select("conv_id", "role", "text", (F.col("own") + F.coalesce("offset", F.lit(0))).alias("n"))


def rotate(turns: DataFrame, part: int = PART) -> DataFrame:
    """turns: conv_id, turn, role, text. (conv_id, speaker, part, n_turns, text, mask): part p
    holds the turns p * PART and on; mask is an array of structs (start, stop)."""
    rows = _numbered(turns)
    speakers = rows.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("__c"), F.col("role").alias("speaker")).distinct()
    parts = rows.groupBy("conv_id", F.floor(F.col("n") / part).cast("long").alias("part")).agg(F.sort_array(F.collect_list(F.struct("n", "role", "text"))).alias("turns"))
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("__c")))

    def opening(t: Column) -> Column:
        return (
            F.when(t["role"] == SYSTEM, F.lit("<|system|>\n"))
            .when(t["role"] == F.col("speaker"), F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n")))
        )

    text = F.array_join(F.transform("turns", lambda t: F.concat(opening(t), t["text"], F.lit(END))), "")

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(opening(t)).cast("long")
        stop = start + F.length(t["text"]) + len(END)
        own = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        none = F.slice(own, 1, 0)
        spans = F.concat(state["spans"], F.when(t["role"] == F.col("speaker"), own).otherwise(none))
        return F.struct(stop.alias("at"), spans.alias("spans"))

    empty = F.from_json(F.lit("[]"), "array<struct<start: bigint, stop: bigint>>")
    mask = F.aggregate("turns", F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), step, lambda s: s["spans"])
    return both.select("conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), mask.alias("mask"))


def join_parts(rotated: DataFrame) -> DataFrame:
    """(conv_id, speaker, n_turns, text, mask) of whole dialogues: parts in order, masks shifted
    by the texts before theirs. A dialogue becomes one value of one row."""
    parts = F.sort_array(F.collect_list(F.struct("part", "n_turns", "text", "mask")))

    def step(state: Column, p: Column) -> Column:
        moved = F.transform(p["mask"], lambda m: F.struct((m["start"] + state["at"]).alias("start"), (m["stop"] + state["at"]).alias("stop")))
        return F.struct((state["at"] + F.length(p["text"])).alias("at"), F.concat(state["spans"], moved).alias("spans"))

    empty = F.from_json(F.lit("[]"), "array<struct<start: bigint, stop: bigint>>")
    mask = F.aggregate("parts", F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), step, lambda s: s["spans"])
    whole = rotated.groupBy("conv_id", "speaker").agg(F.sum("n_turns").alias("n_turns"), parts.alias("parts"))
    return whole.select("conv_id", "speaker", "n_turns", F.array_join("parts.text", "").alias("text"), mask.alias("mask"))


def digest(turns: DataFrame) -> DataFrame:
    """The query op9: rotate(), with the mask as text `start-stop,...` for comparison."""
    out = rotate(turns)
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["stop"].cast("string"))), ",")
    return out.withColumn("mask", spans)


#: DuckDB SQL for the same rows.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM rows WHERE role <> 'system'),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS n FROM rows),
rendered AS (
  SELECT r.*, s.speaker, CAST(r.n // 256 AS BIGINT) AS part,
         CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = speaker THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || role || '|>' || chr(10) END AS opening
  FROM numbered r JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.c),
placed AS (
  SELECT *, sum(length(opening) + length(text) + 8) OVER (PARTITION BY conv_id, speaker, part ORDER BY n) AS stop
  FROM rendered)
SELECT conv_id, speaker, part, count(*) AS n_turns,
       string_agg(opening || text || '<|end|>' || chr(10), '' ORDER BY n) AS text,
       coalesce(string_agg(CAST(stop - length(text) - 8 AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY n)
         FILTER (WHERE role = speaker), '') AS mask
FROM placed GROUP BY conv_id, speaker, part
"""
