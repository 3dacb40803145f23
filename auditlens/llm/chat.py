"""Multi-party perspective rotation of dialogues, DataFrame functions only.

For every participant the dialogue is rendered with that speaker as the
assistant, all other speakers as named users and system turns as they are, with
the character spans that a loss may be taken on (what the assistant says and its
end mark).

A dialogue is rendered in parts of ``PART`` turn numbers, so a conversation of any
length is never gathered in one task; its parts joined in order are its text.  Equal turns
are one row with a count from the start.  A part's turns in order are cut into pieces of ``MOST``, numbered
from 0, so numbers that are null or used again and again make more pieces, and pieces joined in
order are the part.
Turns are matched to participants by a many-to-one join on the conversation,
which AQE splits where one conversation is very large; the participants of a
conversation are a set of names, kept by partial aggregation.

Defined results: a null or blank role is the unnamed speaker ``unknown``, a user
who is never the assistant; ``system`` never is either, so a conversation of
system turns only has no rows.  Null text is an empty turn.  A null turn comes
first, in a part of its own numbered null.  Turns with one number are ordered by
role, then text; repeated rows are rendered as often as they occur.  A null
conversation is a conversation like any other.  Speakers' names have markup
characters and line breaks replaced by ``_``, and texts have the marks ``<|`` spaced; roles whose
names are equal then are one speaker, with one perspective and mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

PART = 64
#: Turns of a piece.
MOST = 1_000
#: Characters of a text that ranges of crowded turns look at.
RANGE_CHARS = 128
UNKNOWN = "unknown"
#: Fixed template: header before a turn and mark after it.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def speaker(role: Column) -> Column:
    """The speaker's name as rendered."""
    name = F.trim(F.regexp_replace(F.coalesce(role, F.lit("")), r"[<|>\r\n\t]", "_"))
    return F.when(name == "", F.lit(UNKNOWN)).otherwise(name)


def in_pieces(rows: DataFrame, most: int) -> DataFrame:
    """``conv_id, part, turn, name, body, copies, piece``: equal rows once with their number, by one rule: a part's turns in
    order, ``most`` a piece.

    Parts that are one piece need no positions.  The turns of the others are dealt by ranges of that order, so
    a crowded part is many tasks; running sums within a range, and of ranges within a part, are their positions.
    """
    key = ["conv_id", "part"]
    rows = rows.groupBy(*key, "turn", "name", "body").agg(F.count("*").alias("copies"))
    total = rows.groupBy(F.col("conv_id").alias("of"), F.col("part").alias("of_part")).agg(F.sum("copies").alias("turns"))
    placed = rows.join(total, F.col("conv_id").eqNullSafe(F.col("of")) & F.col("part").eqNullSafe(F.col("of_part")))
    columns = [*key, "turn", "name", "body"]
    whole = placed.where(F.col("turns") <= most).select(*columns, F.col("copies").cast("int").alias("copies"), F.lit(0).cast("long").alias("piece"))
    crowd = placed.where(F.col("turns") > most).select(*columns, "copies")
    dealt = crowd.repartitionByRange(*key, "turn", "name", F.substring("body", 1, RANGE_CHARS)).withColumn("range", F.spark_partition_id())
    dealt = common.written(dealt, "crowded-turns")  # freezes the ranges
    inner = Window.partitionBy(*key, "range").orderBy("turn", "name", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = dealt.groupBy(F.col("conv_id").alias("of"), F.col("part").alias("of_part"), F.col("range").alias("of_range")).agg(F.sum("copies").alias("turns"))
    before = F.coalesce(F.sum("turns").over(Window.partitionBy("of", "of_part").orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("of", "of_part", "of_range", before.alias("before"))
    on = F.col("conv_id").eqNullSafe(F.col("of")) & F.col("part").eqNullSafe(F.col("of_part")) & (F.col("range") == F.col("of_range"))
    ends = dealt.withColumn("end", F.sum("copies").over(inner)).join(ranges, on).withColumn("end", F.col("end") + F.col("before")).withColumn("start", F.col("end") - F.col("copies"))
    pieces = ends.withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / most), F.floor((F.col("end") - 1) / most))))
    inside = F.least("end", (F.col("piece") + 1) * most) - F.greatest("start", F.col("piece") * most)
    return whole.unionByName(pieces.select(*columns, inside.cast("int").alias("copies"), F.col("piece").cast("long").alias("piece")))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART, most: int = MOST) -> DataFrame:
    """One row per conversation, participant, part and piece: ``conv_id, perspective, part, piece, n_turns, n_masked, rendered, spans``.

    ``spans``: start and end (exclusive) of the characters of ``rendered`` that count.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.floor(F.col(turn_col) / part).alias("part"),
        speaker(F.col(role_col)).alias("name"),
        F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"<\|", "< |").alias("body"),
    )
    parties = (
        rows.where(~F.col("name").isin("system", UNKNOWN))
        .groupBy(F.col("conv_id").alias("of"))
        .agg(F.array_sort(F.collect_set("name")).alias("parties"))
    )
    seen = in_pieces(rows, most).join(parties, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    seen = seen.withColumn("perspective", F.explode("parties")).drop("parties")
    own = F.col("name") == F.col("perspective")
    header = (
        F.when(F.col("name") == "system", F.lit("system"))
        .when(own, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), F.col("name")))
    )
    head = F.concat(F.lit(OPEN), header, F.lit(MIDDLE))
    tail = F.concat(F.col("body"), F.lit(CLOSE))
    key = ["conv_id", "perspective", "part", "piece"]
    turn = F.struct("turn", "name", "body", head.alias("head"), tail.alias("tail"), own.alias("own"), "copies").alias("turn")
    grouped = seen.select(*key, turn).groupBy(*key).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    grouped = grouped.withColumn("turns", F.flatten(F.transform("turns", lambda p: F.array_repeat(p, p["copies"]))))
    sizes = F.transform("turns", lambda p: F.length(p["head"]) + F.length(p["tail"]))
    # running ends in one pass: the last element is the sum so far
    ends = F.aggregate(
        sizes,
        F.array(F.lit(0)),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )
    grouped = grouped.withColumn("ends", ends)
    marked = F.filter(
        F.transform(
            "turns",
            lambda p, i: F.struct(
                (F.get("ends", i) + F.length(p["head"])).alias("start"), F.get("ends", i + 1).alias("end"), p["own"].alias("own")
            ),
        ),
        lambda s: s["own"],
    )
    spans = F.transform(marked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return grouped.select(
        *key,
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"])).alias("n_masked"),
        F.array_join(F.transform("turns", lambda p: F.concat(p["head"], p["tail"])), "").alias("rendered"),
        spans.alias("spans"),
    )


def op9_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    """Spans as text ``start-end,...`` so that results compare as plain columns."""
    out = rotate(common.table(spark, sf_dir, "conversations"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumn("spans", text)


ORACLE_SQL = r"""
WITH named AS (
  SELECT conv_id, turn, CAST(floor(turn / 64.0) AS BIGINT) AS part,
         CASE WHEN trim(regexp_replace(coalesce(role, ''), '[<|>\r\n\t]', '_', 'g')) = '' THEN 'unknown'
              ELSE trim(regexp_replace(coalesce(role, ''), '[<|>\r\n\t]', '_', 'g')) END AS name,
         regexp_replace(coalesce(text, ''), '<\|', '< |', 'g') AS body
  FROM conversations),
pieced AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, name, body) - 1) // 1000 AS piece FROM named),
parties AS (SELECT DISTINCT conv_id AS of_conv, name AS perspective FROM named WHERE name NOT IN ('system', 'unknown')),
pieces AS (
  SELECT n.conv_id, p.perspective, n.part, n.piece, n.turn, n.name, n.body, n.name = p.perspective AS own,
         '<|im_start|>' || CASE WHEN n.name = 'system' THEN 'system' WHEN n.name = p.perspective THEN 'assistant'
                                ELSE 'user name=' || n.name END || chr(10) AS head,
         n.body || '<|im_end|>' || chr(10) AS tail
  FROM pieced n JOIN parties p ON n.conv_id IS NOT DISTINCT FROM p.of_conv),
placed AS (
  SELECT *, row_number() OVER w AS pos, sum(length(head) + length(tail)) OVER w AS stop
  FROM pieces WINDOW w AS (PARTITION BY conv_id, perspective, part, piece ORDER BY turn NULLS FIRST, name, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, part, piece, count(*) AS n_turns,
       CAST(coalesce(sum(length(tail)) FILTER (own), 0) AS BIGINT) AS n_masked,
       string_agg(head || tail, '' ORDER BY pos) AS rendered,
       coalesce(string_agg(CAST(stop - length(tail) AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY pos) FILTER (own), '') AS spans
FROM placed GROUP BY conv_id, perspective, part, piece
"""
