"""Filter interaction audit: what each filter of a chain removes, alone and in every order.

Each document becomes five failure flags.  Rows that are alike in flags, part and labels are
one row with a count, and a SQL ``CUBE`` over the flags and the part adds them up for every
subset of filters: the grouping-set row whose selected flags are all false counts the
documents that survive that subset.  Joining the subsets in pairs, with and without one more
filter, gives what the filter removes after any others; a step of an order is such a pair.
So no order is replayed over documents: texts are read once and the cube starts from
at most 32 rows a part and label.

Identical texts are found by digest: least id of each digest by a partial aggregation, then a
many-to-one join that AQE splits where a third of all texts are equal.

Defined results: null text is empty, a null part the empty string.  A text without words passes
the share of distinct words, an empty one that of capitals.  A row without an id is no copy of any and
no row is one of it; rows with the same id and text are no copies of each other.  Of several label
rows of an id, one that says 1 decides; unlabelled documents count as neither.  An empty table gives no
rows.  Further columns are not read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Least words; least share of distinct words, and largest of capitals, in hundredths.
WORDS, DISTINCT, CAPITALS = 200, 50, 3
LETTERS = "ABCDE"
COUNTS = ["n", "good", "toxic"]
_CAPITALS = "".join(map(chr, range(65, 91)))


def failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides, by letter."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return {
        "A": F.size(words) < WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT,
        "C": capitals * 100 > F.length(text) * CAPITALS,
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, A, B, C, D, E, good, toxic``: a row per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    fails = [c.alias(letter) for letter, c in failures(F.col("text")).items()]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    rows = common.written(texts.select("id", "part", F.sha2("text", 256).alias("digest"), *fails), "filter-flags")  # texts are read once
    least = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    told = told.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    out = rows.join(least, "digest", "left").join(told, "id", "left")
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("E")
    return out.select("part", "A", "B", "C", "D", copy, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def survivors(flags: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``part, subset, n, good, toxic``: documents that no filter of the subset (a bit per letter) fails; none is a row too."""
    alike = flags.groupBy("part", *letters).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    totals = [F.sum(c).alias(c) for c in COUNTS]
    chosen = [F.grouping(c).alias(f"all_{c}") for c in ("part", *letters)]
    cube = alike.cube(*letters, "part").agg(*totals, *chosen)
    passed = F.lit(True)
    for c in letters:
        passed = passed & ((F.col(f"all_{c}") == 1) | ~F.col(c))
    bits = sum(((1 - F.col(f"all_{c}")) * (1 << i) for i, c in enumerate(letters)), F.lit(0))
    found = cube.where((F.col("all_part") == 0) & passed).select("part", bits.cast("int").alias("subset"), *COUNTS)
    every = found.where("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").na.fill(0, COUNTS)


def interactions(subsets: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the survivors of every subset."""
    spark, k = subsets.sparkSession, len(letters)
    pairs, steps = [], []
    for i, letter in enumerate(letters):
        for s in (s for s in range(1 << k) if not s >> i & 1):
            before = s.bit_count()
            pairs.append((letter, s, s | 1 << i, math.factorial(before) * math.factorial(k - 1 - before)))
    for order in itertools.permutations(letters):
        for step, letter in enumerate(order, 1):
            steps.append(("".join(order), step, letter, sum(1 << letters.index(x) for x in order[: step - 1])))
    # fixed sizes, whatever the input: k 2^(k-1) pairs and k k! steps
    pairs = F.broadcast(spark.createDataFrame(pairs, "filter string, subset int, with_it int, orders long"))
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, subset int"))
    after = subsets.select("part", F.col("subset").alias("with_it"), *[F.col(c).alias(f"{c}_left") for c in COUNTS])
    lost = subsets.join(pairs, "subset").join(after, ["part", "with_it"])
    lost = lost.select("part", "filter", "subset", "orders", F.col("n_left").alias("kept"), *[(F.col(c) - F.col(f"{c}_left")).alias(f"{c}_lost") for c in COUNTS])
    most = (1 << k) - 1
    alone = F.create_map(*itertools.chain(*[(F.lit(c), F.lit(most ^ 1 << i)) for i, c in enumerate(letters)]))
    whole = lost.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("subset") == 0, F.col("n_lost"))).alias("fails"),
        F.sum(F.when(F.col("subset") == alone[F.col("filter")], F.col("n_lost"))).alias("unique_fails"),
        F.sum(F.col("orders") * F.col("n_lost")).alias("shapley"),
    )
    out = lost.join(steps, ["filter", "subset"]).join(whole, ["part", "filter"])
    return out.select(
        "part", "filter_order", "step", "filter", "kept", F.col("n_lost").alias("removed"), (F.col("fails") - F.col("n_lost")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    flags = flagged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    subsets = common.written(survivors(flags), "filter-subsets")  # 32 rows a part, read four times
    return interactions(subsets)


ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
worded AS (SELECT *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM texts),
least AS (SELECT body AS same, min(doc_id) AS least FROM texts GROUP BY body),
told AS (SELECT doc_id AS id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
         + 4 * CAST(100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) AS INT)
         + 8 * CAST(regexp_matches(body, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > least, false) AS INT) AS mask
  FROM worded LEFT JOIN least ON body = same LEFT JOIN told ON doc_id = id),
masks AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, [a.letter, b.letter, c.letter, d.letter, e.letter] AS names
  FROM letters a, letters b, letters c, letters d, letters e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, names[step] AS filter, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
played AS (
  SELECT part, filter_order, step, filter,
         coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM played
"""
