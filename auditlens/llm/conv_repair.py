"""Repair of damaged dialogues at least cost, by a dynamic programme over a trie of signatures.

A dialogue's rows are one letter each: the initial of the role (system, user, assistant, other)
and the row's first fault.  The letters in order are its signature; many dialogues have
the same.  Different signatures are sorted, so that each task walks a prefix trie of its range: what
two neighbours share is a path whose layers are already there, and only the rest is computed.  A
layer holds, for each of four states of the grammar ``(s?(ua)+)?``, the least cost of the
prefix and the rank of its edits among the states' edits.  Every such text of edits ends with
the letter of the prefix's last row, so none is the beginning of another and ranks decide between equal
costs.  Layers are relative to their least cost and leave out hopeless states, so few are different and a step is
a look-up.
Answers are emitted at terminal nodes and joined back to the dialogues.

Rows that are equal in conversation, turn, role and text are one row with a count before
anything else.  Rows are put in order by ranges of (conversation, turn, role, text), so a
conversation with a third of all rows is spread over tasks and cut into segments of bounded size; what is gathered
of a whole conversation is a letter a row and an entry a segment, as the column of edits is a letter a row itself.
A SHA-256 over a conversation is a chain: texts of several segments are hashed one after the
other as they stream through a task, never held together.

Defined results: null role, text, conversation and turn read as one space where a text is made of
them; turns come null first, equal turns by role, then text.  A role with another initial than
``s``, ``u``, ``a``, or none, fits nowhere and is never legal beside another.  A null conversation is one like any
other; one whose rows were all dropped has zeros and empty results.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows and characters of a segment, at most (a row is never cut).
SEGMENT_ROWS, SEGMENT_CHARS = 1_000, 4 << 20
#: Characters of a text or signature that ranges look at; the order within a range looks at all.
RANGE_CHARS = 128
#: States of the grammar: nothing yet, after s, after u, after a; the state after each output.
START, S, U, A = range(4)
_AFTER = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
_ENDS = (START, A)
#: Initials and faults that a letter stands for: chr(97 + 4 * initial + fault).
INITIALS, OK, CUT, BLANK, COPY = "suax", 0, 1, 2, 3


def letter(initial: str, fault: int) -> str:
    return chr(97 + 4 * INITIALS.index(initial) + fault)


def _edits(state: int, symbol: str):
    """(state after, cost, edits) for a row read in ``state``; inserted turns come before the row's own edit."""
    initial, fault = INITIALS[(ord(symbol) - 97) // 4], (ord(symbol) - 97) % 4
    inserted, cost, at = "", 0, state
    for _ in range(3):
        yield at, cost + DELETE, inserted + "D"
        if fault in (OK, CUT):
            extra = TRUNCATED if fault == CUT else 0
            if initial in _AFTER[at]:
                yield _AFTER[at][initial], cost + KEEP + extra, inserted + "K"
            yield (A if at == U else U), cost + REROLE + extra, inserted + "R"
        at, cost, inserted = (A if at == U else U), cost + INSERT, inserted + "I"


#: A state this much dearer than the least is on no cheapest way: from any state two inserted turns and a deleted row
#: (10) lead to what it can do.  So there are few layers.
HOPELESS = 12
#: A layer: for each state (cost above the least, rank) or None.
Layer = tuple


class Trie:
    """Layers along the current path of a trie whose nodes are visited in sorted order."""

    BEGIN: Layer = ((0, 0), None, None, None)

    def __init__(self):
        self.path, self.layers, self.sums = "", [self.BEGIN], [0]
        self.back: list[tuple] = []  # per symbol of the path: for each state (state before, edits)
        self.known: dict[tuple[Layer, str], tuple[Layer, int, tuple]] = {}
        self.computed = 0

    def _step(self, layer: Layer, symbol: str) -> tuple[Layer, int, tuple]:
        best: list = [None] * 4
        for before, held in enumerate(layer):
            if held:
                for after, cost, edits in _edits(before, symbol):
                    option = (held[0] + cost, held[1], edits, before)
                    if best[after] is None or option < best[after]:
                        best[after] = option
        least = min(x[0] for x in best if x)
        best = [x if x and x[0] <= least + HOPELESS else None for x in best]
        order = sorted(x[1:3] for x in best if x)
        return tuple(x and (x[0] - least, order.index(x[1:3])) for x in best), least, tuple(x and (x[3], x[2]) for x in best)

    def answer(self, signature: str) -> tuple[int, str]:
        """Cost and edits of a signature; layers of the prefix shared with the one before are reused."""
        shared = 0
        for x, y in zip(self.path, signature):
            if x != y:
                break
            shared += 1
        del self.layers[shared + 1 :], self.sums[shared + 1 :], self.back[shared:]
        for symbol in signature[shared:]:
            key = (self.layers[-1], symbol)
            found = self.known.get(key)
            if found is None:
                found = self.known[key] = self._step(*key)
            self.computed += 1
            self.layers.append(found[0])
            self.sums.append(self.sums[-1] + found[1])
            self.back.append(found[2])
        self.path = signature
        ends = []
        for state, held in enumerate(self.layers[-1]):
            if held:
                more = 0 if state in _ENDS else 1 if state == U else 2
                ends.append((held[0] + more * INSERT, held[1], more, state))
        cost, _, more, state = min(ends)
        parts = ["I" * more]
        for step in reversed(self.back):
            state, edits = step[state]
            parts.append(edits)
        return cost + self.sums[-1], "".join(reversed(parts))


def _crc(conv: Column, turn: Column) -> Column:
    said = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n``: the damaged rows, equal ones once with their number; dropped rows count 0."""
    r = F.col("__r")
    held = rows.withColumn("__r", _crc(F.col("conv_id"), F.col("turn"))).select(
        "conv_id",
        F.when(r != 0, F.col("turn")).alias("turn"),
        F.when(r == 0, "").when(r == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(r.isin(0, 1), "").when(r == 2, F.regexp_replace(F.coalesce("text", F.lit(" ")), "[.!?]", "")).otherwise(F.coalesce("text", F.lit(" "))).alias("text"),
        F.when(r == 0, 0).when(r == 3, 2).otherwise(1).alias("n"),
    )
    dropped = (F.col("n") == 0).alias("dropped")
    return held.groupBy("conv_id", "turn", "role", "text", dropped).agg(F.sum("n").cast("long").alias("n")).drop("dropped")


def faults(rows: DataFrame) -> DataFrame:
    """``damaged`` rows with ``first`` and ``rest``: the letters of a row and of each further equal one."""
    initial = F.substring("role", 1, 1)
    base = F.when(initial == "s", 0).when(initial == "u", 4).when(initial == "a", 8).otherwise(12)
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    blank = last == ""
    same, of = ["conv_id", "role", "digest"], ["of_conv", "of_role", "of_digest"]
    live = rows.where("n > 0").where(~blank).select("conv_id", "role", F.sha2("text", 256).alias("digest"), "turn")
    # turns of a text: partial aggregation, and only texts of several turns are joined back
    seen = live.groupBy(*[F.col(a).alias(b) for a, b in zip(same, of)]).agg(
        F.count("*").alias("turns"), F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("null_turn")
    ).where("turns > 1").drop("turns")
    keyed = rows.withColumn("digest", F.when(~blank & (F.col("n") > 0), F.sha2("text", 256)))
    on = F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest"))
    joined = keyed.join(seen, on, "left")
    earlier = F.col("turn").isNotNull() & (F.col("null_turn") | (F.col("turn") > F.col("least")))
    fault = F.when(blank, BLANK).when(F.coalesce(earlier, F.lit(False)), COPY).when(~last.isin(".", "!", "?"), CUT).otherwise(OK)
    code = lambda f: F.char(F.lit(97) + base + f)
    return joined.select(*rows.columns, code(fault).alias("first"), code(F.when(blank, BLANK).otherwise(COPY)).alias("rest"))


_SEGMENT = "conv_id {id}, place long, size long, letters string, role array<string>, text array<string>, n array<long>"


def segments(rows: DataFrame) -> DataFrame:
    """Rows with letters as ordered segments of a conversation: ``conv_id, place, size, letters, role, text, n``."""
    ranges = ["conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, RANGE_CHARS)]
    ordered = rows.repartitionByRange(*ranges).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    ordered = ordered.select("conv_id", "role", "text", "n", "first", "rest", F.spark_partition_id().alias("task"))
    conv_type = rows.schema["conv_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"role": [], "text": [], "n": [], "letters": []}
        conv, chars, place, kind = None, 0, 0, None

        def flush():
            nonlocal chars, place
            out = pa.RecordBatch.from_arrays(
                [pa.array([conv], kind), pa.array([place], pa.int64()), pa.array([sum(held["n"])], pa.int64()), pa.array(["".join(held["letters"])]),
                 pa.array([held["role"]], pa.list_(pa.string())), pa.array([held["text"]], pa.list_(pa.string())), pa.array([held["n"]], pa.list_(pa.int64()))],
                ["conv_id", "place", "size", "letters", "role", "text", "n"],
            )
            for x in held.values():
                x.clear()
            chars, place = 0, place + 1
            return out

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for c, role, text, n, first, rest, task in zip(*[batch.column(i).to_pylist() for i in range(7)]):
                if held["n"] and (c != conv or len(held["n"]) >= SEGMENT_ROWS or chars + len(text) > SEGMENT_CHARS):
                    yield flush()
                conv, place, chars = c, max(place, task << 40), chars + len(text)
                held["role"].append(role)
                held["text"].append(text)
                held["n"].append(n)
                held["letters"].append(first + rest * (n - 1) if n else "")
        if held["n"]:
            yield flush()

    return ordered.mapInArrow(cut, _SEGMENT.format(id=conv_type))


def answers(signatures: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of different signatures: each task walks the trie of a range of them."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [trie.answer(x) for x in names]
            yield pa.RecordBatch.from_pydict({"signature": names, "cost": [c for c, _ in found], "audit": [a for _, a in found]})

    return signatures.repartitionByRange(F.substring("signature", 1, RANGE_CHARS)).sortWithinPartitions("signature").mapInArrow(walk, "signature string, cost long, audit string")


def repaired(held: Iterator[tuple[str, str, int]], edits: str, state: int) -> str:
    """Lines of a segment's rows (role, text, number) after its edits, each ended by a newline."""
    out, rows = [], ((role, body) for role, body, n in held for _ in range(n))
    for e in edits:
        if e == "D":
            next(rows)
            continue
        role, body = (None, "") if e == "I" else next(rows)
        if e == "K":
            state = _AFTER[state][role[:1]]
        else:
            state = A if state == U else U
            role = "assistant" if state == A else "user"
        out.append(f"{role}:{body}\n")
    return "".join(out)


def state_after(edits: str, initials: Iterator[str], state: int) -> int:
    for e in edits:
        initial = None if e == "I" else next(initials)
        if e == "K":
            state = _AFTER[state][initial]
        elif e != "D":
            state = A if state == U else U
    return state


def slices(planned: DataFrame) -> DataFrame:
    """``conv_id, place, edits, state, last``: the edits of each segment and the grammar's state before it.

    ``planned``: ``conv_id, places`` (of segments, with sizes, in order), ``signature, audit``.
    """
    conv_type = planned.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, {"conv_id": [], "place": [], "edits": [], "state": [], "only": []}
            for conv, places, signature, audit in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "places", "signature", "audit")]):
                at, read, state = 0, 0, START
                for k, p in enumerate(places):
                    begin, left = at, p["size"]
                    while left and at < len(audit):
                        left -= audit[at] != "I"
                        at += 1
                    if k + 1 == len(places):
                        at = len(audit)
                    edits = audit[begin:at]
                    for name, value in zip(out, (conv, p["place"], edits, state, len(places) == 1)):
                        out[name].append(value)
                    state = state_after(edits, (INITIALS[(ord(x) - 97) // 4] for x in signature[read : read + p["size"]]), state)
                    read += p["size"]
            yield pa.RecordBatch.from_arrays([pa.array(out["conv_id"], kind), pa.array(out["place"], pa.int64()), pa.array(out["edits"], pa.string()), pa.array(out["state"], pa.int32()), pa.array(out["only"], pa.bool_())], list(out))

    return planned.select("conv_id", "places", "signature", "audit").mapInArrow(run, f"conv_id {conv_type}, place long, edits string, state int, only boolean")


def repaired_segments(cut: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv_id, place, only, body``: the repaired lines of each segment."""
    conv_type = cut.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = zip(*[part.column(c).to_pylist() for c in ("role", "text", "n", "edits", "state")])
                body = [repaired(zip(role, text, n), e, state) for role, text, n, e, state in rows]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("conv_id", "place", "only")], pa.array(body, pa.string())], ["conv_id", "place", "only", "body"])

    of = edits.select(F.col("conv_id").alias("of"), F.col("place").alias("of_place"), "edits", "state", "only")
    held = cut.join(of, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("place") == F.col("of_place")))
    return held.select("conv_id", "place", "only", "role", "text", "n", "edits", "state").mapInArrow(run, f"conv_id {conv_type}, place long, only boolean, body string")


def hashes(bodies: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``, of all lines joined by newlines; long conversations stream through a task by segment."""
    conv_type = bodies.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, digest, owed = False, None, None, b""
        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, ([], [])
            for c, body in zip(batch.column("conv_id").to_pylist(), batch.column("body")):
                if not begun or c != conv:
                    if begun:
                        out[0].append(conv)
                        out[1].append(digest.hexdigest())
                    begun, conv, digest, owed = True, c, hashlib.sha256(), b""
                raw = body.as_py().encode()
                if raw:
                    digest.update(owed + raw[:-1])  # the newline behind the last line of all is no part of the text
                    owed = b"\n"
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.string())], ["conv_id", "repaired_sha256"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    one = bodies.where("only").select("conv_id", F.sha2(F.left("body", F.length("body") - 1), 256).alias("repaired_sha256"))
    several = bodies.where("not only").select("conv_id", "place", "body").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place")
    return one.unionByName(several.mapInArrow(run, f"conv_id {conv_type}, repaired_sha256 string"))


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    rows = damaged(conversations)
    span = rows.where("n > 0").groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    cut = common.written(segments(faults(rows)), "repair-segments")
    piece = F.struct("place", "size", "letters")
    whole = cut.select("conv_id", piece.alias("piece")).groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    whole = whole.select("conv_id", F.transform("pieces", lambda p: F.struct(p["place"].alias("place"), p["size"].alias("size"))).alias("places"), F.array_join(F.transform("pieces", lambda p: p["letters"]), "").alias("signature"))
    whole = common.written(whole, "repair-signatures")
    planned = common.written(whole.join(answers(whole.select("signature").distinct()), "signature"), "repair-answers")
    digests = hashes(repaired_segments(cut, slices(planned)))
    count = lambda fault: F.length("signature") - F.length(F.translate("signature", "".join(letter(i, fault) for i in INITIALS), ""))
    initials = F.translate("signature", "".join(map(chr, range(97, 113))), "".join(i * 4 for i in INITIALS))
    # pairs that follow the grammar; matches never share more than one letter, so each pair is looked at by itself
    legal = F.regexp_count(initials, F.lit("(?=su|ua|au)"))
    on = lambda other: F.col("conv_id").eqNullSafe(F.col(other))
    out = planned.join(span.withColumnRenamed("conv_id", "of_span"), on("of_span"), "left").join(digests.withColumnRenamed("conv_id", "of_digest"), on("of_digest"))
    return out.select(
        "conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"),
        *[count(f).cast("long").alias(name) for name, f in (("blank", BLANK), ("duplicate", COPY), ("truncated", CUT))],
        (F.greatest(F.length("signature") - 1, F.lit(0)) - legal).cast("long").alias("illegal"),
        "cost", "audit", "repaired_sha256",
    )


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def _oracle() -> str:
    """The same programme as a fold over each conversation's rows: four states of (cost, edits, lines)."""
    add = lambda x, cost, edit, line="''": f"{{'c': ({x}).c + {cost}, 'e': ({x}).e || '{edit}', 'b': ({x}).b || {line}}}"
    best = lambda *options: f"list_min([{', '.join(options)}])"
    none = "{'c': 1000000000, 'e': '~', 'b': ''}"
    when = lambda test, x: f"CASE WHEN {test} THEN {x} ELSE {none} END"
    ins = lambda x, role: add(x, INSERT, "I", f"'{role}:' || chr(10)")
    open_u = best("acc.c", ins("acc.a", "user"), ins("acc.b", "user"), ins("acc.d", "user"))
    open_a = best("acc.d", ins(open_u, "assistant"))
    pre = {"a": "acc.a", "b": "acc.b", "c": open_u, "d": open_a}
    extra = "CASE WHEN x.cut THEN 3 ELSE 0 END"
    own = "x.role || ':' || x.text || chr(10)"
    keep = lambda s, i: when(f"NOT x.dead AND x.i = '{i}'", add(pre[s], extra, "K", own))
    rerole = lambda s, role: when("NOT x.dead", add(pre[s], f"3 + {extra}", "R", f"'{role}:' || x.text || chr(10)"))
    drop = lambda s: add(pre[s], DELETE, "D")
    new = {
        "a": drop("a"),
        "b": best(drop("b"), keep("a", "s")),
        "c": best(drop("c"), *[keep(s, "u") for s in "abd"], *[rerole(s, "user") for s in "abd"]),
        "d": best(drop("d"), keep("c", "a"), rerole("c", "assistant")),
    }
    step = "{" + ", ".join(f"'{k}': {v}" for k, v in new.items()) + "}"
    begin = f"{{'a': {{'c': 0, 'e': '', 'b': ''}}, 'b': {none}, 'c': {none}, 'd': {none}}}"
    return rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([CAST(n AS BIGINT)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hashed AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda s: CAST(ascii(s) AS BIGINT))),
           lambda c, s: xor(c >> 8, t[1 + (xor(c, s) & 255)])), 4294967295) % 20 AS r
  FROM conversations, crc),
struck AS (
  SELECT conv_id, turn, CASE WHEN r = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE WHEN r = 1 THEN '' WHEN r = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
         unnest(CASE WHEN r = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE r <> 0),
judged AS (
  SELECT *, left(role, 1) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos
  FROM struck),
faulty AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM judged),
read AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
         list_sort(list({{'pos': pos, 'role': role, 'text': text, 'i': i, 'cut': fault = 'truncated', 'dead': fault IN ('blank', 'duplicate')}})) AS rows
  FROM faulty GROUP BY conv_id),
folded AS (SELECT *, list_reduce(rows, lambda acc, x: {step}, {begin}) AS acc FROM read),
ended AS (SELECT *, {best("acc.a", open_a)} AS best FROM folded)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(rtrim(best.b, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE_SQL = _oracle()
