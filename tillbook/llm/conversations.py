"""Conversation repair: the cheapest edits that make turns alternate and leave no unusable one.

A repaired conversation's role initials read ``(s?(ua)+)?``: an optional system turn, then user and
assistant in turn. What edits cost, and how the cheapest are found by block tables, is in ``edits``.

A conversation is planned on one letter a turn, so texts never leave the JVM for that. Ordinary
conversations are gathered whole. One with very many turns (see ``hot_keys``) is cut into segments:
each says what it makes of every possible cost vector after it, a short scan over the segments settles which one
it is, and the segments are then traced apart. What stays in one place for such a conversation is one
row a segment, its audit (a letter an edit, one string by contract), and the digest of its repaired
text, which is a sequence by nature and is taken as a stream, a batch of turns at a time.

Odd input. A NULL role or text counts as one space; NULL turns come first; NULL is a conversation
like any other. Turns of one number are ordered by role, then text. Rows repeated in full are
duplicates of the first. Further columns are ignored, missing ones are NULL. ``gaps`` is NULL
where it exceeds a bigint. An empty table gives no rows.
"""

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.functions.ordered import segmented
from tillbook.functions.shared import stored
from tillbook.functions.spread import HOT_FLOOR, hot_keys
from tillbook.llm import edits as E
from tillbook.llm.text import BLANKS, only

COUNTS = ["blank", "duplicate", "truncated", "illegal"]
ORDER = ["turn", "role", "text", "_copy"]

PLAN = pa.struct(
    [(c, pa.int64()) for c in [*COUNTS, "cost"]]
    + [
        ("audit", pa.string()),
        ("steps", pa.list_(pa.struct([("turn", pa.int32()), ("role", pa.int32())]))),
    ]
)
PLAN_SQL = (
    "struct<blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,"
    "audit:string,steps:array<struct<turn:int,role:int>>>"
)


def conversation_turns(rows: DataFrame) -> DataFrame:
    """The turns as this module takes them, with ``_conv``, a key that is never NULL."""
    given = only(rows, "conv_id", "turn", "role", "text")
    space = F.lit(" ")
    return given.select(
        F.col("conv_id").cast("bigint"),
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), space).alias("_conv"),
        F.col("turn").cast("bigint"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted damage, by crc32 of ``conv_id:turn``, modulo 20.

    0 drops the turn (it stays as a row with ``_gone``, so that its conversation is known), 1 empties
    its text, 2 takes out its full stops, question and exclamation marks, 3 repeats it, 4 makes it a user's.
    """
    space = F.lit(" ")
    place = F.concat_ws(
        ":",
        F.coalesce(F.col("conv_id").cast("string"), space),
        F.coalesce(F.col("turn").cast("string"), space),
    )
    kind = F.pmod(F.crc32(place.cast("binary")), F.lit(20)).cast("int")
    hit = turns.withColumn("_kind", kind)
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select(
        "conv_id",
        "_conv",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "")
        .when(F.col("_kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(copies).alias("_copy"),
        (F.col("_kind") == 0).alias("_gone"),
    )


def _letter(is_copy: Column) -> Column:
    """The letter of a turn: 4 * fault + class of the role's initial."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(end == "", E.BLANK)
        .when(is_copy, E.DUPLICATE)
        .when(reduce(lambda a, b: a | b, [end.endswith(c) for c in ".!?"]), E.SOUND)
        .otherwise(E.CUT)
    )
    initial = F.substring("role", 1, 1)
    role = F.lit(E.OTHER)
    for letter, number in E.CLASSES.items():
        role = F.when(initial == letter, number).otherwise(role)
    return F.chr((F.lit(ord(E.FIRST_LETTER)) + 4 * fault + role).cast("bigint"))


def _plans(letters: pa.Array) -> pa.Array:
    rows = []
    for given in letters.to_pylist():
        audit, turns, roles, _ = E.traced(given)
        rows.append(
            dict(zip(COUNTS, E.faults(given)))
            | {
                "cost": E.cheapest(given),
                "audit": audit,
                "steps": [{"turn": t, "role": r} for t, r in zip(turns, roles)],
            }
        )
    return pa.array(rows, PLAN)


def _gaps(least: Column, most: Column, different: Column) -> Column:
    wide = "decimal(38,0)"
    missing = most.cast(wide) - least.cast(wide) + 1 - different
    return F.coalesce(missing, F.lit(0).cast(wide)).try_cast("bigint")


def _line(role: Column, text: Column, made: Column) -> Column:
    """``role:text`` of an output; ``made`` is the role it was given, 0 as it was."""
    named = F.when(made == E.USER, "user").when(made == E.ASSISTANT, "assistant").otherwise(role)
    return F.concat(named, F.lit(":"), text)


def repaired(turns: DataFrame, floor: int = HOT_FLOOR) -> DataFrame:
    """One row per conversation: counts of faults, ``cost``, ``audit`` and the digest of its repaired turns.

    ``turns`` are rows of ``conversation_turns``, with ``_copy`` and ``_gone`` where ``damaged`` made
    them. Ordinary conversations also carry ``repaired``, the array of their repaired lines
    ``role:text``; for those with very many turns it is NULL, and ``repaired_lines`` has them as rows.
    """
    turns = _complete(turns)
    hot = hot_keys(turns, ["_conv"], floor)
    if hot is None:
        return _ordinary(turns)
    listed = F.broadcast(hot.select("_conv"))
    large = _Large(turns.join(listed, "_conv", "left_semi"))
    return _ordinary(turns.join(listed, "_conv", "left_anti")).unionByName(large.report())


def repaired_lines(turns: DataFrame, floor: int = HOT_FLOOR) -> DataFrame:
    """All repaired turns as rows: ``conv_id``, ``segment``, ``place`` in it, ``line``."""
    turns = _complete(turns)
    hot = hot_keys(turns, ["_conv"], floor)
    plain = turns if hot is None else turns.join(F.broadcast(hot.select("_conv")), "_conv", "left_anti")
    lines = _ordinary(plain).select(
        "conv_id", F.lit(0).alias("segment"), F.posexplode("repaired").alias("place", "line")
    )
    if hot is None:
        return lines
    large = _Large(turns.join(F.broadcast(hot.select("_conv")), "_conv", "left_semi"))
    return lines.unionByName(large.lines().select("conv_id", "segment", "place", "line"))


def _complete(turns: DataFrame) -> DataFrame:
    made = {"_copy": F.lit(0), "_gone": F.lit(False)}
    return turns.withColumns({c: v for c, v in made.items() if c not in turns.columns})


def _ordinary(turns: DataFrame) -> DataFrame:
    """Conversations that fit a task: one shuffle, and the texts stay in the JVM."""
    same = Window.partitionBy("_conv", "_gone", "role", "text").orderBy("turn", "_copy")
    plan = F.arrow_udf(_plans, PLAN_SQL)
    rows = (
        turns.repartition("_conv")
        .withColumn("_nth", F.row_number().over(same))
        .withColumn("_letter", _letter(F.col("_nth") > 1))
        # Rows alike in all but their letter are repeats: the first of them is the one before the others.
        .withColumn("_row", F.struct("turn", "role", "text", "_nth", "_letter"))
        .groupBy("_conv")
        .agg(
            F.first("conv_id").alias("conv_id"),
            F.sort_array(F.collect_list(F.when(~F.col("_gone"), F.col("_row")))).alias("_rows"),
        )
    )
    numbers = F.filter(F.transform("_rows", lambda r: r["turn"]), lambda n: n.isNotNull())
    planned = rows.select(
        "conv_id",
        "_rows",
        numbers.alias("_numbers"),
        plan(F.array_join(F.transform("_rows", lambda r: r["_letter"]), "")).alias("_plan"),
    )

    def line(step: Column) -> Column:
        row = F.get(F.col("_rows"), step["turn"])
        return _line(row["role"], F.coalesce(row["text"], F.lit("")), step["role"])

    lines = planned.withColumn("repaired", F.transform("_plan.steps", line))
    return lines.select(
        "conv_id",
        _gaps(
            F.array_min("_numbers"), F.array_max("_numbers"), F.size(F.array_distinct("_numbers"))
        ).alias("gaps"),
        *[F.col(f"_plan.{c}").alias(c) for c in [*COUNTS, "cost", "audit"]],
        F.sha2(F.concat_ws("\n", "repaired"), 256).alias("repaired_sha256"),
        "repaired",
    )


SEAMS = "struct<segment:int,vectors:array<int>,costs:array<bigint>,first:int,last:int>"


class _Large:
    """Conversations with very many turns, cut into segments that are written once."""

    def __init__(self, turns: DataFrame):
        self.ids = turns.select("_conv", "conv_id").distinct()
        kept = turns.filter(~F.col("_gone")).drop("_gone")
        # A number for each row, so that equal rows can be told apart and dealt to different segments.
        rows = segmented(
            kept.withColumn("_number", F.monotonically_increasing_id()), ["_conv", *ORDER, "_number"]
        ).withColumnRenamed("_seg", "segment")
        same = ["_conv", "_said"]
        rows = rows.withColumn(
            "_said", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
        )
        first = rows.groupBy(*same).agg(F.min(F.struct("turn", "_copy", "_number")).alias("_first"))
        within = Window.partitionBy("_conv", "segment").orderBy(*ORDER, "_number")
        lettered = rows.join(first, same).withColumn(
            "_letter", _letter(F.struct("turn", "_copy", "_number") > F.col("_first"))
        )
        lettered = lettered.withColumn("_at", F.row_number().over(within) - 1)
        self.rows = stored(lettered.select("_conv", "segment", "_at", "turn", "role", "text", "_letter"))
        letters = F.array_sort(F.collect_list(F.struct("_at", "_letter")))
        self.segments = stored(
            self.rows.groupBy("_conv", "segment").agg(
                F.array_join(F.transform(letters, lambda r: r["_letter"]), "").alias("letters")
            )
        )
        self.planned = self._planned()

    def _planned(self) -> DataFrame:
        """Segments with the vector after them, the state before them, their steps and audit."""

        def seams(letters: pa.Array) -> pa.Array:
            rows = []
            for given in letters.to_pylist():
                vectors, costs = E.through(given)
                codes = E.codes_of(given)
                rows.append((vectors.tolist(), costs.tolist(), int(codes[0] % 4), int(codes[-1] % 4)))
            names = ["vectors", "costs", "first", "last"]
            kind = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.int32()]
            return pa.array([dict(zip(names, r)) for r in rows], pa.struct(list(zip(names, kind))))

        def backward(found: pa.Array) -> pa.Array:
            rows = []
            for segments in found.to_pylist():
                vector, cost, after = 0, 0, []
                for s in reversed(segments):
                    after.append({"segment": s["segment"], "vector": vector})
                    cost += s["costs"][vector]
                    vector = s["vectors"][vector]
                broken = sum(
                    not E.legal(a["last"], b["first"]) for a, b in zip(segments, segments[1:])
                )
                rows.append(
                    {"cost": cost + E.edits().vectors[vector][E.EMPTY], "broken": broken, "after": after}
                )
            pairs = pa.list_(pa.struct([("segment", pa.int32()), ("vector", pa.int32())]))
            return pa.array(
                rows, pa.struct([("cost", pa.int64()), ("broken", pa.int64()), ("after", pairs)])
            )

        def ends(letters: pa.Array, vectors: pa.Array) -> pa.Array:
            pairs = zip(letters.to_pylist(), vectors.to_pylist())
            return pa.array([E.reached(g, v) for g, v in pairs], pa.list_(pa.int32()))

        def forward(found: pa.Array) -> pa.Array:
            rows = []
            for segments in found.to_pylist():
                state, before = E.EMPTY, []
                for n, s in enumerate(segments, 1):
                    before.append(
                        {"segment": s["segment"], "state": state, "closes": n == len(segments)}
                    )
                    state = s["ends"][state]
                rows.append(before)
            kind = [("segment", pa.int32()), ("state", pa.int32()), ("closes", pa.bool_())]
            return pa.array(rows, pa.list_(pa.struct(kind)))

        def plans(letters: pa.Array, vectors: pa.Array, states: pa.Array, closes: pa.Array) -> pa.Array:
            rows = []
            for given, vector, state, last in zip(
                letters.to_pylist(), vectors.to_pylist(), states.to_pylist(), closes.to_pylist()
            ):
                audit, turns, roles, _ = E.traced(given, vector, state, last)
                steps = [{"turn": t, "role": r} for t, r in zip(turns, roles)]
                rows.append(
                    dict(zip(COUNTS, E.faults(given))) | {"cost": 0, "audit": audit, "steps": steps}
                )
            return pa.array(rows, PLAN)

        key = ["_conv", "segment"]
        seam = F.arrow_udf(
            seams, "struct<vectors:array<int>,costs:array<bigint>,first:int,last:int>"
        )
        back = F.arrow_udf(
            backward, "struct<cost:bigint,broken:bigint,after:array<struct<segment:int,vector:int>>>"
        )
        end = F.arrow_udf(ends, "array<int>")
        ahead = F.arrow_udf(forward, "array<struct<segment:int,state:int,closes:boolean>>")
        plan = F.arrow_udf(plans, PLAN_SQL)
        summaries = self.segments.select(*key, seam("letters").alias("_seam")).select(
            "_conv", F.struct("segment", "_seam.*").cast(SEAMS).alias("_seam")
        )
        self.scanned = stored(
            summaries.groupBy("_conv")
            .agg(F.array_sort(F.collect_list("_seam")).alias("_seams"))
            .select("_conv", back("_seams").alias("_back"))
            .select("_conv", "_back.*")
        )
        after = self.scanned.select("_conv", F.inline("after"))
        known = stored(self.segments.join(after, key).withColumn("ends", end("letters", "vector")))
        before = (
            known.groupBy("_conv")
            .agg(F.array_sort(F.collect_list(F.struct("segment", "ends"))).alias("_ends"))
            .select("_conv", F.inline(ahead("_ends")))
        )
        return stored(
            known.join(before, key).select(
                *key, plan("letters", "vector", "state", "closes").alias("_plan")
            )
        )

    def lines(self) -> DataFrame:
        """Repaired lines as rows."""
        steps = self.planned.select(
            "_conv", "segment", F.posexplode("_plan.steps").alias("place", "_step")
        ).select("_conv", "segment", "place", F.col("_step.turn").alias("_at"), F.col("_step.role").alias("_made"))
        rows = self.rows.select("_conv", "segment", "_at", "role", "text")
        found = steps.join(rows, ["_conv", "segment", "_at"], "left")
        line = _line(F.col("role"), F.coalesce("text", F.lit("")), F.col("_made"))
        return found.select("_conv", "segment", "place", line.alias("line")).join(self.ids, "_conv")

    def report(self) -> DataFrame:
        per_turn = self.rows.groupBy("_conv", "turn").agg(F.count(F.lit(1)).alias("_n"))
        numbers = per_turn.groupBy("_conv").agg(
            _gaps(F.min("turn"), F.max("turn"), F.count("turn")).alias("gaps")
        )
        plans = self.planned.groupBy("_conv").agg(
            *[F.sum(f"_plan.{c}").alias(c) for c in COUNTS],
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("segment", "_plan.audit"))),
                    lambda p: p["audit"],
                ),
                "",
            ).alias("audit"),
        )
        ordered = (
            self.lines()
            .select("_conv", "segment", "place", "line")
            .repartition("_conv")
            .sortWithinPartitions("_conv", "segment", "place")
            .select("_conv", "line")
        )
        digests = ordered.mapInArrow(_digests, "_conv string, repaired_sha256 string")
        return (
            self.ids.join(numbers, "_conv", "left")
            .join(plans, "_conv", "left")
            .join(self.scanned.select("_conv", "cost", "broken"), "_conv", "left")
            .join(digests, "_conv", "left")
            .select(
                "conv_id",
                F.coalesce(F.col("gaps"), F.when(F.col("audit").isNull(), F.lit(0).cast("bigint"))).alias("gaps"),
                *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in COUNTS[:-1]],
                F.coalesce(F.col("illegal") + F.col("broken"), F.lit(0).cast("bigint")).alias("illegal"),
                F.coalesce("cost", F.lit(0).cast("bigint")).alias("cost"),
                F.coalesce("audit", F.lit("")).alias("audit"),
                F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
                F.lit(None).cast("array<string>").alias("repaired"),
            )
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each conversation's lines, which come in order, a batch at a time."""
    now, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"_conv": [now], "repaired_sha256": [digest.hexdigest()]})

    for batch in batches:
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest is None or conv != now:
                if digest is not None:
                    yield done()
                now, digest = conv, sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode("utf-8"))
    if digest is not None:
        yield done()


def repair_report(rows: DataFrame, floor: int = HOT_FLOOR) -> DataFrame:
    """Rows of ``conversations`` with planted damage, repaired: one row per conversation."""
    return repaired(damaged(conversation_turns(rows)), floor).drop("repaired")
