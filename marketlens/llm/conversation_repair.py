"""Repair of conversations at the least cost, by dynamic programming with checkpoints.

A repaired conversation has roles whose initials read `(s?(ua)+)?`. Four states describe how far that pattern has come; a
row is kept, given the role that comes next, or deleted, and a missing turn can be inserted before it. Costs
are found backwards, edits forwards. Only the vectors of four costs at checkpoints are stored: every
`BLOCK` rows between tasks, every square root of a block inside one. The walk computes the vectors between two checkpoints again and takes, among the
edits that cost no more than the vector says, the one whose initial comes first.

A conversation is never gathered in one task for this. Its rows are cut into blocks. Each block gives the cheapest costs from
each state to each state, four by four numbers; those are combined backwards, one small row a block, into the vector at each checkpoint; then all blocks
are walked at once from each state that they may be entered in, and a chain over the blocks picks the walk that applies. Two things have one cell per
conversation by contract and are put together in order from pieces: the audit string, and the SHA-256, which reads its text one piece after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.texts import small_batches
from marketlens.operators.ordered import numbered
from marketlens.sources.scratch import staged

#: Rows of a block. Blocks lie on a grid over all rows, so that a row's block follows from its number alone.
BLOCK = 4096
#: Characters of repaired text that travel as one piece.
PIECE = 1 << 20
RETURNED = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SPACE = "[\\x20\\x09-\\x0D]"

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
_FAR = 1 << 60
#: States: nothing yet, after s, after u, after a. The state that u or a leads to; and what each initial leads to, if it fits.
_NEXT = (2, 2, 3, 2)
_FITS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ROLES = {2: "user", 3: "assistant"}
#: Costs when no row is left.
END = (0, 6, 3, 0)
UNITS = tuple(tuple(0 if s == t else _FAR for s in range(4)) for t in range(4))
#: A row as one character: its initial (x: none of the three), in upper case where it must be deleted; digits stand for a row that is cut off.
_CUT = {"0": "s", "1": "u", "2": "a", "3": "x"}

Costs = tuple[int, int, int, int]


@lru_cache(maxsize=1 << 16)
def step(after: Costs, row: str) -> tuple[Costs, int, tuple[tuple[str, int], ...]]:
    """Costs before a row from those after it, less their least; that least; and for each state its edits and the state after them."""
    more, initial = (CUT, _CUT[row]) if row in _CUT else (0, row.lower())
    options: list[list[tuple[int, str, int]]] = []
    for s in range(4):
        here = [(DELETE + after[s], "D", s)]
        if not row.isupper():
            if initial in _FITS[s]:
                here.append((KEEP + more + after[_FITS[s][initial]], "K", _FITS[s][initial]))
            here.append((REROLE + more + after[_NEXT[s]], "R", _NEXT[s]))
        options.append(here)
    base = [min(o)[0] for o in options]
    cost = list(base)
    for s in (2, 3, 0, 1):
        cost[s] = min(base[s], INSERT + (base[5 - s] if s > 1 else cost[2]))
    edits = []
    for s in range(4):
        at, done = s, ""
        while True:
            tight = [(e, t) for c, e, t in options[at] if c == cost[at]]
            if cost[at] == INSERT + cost[_NEXT[at]]:
                tight.append(("I", -1))
            # A state from which the end cannot be reached has no edits that matter.
            edit, to = min(tight)
            done += edit
            if edit != "I":
                edits.append((done, to))
                break
            at = _NEXT[at]
            if len(done) > 4:
                edits.append(("", s))
                break
    least = min(cost)
    return tuple(min(c - least, _FAR) if c < _FAR else _FAR for c in cost), least, tuple(edits)


def costs_before(rows: str, after: Costs) -> Costs:
    """Costs before some rows from those after them."""
    total = 0
    for row in reversed(rows):
        after, least, _ = step(after, row)
        total += least
    return tuple(c + total if c < _FAR else _FAR for c in after)


def combined(block: list[int], after: Costs) -> Costs:
    """Costs before a block from its 16 costs (to each state, then from each) and the costs after it."""
    return tuple(min(min(block[4 * t + s] + after[t], _FAR) for t in range(4)) for s in range(4))


def walks(rows: str, after: Costs, states: list[int]) -> list[tuple[str, int]]:
    """For each state before the rows: the ASCII-least cheapest edits, and the state after them."""
    least = min(after)
    after = tuple(c - least for c in after)
    width = max(1, isqrt(len(rows)))
    cuts = list(range(0, len(rows), width))
    checkpoints = [after]
    for a in reversed(cuts[1:]):
        for row in reversed(rows[a : a + width]):
            after = step(after, row)[0]
        checkpoints.append(after)
    now, done = list(states), [[] for _ in states]
    for a in cuts:
        after, edits = checkpoints.pop(), []
        for row in reversed(rows[a : a + width]):
            after, _, e = step(after, row)
            edits.append(e)
        for e in reversed(edits):
            for k, s in enumerate(now):
                done[k].append(e[s][0])
                now[k] = e[s][1]
    return [("".join(d), s) for d, s in zip(done, now)]


def closing(state: int) -> str:
    """Insertions after the last row."""
    return "I" * (END[state] // INSERT)


def illegal_pairs(initials: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))


# In Spark: rows, blocks, chains, texts.


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the crc32 of `conv_id:turn` names; a null counts as one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hurt = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role"))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _faults(rows: DataFrame) -> DataFrame:
    """Each row, without its text, as a character; with its initial and first fault."""
    body = F.regexp_replace("text", f"{SPACE}+$", "")
    blank, cut = body == "", ~F.substring(body, -1, 1).isin(".", "!", "?")
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("x"))
    thin = rows.select("conv_id", "block", "at", "mark", initial.alias("initial"), blank.alias("blank"), cut.alias("cut"))
    # Repeats are found by a fixed-width mark of conversation, role and text, summed up before the shuffle.
    firsts = thin.groupBy("mark").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    seen = thin.join(firsts, "mark", "left").withColumn("seen", F.coalesce(F.col("at") > F.col("first"), F.lit(False)))
    fault = F.when(F.col("blank"), F.lit("b")).when(F.col("seen"), F.lit("d")).when(F.col("cut"), F.lit("t")).otherwise(F.lit("-"))
    return seen.select("conv_id", "block", "at", "initial", fault.alias("fault"))


def _in_order(df: DataFrame, keys: list[str], order: list[str | Column], run, schema) -> DataFrame:
    """`run` over each task's rows, which hold all rows of a key in order."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _records(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def _out(records: Iterator[tuple], schema: pa.Schema, rows: int = 2000, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Records as batches of bounded rows and characters."""
    held, weight = [], 0
    for r in records:
        held.append(r)
        weight += sum(len(x) for x in r if isinstance(x, str))
        if len(held) == rows or weight > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _fields(df: DataFrame, key: str, spec: str) -> T.StructType:
    return T.StructType([df.schema[key], *T._parse_datatype_string(spec).fields])


_UPPER = {("b", i): i.upper() for i in "suax"} | {("d", i): i.upper() for i in "suax"}
_AS_CHARACTER = _UPPER | {("t", i): d for d, i in _CUT.items()} | {("-", i): i for i in "suax"}


def _blocks(faults: DataFrame) -> DataFrame:
    """One row per conversation and block: the rows as characters, counts of faults, and the 16 costs through it."""
    schema = _fields(faults, "conv_id", "block long, codes string, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>")
    shape = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for (conv, block), group in groupby(_records(batches, ["conv_id", "block", "initial", "fault"]), key=lambda r: r[:2]):
                initials, faults = map("".join, zip(*[r[2:] for r in group]))
                codes = "".join(_AS_CHARACTER[f, i] for f, i in zip(faults, initials))
                costs = [c for unit in UNITS for c in costs_before(codes, unit)]
                counts = [faults.count(f) for f in "bdt"]
                yield (conv, block, codes, *counts, illegal_pairs(initials), initials[0], initials[-1], costs)

        yield from _out(made(), shape)

    return _in_order(faults, ["conv_id", "block"], ["at"], run, schema)


def _checkpoints(blocks: DataFrame) -> DataFrame:
    """Each block with the costs after it, those before it, and whether it is the last: one pass over small rows, backwards."""
    schema = T.StructType([*blocks.schema, T.StructField("after", T.ArrayType(T.LongType())), T.StructField("total", T.LongType()), T.StructField("closes", T.BooleanType())])
    shape, names = _arrow(schema), blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            conv, after = object(), END
            for r in _records(batches, names):
                closes = conv != r[0]
                if closes:
                    conv, after = r[0], END
                before = combined(r[-1], after)
                # Insertions before the block's first row are in its own costs already.
                yield (*r, list(after), before[0], closes)
                after = before

        yield from _out(made(), shape)

    return _in_order(blocks, ["conv_id"], [F.desc("block")], run, schema)


def _walked(checkpoints: DataFrame) -> DataFrame:
    """Each block with its edits from every state that it may be entered in, and the states after them."""
    added = [T.StructField("edits", T.ArrayType(T.StringType())), T.StructField("exits", T.ArrayType(T.LongType()))]
    kept = [f for f in checkpoints.schema if f.name not in ("costs", "after")]
    schema = T.StructType([*kept, *added])
    shape, names = _arrow(schema), [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for *r, after in _records(batches, [*names, "after"]):
                found = walks(r[names.index("codes")], tuple(after), [0, 1, 2, 3])
                yield (*r, [e for e, _ in found], [s for _, s in found])

        yield from _out(made(), shape)

    return checkpoints.mapInArrow(run, schema)


def _chained(walked: DataFrame) -> DataFrame:
    """Rows of two kinds. Of a block: its number, state at entry, edits, and whether it is the whole conversation.
    Of a conversation (block -1): its counts, its cost and its whole audit."""
    schema = _fields(walked, "conv_id", "block long, state long, whole boolean, audit string, blank long, duplicate long, truncated long, illegal long, cost long")
    shape, names = _arrow(schema), ["block", "closes", "edits", "exits", "first", "last", "total", "blank", "duplicate", "truncated", "illegal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for conv, group in groupby(_records(batches, ["conv_id", *names]), key=lambda r: r[0]):
                state, audit, counts, cost, before = 0, [], [0] * 4, None, ""
                for _, block, closes, edits, exits, first, last, total, *more in group:
                    cost = total if cost is None else cost
                    entry, piece, state = state, edits[state], exits[state]
                    if closes:
                        piece += closing(state)
                    counts = [a + b for a, b in zip(counts, more)]
                    counts[3] += illegal_pairs(before + first)
                    yield (conv, block, entry, closes and not audit, piece, None, None, None, None, None)
                    audit.append(piece)
                    before = last
                yield (conv, -1, None, None, "".join(audit), *counts, cost)

        yield from _out(made(), shape)

    return _in_order(walked, ["conv_id"], ["block"], run, schema)


def repaired_lines(edits: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """`role:text` of each row that is left, from the edits of a run of rows."""
    for edit in edits:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        state = _FITS[state][role[0]] if edit == "K" else _NEXT[state]
        yield f"{role if edit == 'K' else _ROLES[state]}:{text}"


def _digests(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the repaired text. Blocks are repaired on their own; the pieces of
    a conversation of several blocks are read in order, one at a time."""
    edits = decided.where("block >= 0").select("conv_id", "block", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), "state", "whole")
    texts = rows.select("conv_id", "block", "at", "role", "text", F.lit(None).cast("long").alias("state"), F.lit(None).cast("boolean").alias("whole"))
    schema = _fields(rows, "conv_id", "block long, place long, piece string, sha256 string")
    shape = _arrow(schema)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for (conv, block), group in groupby(_records(batches, ["conv_id", "block", "role", "text", "state", "whole"]), key=lambda r: r[:2]):
                _, _, _, audit, state, whole = next(group)
                digest, place, held, weight = hashlib.sha256(), 0, [], 0
                for k, line in enumerate(repaired_lines(audit, state, ((r[2], r[3]) for r in group))):
                    if whole:
                        digest.update((("\n" if k else "") + line).encode())
                        continue
                    held.append(line)
                    weight += len(line)
                    if weight > PIECE:
                        yield (conv, block, place, "\n".join(held), None)
                        place, held, weight = place + 1, [], 0
                if whole:
                    yield (conv, block, 0, None, digest.hexdigest())
                elif held:
                    yield (conv, block, place, "\n".join(held), None)

        yield from _out(made(), shape)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for conv, group in groupby(_records(batches, ["conv_id", "piece"]), key=lambda r: r[0]):
                digest = hashlib.sha256()
                for k, (_, piece) in enumerate(group):
                    digest.update((("\n" if k else "") + piece).encode())
                yield (conv, digest.hexdigest())

        yield from _out(made(), _arrow(ends))

    pieces = staged(_in_order(texts.unionByName(edits), ["conv_id", "block"], ["at"], repair, schema), "repair-pieces")
    ends = T.StructType([rows.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    joined = _in_order(pieces.where("sha256 IS NULL").drop("sha256"), ["conv_id"], ["block", "place"], join, ends)
    return pieces.where("sha256 IS NOT NULL").select("conv_id", F.col("sha256").alias("repaired_sha256")).unionByName(joined)


def repair(conversations: DataFrame, damage: bool = True, block: int = BLOCK) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Reads conv_id, turn, role and text; other columns are left out. A null role or text counts as one space; a null conv_id is a
    conversation of its own; rows with a null turn come first and do not count for gaps. Rows of one turn come
    in the order of a digest of role and text, so that copies are adjacent. An initial is the first character of a role, in its case; a role without one, or with another than s, u
    or a, cannot be kept. A conversation all of whose rows were dropped has zeros, an empty audit and the SHA-256 of nothing, as
    has one all of whose rows are deleted. An empty table gives an empty result. With `damage=False` the rows are repaired as they are.
    """
    given = conversations.select("conv_id", "turn", "role", "text")
    small_batches(given)
    hurt = damaged(given) if damage else given.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    parts = F.concat_ws(":", F.length(key), F.length("role"), key, F.col("role"), F.col("text"))
    marked = hurt.withColumn("mark", F.unhex(F.sha2(parts.cast("binary"), 256)))
    ordered = numbered(marked, [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "mark"], "at", "repair-rows")
    rows = ordered.withColumn("block", F.floor(F.col("at") / block))
    gaps = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    decided = staged(_chained(_walked(_checkpoints(_blocks(_faults(rows))))), "repair-edits")
    counts = decided.where("block = -1").select("conv_id", "audit", "blank", "duplicate", "truncated", "illegal", "cost")
    none = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    out = given.select("conv_id").distinct()
    for part in (gaps, counts, _digests(rows, decided)):
        part = part.withColumnRenamed("conv_id", "_conv")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return out.select("conv_id", *[F.coalesce(c, F.lit(none[c])).alias(c) for c in RETURNED])
