"""A mix of sources at target weights, by pivotal rounding in a tree of bounded nodes. DataFrame functions only.

A document's expected number of copies is its source's target over its source's size. The whole part is
taken as it is. The fraction is rounded by the pivotal method, weighted by size: two documents meet, words move at random from one
to the other until one of them has none or all of its words, and the other one carries what is
left on. So every source's words add up to its target but for the last document of its tree.
Each node reduces about `FAN` documents of a source and a step of size (half a power of two) to one; the nodes of a level run apart from each other.
The last node of a source takes what is left of each step, and a few documents that were kept back, from large to small: a
large document then settles early, and the last one, whose rounding is the source's error, tends to be small. That bounded node is drawn `DRAWS` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.sources.scratch import staged

FAN = 32
#: Documents of each size step and source (about so many) that are kept for the last node.
KEPT_BACK = 8
#: Times the last node is drawn; the draw whose rounding comes nearest to the target is kept.
DRAWS = 16
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _uniform(*keys: Column) -> Column:
    """0 to below 1, the same at every run."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def weighted(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """Give each source the weight at its place by code point, null last. Ranked per range of sources, not in one task."""
    ranged = sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "mix-sources")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", before)  # a row for each range
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1 + F.col("before")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return ranged.join(parts.select("part", "before"), "part").withColumn("weight", F.get(weights, F.pmod(place, F.lit(len(cycle))).cast("int"))).drop("part", "before")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add `target`: the weighted share of `share` times all words, at most `most` times the source's own, the excess dealt again by weight."""
    cap, weight = F.col("source_size") * most, F.col("weight")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # every round caps one more source at least; two numbers come back from each
        full = (F.lit(level) * weight >= cap) if capped >= 0 else F.lit(False)
        r = sources.agg(F.sum(F.when(full, cap)).alias("cap"), F.sum(F.when(~full, weight)).alias("weight"), F.count(F.when(full, 1)).alias("n")).first()
        if r["weight"] is None or r["n"] == capped:
            break
        level, capped = (total - (r["cap"] or 0.0)) / r["weight"], r["n"]
    return sources.withColumn("target", F.least(F.lit(level) * weight, cap))


def _reduced(items: Column, *keys: Column) -> Column:
    """Fold a node's documents to one: (carry, settled)."""
    settle = lambda x, up: F.array(F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["rows"].alias("rows"), F.lit(up).alias("up")))
    hold = lambda x, words: F.struct(x["order"].alias("order"), x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["rows"].alias("rows"), x["words"].alias("words"), words.alias("part"))

    def meet(acc: Column, x: Column) -> Column:
        c, done = acc["carry"], acc["settled"]
        room_x, room_c = x["words"] - x["part"], c["words"] - c["part"]
        down, up = F.least(c["part"], room_x), F.least(room_c, x["part"])
        to_x = _uniform(*keys, c["h"], x["h"]) * (down + up) < up
        out = lambda carry, settled: F.struct(carry.alias("carry"), F.concat(done, settled).alias("settled"))
        return (
            F.when(to_x & (c["part"] <= room_x), out(hold(x, x["part"] + c["part"]), settle(c, False)))
            .when(to_x, out(hold(c, c["part"] - room_x), settle(x, True)))
            .when(x["part"] <= room_c, out(hold(c, c["part"] + x["part"]), settle(x, False)))
            .otherwise(out(hold(x, x["part"] - room_c), settle(c, True)))
        )

    first = F.get(items, 0)
    none = F.slice(settle(first, False), 1, 0)
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), F.struct(hold(first, first["part"]).alias("carry"), none.alias("settled")), meet)


def plan(docs: DataFrame, cycle=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, text: str = "text") -> DataFrame:
    """How often each document is taken: doc_id, source, size, rows, source_size, target, copies.

    `docs` has doc_id, source and the text. Rows that agree in doc_id, source and size are one unit with `rows` rows and
    share their number of copies. Null ids and sources are values like others. Documents without
    words never count towards a target and get the whole part and a rounding of their own. An
    empty table gives an empty plan. Reruns give the same plan.
    """
    slim = docs.select("doc_id", "source", word_count(F.col(text)).alias("size"))
    units = staged(slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix-units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    sources = staged(targets(weighted(sources, cycle), share, most), "mix-targets")

    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    known = sources.select(F.col("source").alias("of"), "source_size", "target", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("fraction"))
    full = units.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    words = (F.col("size") * F.col("rows")).cast("double")
    hashed = F.xxhash64(F.lit(seed), "doc_id", "source", "size")
    step = F.floor(F.log2(F.greatest(words, F.lit(1.0))) * 2).cast("int")
    full = staged(full.withColumns({"h": hashed, "step": step}), "mix-full")

    alone = (F.col("fraction") == 0) | (F.col("size") == 0)
    small = full.where(alone).select("doc_id", "source", "size", "rows", (_uniform(F.lit(seed), F.col("h")) < F.col("fraction")).alias("up"))
    item = F.struct((-words).alias("order"), "h", "doc_id", "size", "rows", words.alias("words"), (F.col("fraction") * words).alias("part"))
    pool = full.where(~alone).select("source", "step", "h", item.alias("item"))
    steps = pool.groupBy(F.col("source").alias("of"), F.col("step").alias("at")).agg(F.count("*").alias("n"))
    pool = pool.join(steps, F.col("source").eqNullSafe(F.col("of")) & (F.col("step") == F.col("at"))).drop("of", "at")
    late = F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.col("n")) < KEPT_BACK
    nodes = F.ceil(F.col("n") / FAN)
    pool = staged(pool.select("source", "step", "item", late.alias("late"), F.pmod(F.xxhash64(F.lit(seed + 2), "h"), nodes).alias("node"), nodes.alias("nodes")), "mix-pool")
    count = pool.agg(F.max("nodes")).first()[0] or 0
    level_rows = pool.where(~F.col("late")).select("source", "step", "node", "item")
    settled, level = [small], 0
    while True:
        groups = level_rows.groupBy("source", "step", "node").agg(F.sort_array(F.collect_list("item")).alias("items"))
        groups = staged(groups.select("source", "step", "node", _reduced(F.col("items"), F.lit(seed), F.lit(level)).alias("out")), f"mix-level{level}")
        settled.append(_settled(groups))
        if count <= 1:
            break
        level_rows = groups.select("source", "step", F.floor(F.col("node") / FAN).alias("node"), F.col("out.carry").alias("item"))
        count, level = -(-count // FAN), level + 1
    # One document for each step and about KEPT_BACK more, whatever the source's size: large ones first.
    rest = groups.select("source", F.col("out.carry").alias("item")).unionByName(pool.where("late").select("source", "item"))
    groups = rest.groupBy("source").agg(F.sort_array(F.collect_list("item")).alias("items"))
    draws = groups.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(DRAWS))))
    last, full_copy = F.col("out.carry"), _uniform(F.lit(seed + 3), F.col("draw"), F.col("out.carry.h")) * F.col("out.carry.words") < F.col("out.carry.part")
    draws = staged(draws.select("source", "draw", _reduced(F.col("items"), F.lit(seed), F.lit(-1), F.col("draw")).alias("out")), "mix-last")
    error = F.when(full_copy, last["words"] - last["part"]).otherwise(last["part"])
    best = draws.groupBy("source").agg(F.min_by(F.struct("out", full_copy.alias("up")), F.struct(error, "draw")).alias("best")).select("source", "best.out", "best.up")
    settled.append(_settled(best))
    settled.append(best.select(last["doc_id"].alias("doc_id"), "source", last["size"].alias("size"), last["rows"].alias("rows"), "up"))
    rounded = settled[0]
    for more in settled[1:]:
        rounded = rounded.unionByName(more)
    rounded = rounded.join(known, F.col("source").eqNullSafe(F.col("of")))
    return rounded.select("doc_id", "source", "size", "rows", "source_size", "target", (F.col("whole") + F.col("up").cast("int")).cast("long").alias("copies"))


def _settled(groups: DataFrame) -> DataFrame:
    return groups.select("source", F.explode("out.settled").alias("s")).select("s.doc_id", "source", "s.size", "s.rows", "s.up")


def taken(planned: DataFrame) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    each = planned.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mixed corpus: every row of `docs` as often as the plan takes it, columns unchanged."""
    planned = staged(plan(docs, text=text, **options), "mix-plan").where("copies > 0")
    slim = planned.select(F.col("doc_id").alias("llm_id"), F.col("source").alias("llm_source"), F.col("size").alias("llm_size"), F.col("copies").alias("llm_copies"))
    same = F.col("doc_id").eqNullSafe(F.col("llm_id")) & F.col("source").eqNullSafe(F.col("llm_source")) & (F.col("llm_words") == F.col("llm_size"))
    rows = docs.withColumn("llm_words", word_count(F.col(text))).join(slim, same)
    return rows.withColumn("llm_copy", F.explode(F.sequence(F.lit(1), F.col("llm_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
