"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken target / size-of-source times. The whole part is
given to all; the fraction is rounded dependently: two documents at a time, mass (in words)
moves from one to the other in a random direction until one fraction is 0 or 1. The words
of the pair stay the same all the while, so a bucket of documents ends with one open
document at most and all others decided. The open ones are paired again, FAN buckets at a
time, up a reduction tree; the last one of a source is decided by a draw.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, quoted, tidy, unused

FAN = 32


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """sizes (source, size, n) with the source's number s and its target.

    Sources go by code point, null last, and get the weights in turn. Shares of the sum of all
    sizes go by weight; none is above `most` times its source's size, and the excess is shared
    again: a target is the lesser of that and weight * level. The level rises until the
    targets of the sources below their limits use up what is left; it, two sums and a count
    for each partition are all that the driver sees, however many sources there are.
    """
    spread = checkpointed(sizes.orderBy(F.col("source").asc_nulls_last()))  # ranges of sources in order
    spread = spread.withColumn("at", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("at").orderBy(F.col("source").asc_nulls_last())) - 1
    before, first = 0, []
    for r in spread.groupBy("at").count().orderBy("at").collect():
        first.append((r["at"], before))
        before += r["count"]
    starts = spread.sparkSession.createDataFrame(first, "at int, before long")
    turn = F.array(*(F.lit(float(w)) for w in weights))
    numbered = spread.withColumn("place", place).join(F.broadcast(starts), "at").withColumn("s", F.col("before") + F.col("place"))
    numbered = numbered.withColumn("weight", F.element_at(turn, (F.col("s") % len(weights) + 1).cast("int"))).drop("at", "before", "place")
    numbered = checkpointed(numbered)
    total, level = numbered.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], -1.0
    limit = F.col("size") * F.lit(float(most))
    while True:
        over = F.col("weight") * F.lit(level) > limit if level >= 0 else F.lit(False)
        capped, free = numbered.agg(F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        new = (total - capped) / free if free else level
        if new == level or not free:
            break
        level = max(new, level)
    return numbered.withColumn("target", F.least(limit, F.col("weight") * F.lit(level))).drop("weight")


def row_keys(*columns: Column) -> tuple[Column, Column]:
    """128 bits that tell rows apart."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(2), *reversed(columns))


def pivot(sizes: Sequence[int], parts: Sequence[float], rng: np.random.Generator) -> list[float]:
    """The parts after pivotal rounding: all but one are 0 or 1, the words in all the same."""
    parts, open_, draws = list(parts), -1, rng.random(len(sizes))
    for i, size in enumerate(sizes):
        if not 0 < parts[i] < 1:
            continue
        if open_ < 0:
            open_ = i
            continue
        a, b = sizes[open_], size
        up, down = min((1 - parts[open_]) * a, parts[i] * b), min(parts[open_] * a, (1 - parts[i]) * b)
        move = up if draws[i] * (up + down) < down else -down
        parts[open_] += move / a
        parts[i] -= move / b
        for j in (open_, i):
            if parts[j] < 1e-9 or parts[j] > 1 - 1e-9:
                parts[j] = float(parts[j] > 0.5)
        open_ = next((j for j in (open_, i) if 0 < parts[j] < 1), -1)
    return parts


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (1, 2, 3),
    most: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    bucket: int = 4096,
    broadcast_rows: int = 10_000,
) -> DataFrame:
    """One row per document: id, size (words), source_size, target, copies, taken, k1, k2.

    A source takes target / source_size copies of each document on average and its taken
    words meet its target but for one document. Null texts have size 0 and are taken 0 times,
    as are texts without words; a null source is a source, sorted last. Buckets and draws
    depend on the hash of id, source and text, so reruns agree however rows are dealt; rows
    that repeat all three are counted, not moved: their copies differ by one at most. An empty table gives no
    rows; other columns are ignored. There may be any number of sources; up to broadcast_rows
    of them are sent to all executors. k1 and k2 are 128 bits of id, source and text.
    """
    k1, k2 = row_keys(F.col(id_col), F.col(source_col), F.col(text_col))
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), k1.alias("k1"), k2.alias("k2")
    )
    sized = checkpointed(sized)
    by_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    plan = targets(by_source, weights, most).select(
        "s", F.col("source").alias("of"), F.col("size").alias("source_size"), "target", ratio.alias("ratio"), F.ceil(F.col("n") / bucket).cast("int").alias("buckets")
    )
    plan = checkpointed(plan)
    sources, most_buckets, letters = plan.agg(F.count("*"), F.max("buckets"), F.coalesce(F.sum(F.length("of")), F.lit(0))).first()
    if sources <= broadcast_rows and letters <= 1000 * broadcast_rows:
        plan = F.broadcast(plan)
    joined = sized.join(plan, sized["source"].eqNullSafe(plan["of"])).drop("of", "source")
    fraction = F.col("ratio") - F.floor("ratio")
    rows = joined.select(
        "id", "k1", "k2", "size", "s", F.floor("ratio").alias("whole"),
        F.when((F.col("size") == 0) | (fraction < 1e-9), 0.0).when(fraction > 1 - 1e-9, 1.0).otherwise(fraction).alias("part"),
        F.pmod(F.xxhash64("k1", F.lit(seed)), "buckets").cast("int").alias("b"), "source_size", "target",
    )
    # rows that repeat are one with a count: all but one of them take whole copies, so that a single one is open
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    mass = F.col("n") * F.col("part")
    rows = rows.withColumn("more", F.floor(mass + 1e-9)).withColumn("part", F.greatest(F.lit(0.0), mass - F.floor(mass + 1e-9)))
    rows = rows.withColumn("part", F.when(F.col("part") < 1e-9, 0.0).otherwise(F.col("part")))
    kind = rows.schema

    def settle(keys: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("k1", "ascending"), ("k2", "ascending")])
        rng = np.random.default_rng([seed, *(abs(k.as_py()) for k in keys), t.num_rows])
        parts = pivot(t["size"].to_pylist(), t["part"].to_pylist(), rng)
        out = t.set_column(t.column_names.index("part"), "part", pa.array(parts, pa.float64()))
        tidy()
        return out

    done = checkpointed(rows.groupBy("s", "b").applyInArrow(settle, kind))
    is_open = (F.col("part") > 0) & (F.col("part") < 1)
    decided, open_ = [done.where(~is_open)], done.where(is_open)
    levels = most_buckets or 1
    while levels > 1:
        levels = math.ceil(levels / FAN)
        met = open_.withColumn("b", (F.col("b") / FAN).cast("int")).groupBy("s", "b").applyInArrow(settle, kind)
        if levels > 1:
            met = checkpointed(met)
        decided.append(met.where(~is_open))
        open_ = met.where(is_open)
    draw = F.pmod(F.xxhash64("k1", "k2", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    decided.append(open_.withColumn("part", (draw < F.col("part")).cast("double")))
    every = decided[0]
    for more in decided[1:]:
        every = every.unionByName(more)
    each = repeated(every, "n", "turn")
    extra = F.when(F.col("turn") <= F.col("more"), 1).when(F.col("turn") == F.col("more") + 1, F.col("part").cast("long")).otherwise(0)
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole") + extra).cast("long")
    return each.select(
        F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "k1", "k2"
    )


def repeated(rows: DataFrame, times: str, turn: str, many: int = 1000) -> DataFrame:
    """Each row as often as its column `times` says, numbered from 1; one with more than `many` by
    several tasks."""
    numbers = lambda a, b: F.explode(F.sequence(a, b))
    few = rows.where((F.col(times) > 0) & (F.col(times) <= many))
    few = few.withColumn(turn, numbers(F.lit(1).cast("long"), F.col(times)))
    lots = rows.where(F.col(times) > many).withColumn(turn, numbers(F.lit(0).cast("long"), F.ceil(F.col(times) / many) - 1))
    lots = lots.repartition(F.xxhash64(turn)).withColumn(turn, numbers(F.col(turn) * many + 1, F.least(F.col(times), (F.col(turn) + 1) * many)))
    return few.unionByName(lots)


def mixed(docs: DataFrame, *, many: int = 1000, **options) -> DataFrame:
    """docs with each row as often as mix_sources() takes it; the rows that repeat id, source and
    text come as often as all of them are taken, in the shape of one of them. A row that is
    taken more than `many` times is copied by several tasks."""
    id_, source, text = (options.get(f"{c}_col", d) for c, d in (("id", "doc_id"), ("source", "source"), ("text", "text")))
    plan = mix_sources(docs, **options).groupBy("k1", "k2").agg(F.sum("copies").alias("copies")).where("copies > 0")
    a, b, times, turn = (unused(n, [*docs.columns, "k1", "k2", "copies"]) for n in ("key", "other", "times", "turn"))
    keyed = docs.withColumns(dict(zip((a, b), row_keys(F.col(id_), F.col(source), F.col(text)), strict=True))).dropDuplicates([a, b])
    plan = plan.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("copies").alias(times))
    planned = checkpointed(keyed.join(plan, [a, b]).select(*map(quoted, docs.columns), times))
    return repeated(planned, times, turn, many).select(*map(quoted, docs.columns))
