"""Method resolution order of types with mixins, and calls bound along it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, released, stored

#: Where a type's parts stand in its order: prepended mixins, the last one first, itself, included
#: ones, the last one first, and what its parent has.
SIDES = {"prepend": (-1, -1), "include": (1, -1), "inherit": (2, 1)}


def linearised(types: DataFrame, parts: DataFrame) -> DataFrame:
    """type, at, pos: the order (from 1) in which a type's ancestors are asked, itself among them.

    types: type. parts: type, kind (prepend, include, inherit), ord, of. An ancestor that is reached in
    several ways stands where it is reached last, as its mixin is taken over from what comes
    later. A part that isn't among the types stands for itself. Types on a circle, and those that
    need them, have no order. Each round takes the types whose parts are all done, so orders are
    merged from orders, each ancestor once, however many ways lead to it.
    """
    own = types.where("type is not null").select("type").distinct()
    side, turn = (F.coalesce(*(F.when(F.col("kind") == k, v[i]) for k, v in SIDES.items())) for i in (0, 1))
    links = parts.where("type is not null and of is not null").select("type", "of", side.alias("side"), (F.col("ord") * turn).alias("turn")).where("side is not null").distinct()
    links = stored(links.join(own, "type", "left_semi"))
    leaves = links.select("of").distinct().join(own, F.col("of") == F.col("type"), "left_anti").select(F.col("of").alias("type"))
    first = own.join(links, "type", "left_anti").union(leaves).distinct()
    # Each round's orders are written once. What is kept at hand for the next rounds are the orders that
    # waiting types ask for, so that a round costs what is still open, not all that is done.
    found = [stored(first.select("type", F.col("type").alias("at"), F.lit(1).alias("pos")))]
    waiting = stored(own.join(links, "type", "left_semi"))
    asked = lambda df: df.join(links.select(F.col("of").alias("type")).distinct(), "type", "left_semi")
    at_hand = stored(asked(found[0]))
    while True:
        # a part is either done or waits itself
        held = links.join(waiting.select(F.col("type").alias("of")), "of", "left_semi").select("type").distinct()
        ready = stored(waiting.join(held, "type", "left_anti"))
        if ready.isEmpty():
            break
        above = links.join(ready, "type", "left_semi").join(at_hand.select(F.col("type").alias("of"), "at", "pos"), "of").select("type", "at", F.struct("side", "turn", "pos").alias("place"))
        self_ = ready.select("type", F.col("type").alias("at"), F.struct(F.lit(0).alias("side"), F.lit(0).cast(dict(links.dtypes)["turn"]).alias("turn"), F.lit(0).alias("pos")).alias("place"))
        last = above.union(self_).groupBy("type", "at").agg(F.max("place").alias("place"))
        found.append(stored(last.select("type", "at", F.row_number().over(Window.partitionBy("type").orderBy("place")).alias("pos"))))
        left = stored(waiting.join(ready, "type", "left_anti"))
        before, links = (links, waiting, ready, at_hand), stored(links.join(left, "type", "left_semi"))
        waiting, at_hand = left, stored(asked(at_hand.union(found[-1])))
        for old in before:
            dropped(old)
        released(at_hand)
    for old in (ready, links, waiting, at_hand):
        dropped(old)
    return reduce(DataFrame.union, (x.select("type", "at", "pos") for x in found))


def bound_calls(calls: DataFrame, order: DataFrame, types: DataFrame, methods: DataFrame) -> DataFrame:
    """src, type, name, after, owner, dst, state: calls (src, type, name, after) of a receiver's type bound
    to the first ancestor that has the method; after (a type, or null) starts behind that ancestor,
    as `super` does.

    state: `bound`; `barrier` where an ancestor that isn't among the types comes before, so that the
    method may be its own; `ambiguous` where the owner has it twice; `none`. Only bound ones have a dst.
    """
    asked = calls.select("src", "type", "name", "after").distinct()
    chain = order.join(types.select(F.col("type").alias("at")).distinct().withColumn("known", F.lit(True)), "at", "left")
    own = methods.groupBy(F.col("owner").alias("at"), "name").agg(F.min("id").alias("dst"), F.count_distinct("id").alias("n"))
    start = order.select("type", F.col("at").alias("after"), F.col("pos").alias("behind"))
    asked = asked.join(start, ["type", "after"], "left").withColumn("behind", F.coalesce("behind", F.lit(0))).where("after is null or behind > 0")
    # along the chain first: a name may be a method of any number of types
    hits = asked.join(order, "type").where("pos > behind").join(own, ["at", "name"])
    first = hits.groupBy("src", "type", "name", "behind").agg(F.min_by(F.struct("pos", "at", "dst", "n"), "pos").alias("hit"))
    walls = chain.where("known is null").select("type", F.col("pos").alias("wall"))
    key = ["src", "type", "name", "behind"]
    out = asked.join(first, key, "left")
    wall = out.select(*key, F.coalesce("hit.pos", F.lit(2**31 - 1)).alias("most")).join(walls, "type").where("wall > behind and wall < most").select(*key).distinct().withColumn("walled", F.lit(True))
    out = out.join(wall, key, "left")
    state = F.when(F.col("walled"), "barrier").when(F.col("hit").isNull(), "none").when(F.col("hit.n") > 1, "ambiguous").otherwise("bound")
    good = lambda c: F.when(state == "bound", F.col(c))
    return out.select("src", "type", "name", "after", good("hit.at").alias("owner"), good("hit.dst").alias("dst"), state.alias("state"))
