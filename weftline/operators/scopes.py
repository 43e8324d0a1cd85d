"""Names to symbols across modules: exports by a fixpoint, uses by tiers of scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, dropped, released, stored


def exports(declares: DataFrame, passed: DataFrame) -> DataFrame:
    """module, name, symbol: what other modules can import from a module.

    declares: module, name, symbol. passed: module, name, of, of_name: the module passes on of_name
    of module `of` as name, or all names of it where name is null. Names that a module declares or
    passes on itself hide those of its wildcards; `default` is never passed on by them.

    The rounds are semi-naive: each joins what the last one found with `passed`, by module and
    name, and keeps what is new. Modules that pass on each other in a circle end it as
    soon as nothing is new. Null modules and symbols are left out; rows that repeat count once.
    """
    base = declares.where("module is not null and name is not null and symbol is not null").select("module", "name", "symbol").distinct()
    named = passed.where("name is not null and of_name is not null").select("module", F.col("name").alias("as"), F.col("of"), "of_name").distinct()
    wild = passed.where("name is null").select("module", "of").distinct()
    hidden = base.select("module", "name").union(named.select("module", "as")).distinct()
    named, wild, hidden = (stored(x) for x in (named, wild, hidden))
    deltas = [stored(base)]
    while True:
        new = deltas[-1].select(F.col("module").alias("of"), F.col("name").alias("of_name"), "symbol")
        direct = new.join(named, ["of", "of_name"]).select("module", F.col("as").alias("name"), "symbol")
        through = new.where("of_name <> 'default'").join(wild, "of").select("module", F.col("of_name").alias("name"), "symbol")
        found = direct.union(through.join(hidden, ["module", "name"], "left_anti")).distinct()
        for d in deltas:
            found = found.join(d, ["module", "name", "symbol"], "left_anti")
        found = stored(found)
        if found.isEmpty():
            dropped(found)
            break
        deltas.append(found)
        if len(deltas) > 8:  # few tables to look at again, however deep the chains are
            merged = stored(reduce(DataFrame.unionByName, deltas[:-1]))
            for d in deltas[:-1]:
                dropped(d)
            deltas = [merged, deltas[-1]]
        released(found)
    found = checkpointed(reduce(DataFrame.unionByName, deltas))
    for x in (named, wild, hidden, *deltas):
        dropped(x)
    return found


def enclosing(module: str, separator: str) -> F.Column:
    """struct(module, up) of a module and those around it, the nearest first."""
    parts = F.split(F.col(module), rf"\Q{separator}\E")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda up: F.struct(F.array_join(F.slice(parts, 1, F.size(parts) - up), separator).alias("module"), up.alias("up")))


def resolved(facts: DataFrame, *, nested: str | None = None) -> DataFrame:
    """path, name, of, line, symbol, tier, n: every use in facts (weftline.sources.symbols.FACTS) with the
    one symbol it means, or null where none or several (n) are in its nearest scope that has any.

    A symbol is `module.name`, or `path:name` where a module declares a name in several files. Scopes
    are, by tier: 0 the file, 1 its imports by name, 2 its module's other files (with `nested`, the
    separator of module names, those of the modules around it too, nearest first), 3 its wildcards.
    A use with a qualifier is looked up in the module that the qualifier imports.
    """
    f = checkpointed(facts.distinct())
    own = f.where("kind = 'declare'").groupBy("path", "module", "name").agg(F.min(F.coalesce("of", F.lit(""))).alias("seen"))
    many = own.groupBy("module", "name").agg(F.count("*").alias("files"))
    symbol = F.when(F.col("files") > 1, F.concat_ws(":", "path", "name")).otherwise(F.concat_ws(".", "module", "name"))
    own = checkpointed(own.join(many, ["module", "name"]).withColumn("symbol", symbol).drop("files"))
    # what a module passes on of itself may be private to other modules
    kept = f.where("kind = 'export'").select("module", "name", "of", "of_name").distinct()
    again = kept.where("of = module").join(own.select("module", F.col("name").alias("of_name"), "symbol"), ["module", "of_name"]).select("module", "name", "symbol")
    public = exports(own.where("seen <> 'private'").select("module", "name", "symbol").union(again), kept.where("of <> module"))
    imports = f.where("kind = 'import'").select("path", F.col("name").alias("local"), "of", "of_name").distinct()
    uses = checkpointed(f.where("kind = 'use'").select("path", "module", "name", F.col("of").alias("before"), "line").distinct())
    names = uses.where("before is null").select("path", "module", "name").distinct()
    exported = public.select(F.col("module").alias("of"), F.col("name").alias("of_name"), "symbol")
    row = lambda df, tier: df.select("path", "name", F.lit(None).cast("string").alias("before"), tier.cast("int").alias("tier"), "symbol")
    file = names.join(own.select("path", "name", "symbol"), ["path", "name"])
    by_name = names.join(imports.where("local is not null and of_name is not null").withColumnRenamed("local", "name"), ["path", "name"]).join(exported, ["of", "of_name"])
    around = names.select("path", "module", "name").distinct()
    if nested:
        around = around.select("path", "name", F.explode(enclosing("module", nested)).alias("at")).select("path", "name", "at.module", F.col("at.up").alias("up"))
    else:
        around = around.withColumn("up", F.lit(0))
    beside = around.join(own.select("module", "name", "symbol"), ["module", "name"])
    # the names that a wildcard could bring: joined by name first, so that no module's exports are spelled out for each importer
    stars = names.select("path", "name").distinct().join(imports.where("local is null").select("path", "of").distinct(), "path")
    through = stars.join(exported.withColumnRenamed("of_name", "name"), ["of", "name"])
    spaces = imports.where("local is not null and of_name is null").select("path", F.col("local").alias("before"), "of").distinct()
    dotted = uses.where("before is not null").select("path", "name", "before").distinct().join(spaces, ["path", "before"]).join(exported.withColumnRenamed("of_name", "name"), ["of", "name"])
    tiers = [row(file, F.lit(0)), row(by_name, F.lit(100)), row(beside, F.lit(200) + F.col("up")), row(through, F.lit(300))]
    tiers.append(dotted.select("path", "name", "before", F.lit(100).alias("tier"), "symbol"))
    found = reduce(DataFrame.union, tiers).distinct().groupBy("path", "name", "before", "tier").agg(F.count("*").alias("n"), F.min("symbol").alias("symbol"))
    best = found.groupBy("path", "name", "before").agg(F.min_by(F.struct("tier", "n", "symbol"), "tier").alias("best"))
    best = best.withColumn("key", F.coalesce("before", F.lit(""))).drop("before")
    out = uses.withColumn("key", F.coalesce("before", F.lit(""))).join(best, ["path", "name", "key"], "left")
    one = F.when(F.col("best.n") == 1, F.col("best.symbol"))
    return out.select("path", "name", F.col("before").alias("of"), "line", one.alias("symbol"), F.floor(F.col("best.tier") / 100).cast("int").alias("tier"), F.coalesce("best.n", F.lit(0)).cast("int").alias("n"))
