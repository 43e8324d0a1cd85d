"""URL filter: rules first, then the ratio of two character language models.

Two smoothed variable-order Markov models are fitted, one on URLs that the rules accept and
one on those that they reject. A URL that no rule fits is judged by the difference of the
two log likelihoods divided by its length, against a threshold calibrated on URLs kept
apart from the fit. Both models count all URLs of their class: counts are tables, which grow
with the different runs of characters and are joined, never collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "\x00"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased. Else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does.

    A rule is host/path; it fits its host and all subdomains if the path starts as its own
    does. The expression grows with the number of rules, which is taken to be some hundreds.
    """
    found = None
    for verdict, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


class Markov:
    """Variable-order character model. Orders are blended as by Witten and Bell: each context
    gives the shorter one a share that grows with the number of different successors. The plain
    form of what gains() has as tables."""

    def __init__(self, texts: Sequence[str], order: int) -> None:
        self.order = order
        self.counts: dict[str, dict[str, int]] = {}
        for text in texts:
            padded = "\x02" * order + text + END
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    successors = self.counts.setdefault(padded[i - k : i], {})
                    successors[padded[i]] = successors.get(padded[i], 0) + 1
        self.totals = {c: sum(s.values()) for c, s in self.counts.items()}

    def log_p(self, context: str, char: str) -> float:
        p = 1 / 256
        for k in range(len(context) + 1):
            successors = self.counts.get(context[len(context) - k :])
            if successors is None:
                break
            kinds = len(successors)
            p = (successors.get(char, 0) + kinds * p) / (self.totals[context[len(context) - k :]] + kinds)
        return math.log(p)


def _runs(text: str, order: int) -> Column:
    """Each character of a text, and its end, behind the `order` characters before it."""
    padded = F.concat(F.lit("\x02" * order), F.col(text), F.lit(END))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order + 1}}}))."), F.lit(1))


def gains(counted: DataFrame, order: int) -> DataFrame:
    """gram, gain: log P in the first class's model - log P in the second's of a run's last character
    behind the others. counted: gram (order + 1 characters), a and b, how often it is in each class.

    A level for each order, the longest first, sums the counts of runs with the same end; from the
    shortest on each level's chances are blended with those of the level below."""
    levels = [checkpointed(counted.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))]
    for _ in range(order):
        levels.append(checkpointed(levels[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))))
    chance = None
    for k, level in enumerate(reversed(levels)):
        w = Window.partitionBy(F.substring("gram", 1, k))  # a row for each different successor
        rows = level.select("gram", "a", "b", *(f(F.col(c)).over(w).alias(n + c) for c in "ab" for n, f in (("all_", F.sum), ("kinds_", lambda x: F.sum((x > 0).cast("long"))))))
        if chance is None:
            rows = rows.withColumns({"pa": F.lit(1 / 256), "pb": F.lit(1 / 256)})
        else:
            rows = rows.withColumn("end", F.expr("substring(gram, 2)")).join(chance.withColumnRenamed("gram", "end"), "end")
        blend = lambda c: F.when(F.col(f"kinds_{c}") == 0, F.col(f"p{c}")).otherwise((F.col(c) + F.col(f"kinds_{c}") * F.col(f"p{c}")) / (F.col(f"all_{c}") + F.col(f"kinds_{c}")))
        chance = rows.select("gram", blend("a").alias("pa"), blend("b").alias("pb"))
    return chance.select("gram", (F.log("pa") - F.log("pb")).alias("gain"))


def calibrate(held: DataFrame) -> float:
    """held: score, verdict. The threshold with the largest sum of both classes' shares of right verdicts;
    the middle of the widest such gap, 0 if a class is empty. Scores are put in order by ranges."""
    yes, no = (F.sum((F.col("verdict") == v).cast("long")) for v in ("allow", "block"))
    points = held.groupBy("score").agg(yes.alias("yes"), no.alias("no"))
    ranged = checkpointed(points.repartitionByRange("score").withColumn("_range", F.spark_partition_id()))
    parts = ranged.groupBy("_range").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.min("score").alias("first")).orderBy("_range").collect()  # a row for each partition
    n_yes, n_no = sum(r["yes"] for r in parts), sum(r["no"] for r in parts)
    if not n_yes or not n_no:
        return 0.0
    starts, before = [], (0, 0)
    for r, after in zip(parts, [*parts[1:], None], strict=True):
        starts.append((r["_range"], *before, after["first"] if after else None))
        before = (before[0] + r["yes"], before[1] + r["no"])
    known = held.sparkSession.createDataFrame(starts, "_range int, b_yes long, b_no long, after double")
    w = Window.partitionBy("_range").orderBy("score")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.select("_range", "score", F.sum("yes").over(upto).alias("yes"), F.sum("no").over(upto).alias("no"), F.lead("score").over(w).alias("next")).join(F.broadcast(known), "_range")
    gain = (F.col("no") + F.col("b_no")) / n_no - (F.col("yes") + F.col("b_yes")) / n_yes
    rows = rows.select("score", F.coalesce("next", "after", F.col("score") + 1e-9).alias("next"), gain.alias("gain"))
    best = rows.agg(F.max("gain")).first()[0]
    at = rows.where(F.col("gain") >= best - 1e-12).orderBy(F.desc(F.col("next") - F.col("score")), "score").first()
    return (at["score"] + at["next"]) / 2


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    order: int = 5,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict (allow or block), score, by_rule.

    The models are fitted on all different URLs of each class (repeats count once), but for a
    fifth of them by hash, kept for the threshold; all URLs are
    judged. score is the method's, above 0 in favour of the URL; null where a rule decides.
    A null or empty URL without a rule has no text to judge and is blocked. Where one class
    has no URL, there is no ratio and URLs without a rule are allowed, empty ones excepted.
    An empty table gives no rows; rows that repeat are judged alike; other columns are
    ignored.
    """
    url = F.col(url_col)
    judged = pages.select(F.col(id_col), url.alias("_url"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = judged.where("_rule is not null").withColumn("score", F.lit(None).cast("double"))
    open_ = judged.where("_rule is null")

    texts = judged.where("_url is not null and (_rule is not null or _url <> '')").select(F.lower("_url").alias("_text"), F.col("_rule.verdict").alias("verdict")).distinct()
    held = F.pmod(F.crc32(F.encode("_text", "UTF-8")), F.lit(5)) == 0
    texts = checkpointed(texts.select("_text", "verdict", (F.col("verdict").isNotNull() & held).alias("held"), F.monotonically_increasing_id().alias("n")))
    found = {r["verdict"]: r for r in texts.groupBy("verdict").agg(F.count("*").alias("n"), F.sum((~F.col("held")).cast("int")).alias("fit")).collect()}  # three rows
    if "allow" in found and "block" in found:
        fit = ~F.col("held")
        for v in ("allow", "block"):  # a class of which all is held apart is fitted on all of it
            fit = fit | ((F.col("verdict") == v) & F.lit(not found[v]["fit"]))
        times = lambda v: (F.coalesce(F.col("verdict") == v, F.lit(False)) & fit).cast("long")
        counted = texts.select(F.explode(_runs("_text", order)).alias("gram"), times("allow").alias("a"), times("block").alias("b"))
        asked = texts.where("verdict is null or held").select("n", F.explode(_runs("_text", order)).alias("gram"))
        sums = asked.join(gains(counted, order), "gram").groupBy("n").agg(F.sum("gain").alias("sum"))
        scored = checkpointed(texts.where("verdict is null or held").join(sums, "n").select("_text", "verdict", (F.col("sum") / (F.length("_text") + 1)).alias("score")))
        at = calibrate(scored.where("verdict is not null"))
        scored = scored.where("verdict is null").select("_text", (F.col("score") - at).alias("score"))
        without = open_.where("coalesce(_url, '') = ''").withColumn("score", F.lit(None).cast("double"))
        open_ = open_.where("_url <> ''").withColumn("_text", F.lower("_url")).join(scored, "_text").drop("_text").unionByName(without)
    else:
        open_ = open_.withColumn("score", F.when(F.col("_url") != "", F.lit(1.0)))
    scored = ruled.unionByName(open_)
    by_method = F.when(F.coalesce(F.col("score") > 0, F.lit(False)), "allow").otherwise("block")
    return scored.select(
        F.col(id_col), "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), by_method).alias("verdict"),
        "score", F.col("_rule").isNotNull().alias("by_rule"),
    )
