r"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, its expected number of copies, between 0 and 2.  Among all rates that
give each source its target of tokens, those nearest to one copy each in relative entropy are
min(2, exp(l x)), x the document's size in units of its source and l the source's multiplier.  The
dual is convex, and l solves f(l) = sum of size * rate = target.  Newton's method finds it for all
sources at once: each iteration is one aggregation over a histogram (source, size, documents), on
which alone rates depend, so texts are read once and a hot source costs no more rows than it has
sizes.  Steps that leave a proven bracket, and every third step, halve the bracket instead.

Rates become whole copies.  Within a source the sizes are walked from the largest down (a source of
n tokens has at most sqrt(2 n) different sizes, so this is a short list even at 10^14 tokens); each
size gets the whole copies, each rate rounded down or up, that bring the tokens so far nearest to
what the rates ask; the rest is carried on to smaller sizes, so what remains is about half a small
document.  Inside a size the copies go to documents by the hash of their id.

Targets: sources by code point (null last) weigh 3, 1, 2 in turn and share 150 % of all tokens;
nobody gets over twice its own tokens, the excess is shared among the others by weight.

Contract: null or wordless text has size 0 and takes 0; a null source is a source of its own;
repeated rows are documents of their own and may differ in copies; rows without an id take part;
an empty table gives no rows; extra columns are ignored.  Sums run over integers, so reruns agree.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.llm.ranks import positions
from plaudit.scale import heavy_keys, join_dimension
from plaudit.session import materialize

WEIGHTS = (3, 1, 2)
SHARE_PERCENT, MOST = 150, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Rates in sums are whole numbers of this unit.
UNIT = 10**9
TOLERANCE, ITERATIONS = 1e-7, 80


#: A source as a key that is never null: nulls are flagged, and sort last.
SOURCE = ["absent", "name"]


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, absent, name, size): words of every whole text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.col("source"), F.lit(""))
    return docs.select("doc_id", F.col("source").isNull().alias("absent"), name.alias("name"), size.alias("size"))


def targets(histogram: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(number, source, source_size, target) of every source; ``number`` follows the order."""
    sources = histogram.groupBy(*SOURCE).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranked = positions(sources, [], SOURCE)
    weight = F.element_at(F.expr(f"array({', '.join(f'{w}L' for w in weights)})"), ((F.col("pos") - 1) % len(weights) + 1).cast("int"))
    weighed = materialize(ranked.select(F.col("pos").alias("number"), *SOURCE, "source_size", weight.alias("weight")), "sources")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    # Level: what a weight of one gets.  In hundredths of tokens, as exact whole numbers.
    full, last = F.lit(False), -1
    level = (0, 1)
    while True:
        seen = weighed.agg(
            F.sum(F.when(full, F.col("source_size"))).alias("given"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("n"),
        ).first()
        if seen["n"] == last or not seen["open"]:
            break
        last = seen["n"]
        level = (SHARE_PERCENT * total - 100 * MOST * (seen["given"] or 0), 100 * seen["open"])
        above, below = (F.lit(x).cast("decimal(38,0)") for x in level)
        full = F.col("weight") * above >= F.col("source_size") * MOST * below
    ideal = F.col("weight") * F.lit(level[0] / level[1])
    return weighed.select(
        "number", *SOURCE, "source_size",
        F.when(full, (F.col("source_size") * MOST).cast("double")).otherwise(ideal).alias("target"),
    )


def _rate(multiplier: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(multiplier * F.col("size") / F.col("scale"), F.lit(1.0))))


def multipliers(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """(number, scale, l) of the sources that are neither empty nor at their limit.

    ``histogram`` (number, size, n) counts documents with words.
    """
    open_ = goals.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * MOST))
    units = histogram.groupBy("number").agg(
        F.min("size").alias("least"), F.sum(F.col("n") * F.col("size")).alias("tokens"),
        F.sum((F.col("n") * F.col("size")).cast("decimal(38,0)") * F.col("size")).cast("double").alias("squares"),
    )
    scale = F.col("squares") / F.col("tokens")
    # All rates at their limit above, below the smallest document alone decides.
    edge = F.when(F.col("target") > F.col("tokens"), F.lit(math.log(MOST))).otherwise(F.log(F.col("target") / F.col("tokens")))
    limit = edge * F.col("scale") / F.col("least")
    state = materialize(
        open_.join(units, "number").withColumn("scale", scale).select(
            "number", "target", "scale", F.lit(0.0).alias("l"),
            F.least(F.lit(0.0), limit).alias("low"), F.greatest(F.lit(0.0), limit).alias("high"),
            F.lit(math.inf).alias("error"), F.lit(False).alias("done"),
        ),
        "multipliers",
    )
    for _ in range(ITERATIONS):
        if state.where("not done").isEmpty():
            return state
        rate = _rate(F.col("l"))
        whole = (F.col("n") * F.col("size")).cast("decimal(20,0)") * (rate * UNIT).cast("long").cast("decimal(18,0)")
        slope = F.when(rate < MOST, whole * F.col("size").cast("decimal(12,0)"))
        sums = histogram.join(state.where("not done"), "number").groupBy("number").agg(
            (F.sum(whole).cast("double") / UNIT).alias("f"), (F.sum(slope).cast("double") / UNIT).alias("raw"),
        )
        found = state.join(sums, "number", "left")
        over = F.col("f") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("l")), F.when(over, F.col("l")).otherwise(F.col("high"))
        # Newton on log f: exact where rates grow alike, and f is positive.
        newton = F.col("l") - F.log(F.col("f") / F.col("target")) * F.col("f") * F.col("scale") / F.col("raw")
        half = (F.col("new_low") + F.col("new_high")) / 2
        inside = (F.col("newton") > F.col("new_low")) & (F.col("newton") < F.col("new_high")) & (F.col("off") <= F.col("error") / 2)
        off = F.abs(F.col("f") - F.col("target"))
        near = F.col("off") <= TOLERANCE * F.col("target")
        stuck = F.col("new_high") - F.col("new_low") <= 1e-15 * (F.abs("l") + F.lit(1e-9))
        stepped = found.withColumns(
            {"off": off, "new_low": low, "new_high": high, "newton": F.when((F.col("raw") > 0) & (F.col("f") > 0), newton)}
        )
        done = F.col("done") | near | stuck
        state = materialize(
            stepped.select(
                "number", "target", "scale",
                F.when(done, F.col("l")).when(inside, F.col("newton")).otherwise(half).alias("l"),
                F.when(F.col("done"), F.col("low")).otherwise(F.col("new_low")).alias("low"),
                F.when(F.col("done"), F.col("high")).otherwise(F.col("new_high")).alias("high"),
                F.when(inside, F.col("off")).otherwise(math.inf).alias("error"), done.alias("done"),
            ),
            "multipliers",
        )
    return state


def _whole_copies(group: pd.DataFrame) -> pd.DataFrame:
    """The sizes of one source, largest first, to whole copies; what is owed goes down the list.

    Rates are rounded down or up first.  A second walk settles what that left, with any copies.
    """
    group = group.sort_values("size", ascending=False)
    rows = list(zip(group["size"].tolist(), group["n"].tolist(), group["rate"].tolist()))
    owed = group["target"].iloc[0] - math.fsum(n * size * rate for size, n, rate in rows)
    copies = []
    for size, n, rate in rows:
        owed += n * size * rate
        copies.append(min(max(round(owed / size), n * math.floor(rate)), n * math.ceil(rate)))
        owed -= copies[-1] * size
    for i, (size, n, _) in enumerate(rows):
        change = min(max(round(owed / size), -copies[i]), MOST * n - copies[i])
        copies[i] += change
        owed -= change * size
    return group[["number", "size", "n", "rate"]].assign(copies=copies)


def copies_by_size(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """(number, size, n, rate, copies): whole copies for the n documents of each size together."""
    solved = multipliers(histogram, goals).select("number", "scale", "l")
    rated = (
        histogram.join(goals.select("number", "target", "source_size"), "number").join(solved, "number", "left")
        .withColumn("rate", F.when(F.col("l").isNotNull(), _rate(F.col("l"))).when(F.col("target") > 0, F.lit(float(MOST))).otherwise(0.0))
    )
    return rated.groupBy("number").applyInPandas(_whole_copies, "number long, size long, n long, rate double, copies long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate of every document.

    ``taken`` is size times the whole copies of the document; ``rate`` the copies before rounding.
    """
    read = materialize(sized(docs), "sizes")
    key = [*SOURCE, "size"]
    counts = materialize(read.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "histogram")
    goals = materialize(targets(counts, weights), "targets")
    histogram = materialize(counts.where("size > 0").join(goals, SOURCE).select("number", "size", "n"), "histogram")
    copies = materialize(copies_by_size(histogram, goals), "copies")
    # Of n documents of a size each gets ``each`` copies, and the first ``more`` one more.
    each = F.floor(F.col("copies") / F.col("n"))
    shares = goals.join(copies.withColumn("each", each), "number").select(
        *key, "number", "source_size", "target", "rate", "each", (F.col("copies") - F.col("each") * F.col("n")).alias("more")
    )
    no = F.lit(0).cast("long")
    wordless = goals.select(*SOURCE, no.alias("size"), "number", "source_size", "target", F.lit(0.0).alias("rate"), no.alias("each"), no.alias("more"))
    known = materialize(
        join_dimension(read, shares.unionByName(wordless), key, "inner", heavy=heavy_keys(counts, key, count="n")), "documents"
    )
    odd = positions(known.where("more > 0"), ["number", "size"], [F.xxhash64("doc_id"), "doc_id"])
    even = known.where("more = 0").withColumn("pos", F.lit(1).cast("long"))
    extra = F.when(F.col("pos") <= F.col("more"), 1).otherwise(0)
    return odd.unionByName(even).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("each") + extra)).alias("taken"), "rate"
    )
