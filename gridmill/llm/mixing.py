"""Mixing sources to target weights by entropy balancing.

Targets share out the wanted words by weight, no source above its cap
(water-filling). Within a source the rate of a document of size ``s`` is
``min(cap, exp(lambda * z))`` with ``z = 1 + s / (s + mean size)``: the
exponentially tilted rates that solve the convex dual of the source's token
constraint. Newton steps, kept inside a bracket, find all lambdas at once; each
step is one aggregation of the table of sizes, which has a row for each source
and size, and after ``_STEPS`` the bracket is halved until it is settled. Rates are then rounded into copies by cumulative sums from the longest
to the shortest. What a source is then short of (or over) in words is settled by single copies, from the largest size that fits on, so
it misses its target by less than its shortest document that can still be taken once more (or less).

Everything is DataFrame operations. Rows of one source and size are split into
parts of about ``PART_ROWS`` by a hash of their identifier and text. Sums run over a
source's sizes first, then over the parts of each size, so no task sees all parts of a source.
"""

from __future__ import annotations

from itertools import count
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm.frames import fresh
from gridmill.store import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
PART_ROWS = 512
_NEAR = 1e-9
#: After so many Newton steps the bracket is only halved; some 60 halvings leave no number between its ends.
_STEPS = 20
_KEY = ["no_source", "source"]


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\t\\n\\v\\f\\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, size and the source as a key that has no null."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("tie"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row a source: its words, documents and target.

    ``sizes`` has a row for each source and size with its number ``n``. Only this table
    of one row a source is ordered in one task.
    """
    table = sizes.groupBy(*_KEY).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    rank = F.row_number().over(Window.orderBy("no_source", "source")) - 1
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int")))
    table = table.withColumn("ceiling", cap * F.col("source_size"))
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("ceiling") / F.col("weight"), "no_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(ordered), F.lit(0.0))
    # The level that the sources from here on get for each unit of weight, if all smaller ones are full.
    level = (share * F.sum("source_size").over(everything) - before("ceiling")) / (F.sum("weight").over(everything) - before("weight"))
    table = table.withColumn("level", F.when(F.col("ceiling") / F.col("weight") > level, level))
    # Of these the first holds: from it on no source is full.
    first = F.min_by("level", F.when(F.col("level").isNotNull(), F.col("ceiling") / F.col("weight"))).over(everything)
    return table.select(
        *_KEY, "source_size", "docs", F.least(F.col("ceiling"), F.coalesce(F.col("weight") * first, F.col("ceiling"))).alias("target")
    )


def _tilt() -> Column:
    return 1 + F.coalesce(F.try_divide(F.col("size"), F.col("size") + F.col("source_size") / F.col("docs")), F.lit(0.0))


def _rate(cap: float) -> Column:
    return F.when(F.col("target") >= cap * F.col("source_size"), F.lit(cap)).otherwise(
        F.least(F.lit(cap), F.exp(F.col("dual") * _tilt()))
    )


def _exact_sum(value: Column) -> Column:
    """A sum in decimals: the same in whatever order the parts arrive, so that reruns agree."""
    return F.sum(value.cast("decimal(38,9)")).cast("double")


def solve(sizes: DataFrame, goal: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds the dual variable ``dual`` to each source's row, by Newton steps over the table of sizes."""
    top = log(cap)
    now = materialize(
        goal.withColumns({
            "dual": F.coalesce(F.log(F.try_divide(F.col("target"), F.col("source_size"))) / 1.5, F.lit(0.0)),
            "low": F.lit(-700.0), "high": F.lit(top),
        }), "duals",
    )
    for step in count(1):
        rate = _rate(cap)
        words = F.col("n") * F.col("size") * rate
        sums = (
            sizes.join(now, _KEY)
            .groupBy(*_KEY, "source_size", "docs", "target", "dual", "low", "high")
            .agg(_exact_sum(words).alias("value"), _exact_sum(F.when(rate < cap, words * _tilt()).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("value") - F.col("target")
        low = F.when(gap < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.col("dual") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        middle = (low + high) / 2
        inside = (newton > low) & (newton < high) & F.lit(step < _STEPS)
        # Settled: on target, or no number is left between the bracket's ends.
        done = (F.abs(gap) <= _NEAR * F.greatest(F.col("target"), F.lit(1.0))) | (middle <= low) | (middle >= high)
        moved = F.when(done, F.col("dual")).when(inside, newton).otherwise(middle)
        now = materialize(sums.select(*_KEY, "source_size", "docs", "target", moved.alias("dual"), low.alias("low"), high.alias("high"), done.alias("done")), "duals")
        if not now.where(~F.col("done")).head(1):
            return now.drop("low", "high", "done")


def settled(bins: DataFrame, most: int) -> DataFrame:
    """``(no_source, source, size, moves)``: copies to add (or, below 0, to take away) so that each source comes as near its target as single copies bring it.

    ``bins`` has numbers ``n`` and copies ``taken`` of parts of each size. A source's sizes, one entry each, are walked from the largest: of each size as
    many copies change as still fit into what is missing. At most as many sizes change as that number halves. If what then remains is more than half of
    the smallest size that can change, one copy of that is changed too.
    """
    sizes = bins.where("size > 0").groupBy(*_KEY, "size").agg(F.sum("n").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target"))
    gap = F.round(F.first("target")).cast("long") - F.sum(F.col("taken") * F.col("size"))
    by_source = sizes.groupBy(*_KEY).agg(gap.alias("gap"), F.sort_array(F.collect_list(F.struct("size", "n", "taken")), asc=False).alias("sizes"))
    adds = F.col("gap") > 0
    by_source = by_source.withColumn("sizes", F.transform("sizes", lambda s: F.struct(s["size"].alias("size"), F.when(adds, most * s["n"] - s["taken"]).otherwise(s["taken"]).alias("room"))))
    by_source = by_source.withColumn("sizes", F.filter("sizes", lambda s: s["room"] > 0))
    start = F.struct(F.abs("gap").alias("left"), F.array().cast("array<struct<size:bigint,k:bigint>>").alias("picks"))

    def step(acc: Column, s: Column) -> Column:
        k = F.least(s["room"], F.floor(acc["left"] / s["size"]))
        picks = F.when(k > 0, F.array_append(acc["picks"], F.struct(s["size"].alias("size"), k.alias("k")))).otherwise(acc["picks"])
        return F.struct((acc["left"] - k * s["size"]).alias("left"), picks.alias("picks"))

    walked = by_source.withColumn("walk", F.aggregate("sizes", start, step))
    # The smallest size with room left when all picks are made: it is larger than what remains, or there is none.
    picked = lambda s: F.coalesce(F.element_at(F.map_from_entries("walk.picks"), s["size"]), F.lit(0))
    spare = F.try_element_at(F.filter("sizes", lambda s: s["room"] > picked(s)), F.lit(-1))
    walked = walked.withColumn("spare", spare["size"])
    last = F.when(2 * F.col("walk.left") > F.col("spare"), F.array(F.struct(F.col("spare").alias("size"), F.lit(1).cast("long").alias("k"))))
    picks = F.concat(F.col("walk.picks"), F.coalesce(last, F.array().cast("array<struct<size:bigint,k:bigint>>")))
    moves = walked.select(*_KEY, adds.alias("adds"), F.explode(picks).alias("pick")).groupBy(*_KEY, F.col("pick.size").alias("size"))
    return moves.agg(F.sum(F.when(F.col("adds"), F.col("pick.k")).otherwise(-F.col("pick.k"))).alias("moves"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """For each row of ``docs``: doc_id, ``tie`` (a hash of its text), source, size, source_size, target, rate and ``copies``.

    A null text has size 0, a null source is a source of its own, after all
    others. Reruns agree: which documents of one size get one copy more follows
    from hashes of their identifiers and texts. Sources without words have target 0.
    """
    rows = materialize(sized(docs), "sizes")
    sizes = materialize(rows.groupBy(*_KEY, "size").agg(F.count("*").alias("n")), "size-counts")
    duals = solve(sizes, targets(sizes, weights, share, cap), cap)
    large = materialize(
        sizes.where(F.col("n") > PART_ROWS).select(*_KEY, "size", F.ceil(F.col("n") / PART_ROWS).alias("parts")), "large-sizes"
    )
    bin_key = [*_KEY, "size", "part"]
    hashed = F.xxhash64("doc_id", "tie")
    rows = rows.join(large, [*_KEY, "size"], "left").withColumn("part", F.pmod(hashed, F.coalesce("parts", F.lit(1)))).drop("parts")
    bins = rows.groupBy(*bin_key).agg(F.count("*").alias("n")).join(duals, _KEY).withColumn("rate", _rate(cap))
    whole = F.least(F.floor("rate"), F.lit(int(cap)))
    # Longest first: what the last rounding leaves over is then a matter of the shortest documents.
    # Decimals, so that the sums of a size's parts are the same as the size's own.
    share = (F.col("n").cast("decimal(18,0)") * F.col("over")).cast("decimal(38,12)")
    bins = bins.withColumn("whole", whole).withColumn("over", (F.col("rate") - whole).cast("decimal(13,12)"))
    by_size = bins.groupBy(*_KEY, "size").agg(F.sum(share).alias("share"))
    longer = Window.partitionBy(*_KEY).orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select(*_KEY, "size", F.coalesce(F.sum("share").over(longer), F.lit(0)).cast("decimal(38,12)").alias("before"))
    upto = Window.partitionBy(*_KEY, "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.join(by_size, [*_KEY, "size"]).withColumn("upto", (F.col("before") + F.sum(share).over(upto)).cast("decimal(38,12)"))
    copies_upto = lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    bins = bins.withColumn("extra", copies_upto(F.col("upto")) - copies_upto((F.col("upto") - share).cast("decimal(38,12)")))
    taken = F.col("whole") * F.col("n") + F.col("extra")
    bins = materialize(bins.select(*bin_key, "n", "source_size", "target", "rate", taken.alias("taken")), "bins")
    moved = settled(bins, int(cap))
    room = F.when(F.col("moves") > 0, int(cap) * F.col("n") - F.col("taken")).otherwise(F.col("taken"))
    earlier = Window.partitionBy(*_KEY, "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    changed = bins.join(moved, [*_KEY, "size"]).withColumn("room", room)
    changed = changed.withColumn("left", F.abs("moves") - F.coalesce(F.sum("room").over(earlier), F.lit(0)))
    own = F.greatest(F.lit(0), F.least("room", "left")) * F.signum("moves").cast("long")
    plan = bins.join(changed.select(*bin_key, own.alias("own")), bin_key, "left")
    total = F.col("taken") + F.coalesce("own", F.lit(0))
    whole = F.floor(total / F.col("n"))
    plan = plan.select(*bin_key, "source_size", "target", "rate", whole.alias("whole"), (total - whole * F.col("n")).alias("extra"))
    place = F.row_number().over(Window.partitionBy(*bin_key).orderBy(F.xxhash64("doc_id", "tie", F.lit(1)), "doc_id", "tie"))
    return (
        rows.withColumn("place", place)
        .join(plan, bin_key)
        .select(
            "doc_id", "tie", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", "rate",
            F.least(F.col("whole") + (F.col("place") <= F.col("extra")).cast("long"), F.lit(int(cap))).alias("copies"),
        )
    )


def repeat_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in their own columns."""
    mixed = mix(docs, weights, share, cap)
    names = {k: fresh(f"mix_{k}", docs.columns) for k in ("id", "no_id", "tie", "source", "no_source", "size", "list", "at")}
    key = [names[k] for k in ("id", "no_id", "tie", "source", "no_source", "size")]

    def keyed(df: DataFrame, tie: Column, size: Column) -> DataFrame:
        doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
        return df.withColumns(dict(zip(key, (F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), tie, F.coalesce(source, F.lit("")), source.isNull(), size), strict=True)))

    # Rows alike in identifier, text and source share a list of copies, dealt out in order.
    lists = keyed(mixed, F.col("tie"), F.col("size")).groupBy(*key).agg(F.sort_array(F.collect_list("copies"), asc=False).alias(names["list"]))
    text = F.col("text").cast("string")
    rows = keyed(docs, F.xxhash64(text), word_count(text)).join(lists, key)
    rows = rows.withColumn(names["at"], F.row_number().over(Window.partitionBy(*key).orderBy(names["tie"])))
    copies = F.element_at(names["list"], F.col(names["at"])).cast("int")
    rows = rows.where(copies > 0).withColumn(names["at"], F.explode(F.sequence(F.lit(1), copies)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
