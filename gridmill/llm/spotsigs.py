"""SpotSigs fingerprints, in DataFrame operations only.

A spot signature is a common word (the anchor) with the chain of the next
content words after it; common words in between are skipped, so what a page
repeats in every layout hardly counts. A document's fingerprint is its set of
signatures. Sets are partitioned by length: two sets whose lengths lie too far
apart cannot be alike and are not compared; others by their Jaccard likeness.
"""

from __future__ import annotations

from itertools import accumulate, count
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm.frames import id_and_text
from gridmill.operators.graph import components
from gridmill.store import materialize

# Frequent function words of English, German, French and Spanish.
ANCHORS = (
    "the a an and of to in is was that it for on with as be by this are from or at have not "
    "der die das und in zu den von ist mit sich des auf für dem ein eine nicht als auch im es an "
    "le la les de des du et un une en que qui dans est pour pas sur au par il elle ce se "
    "el los las del y que en un una por con para su al lo como se no es más o"
).split()

#: Content words in a chain.
CHAIN = 2
#: After so many words without an anchor, content words begin chains themselves.
REACH = 4
#: Rows of one ordered bucket, about.
BUCKET_ROWS = 250
#: Identifiers are cut into this many cells squared at most, of about as many rows each.
_CELLS = 64

_NOT_WORD = r"[^\p{L}\p{N}]+"


def with_signatures(df: DataFrame, text: str, name: str, chain: int = CHAIN) -> DataFrame:
    """Adds the sorted array of the text's signatures, 32 bits each.

    A content word with no anchor among the ``REACH`` words before it, or before the text's first
    anchor, begins a chain of its own, so that tables and lists have signatures too. At the end of a
    text chains may be shorter, down to one word after an anchor. A text of anchors alone is the set
    of its words; one without words, or null, has no signature.
    """
    words, spots, places, rest = (f"{name}__{x}" for x in ("words", "spots", "places", "rest"))
    anchor = lambda w: w.isin(*ANCHORS)
    signature = lambda *parts: F.xxhash64(*parts).bitwiseAND(F.lit(0xFFFFFFFF))
    content = lambda k: F.coalesce(F.get(rest, k), F.lit(""))
    df = df.withColumn(words, F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD), lambda w: w != ""))
    df = df.withColumn(spots, F.transform(words, lambda w, i: F.when(anchor(w), i).otherwise(-1 - i)))
    df = df.withColumns({
        places: F.transform(F.filter(spots, lambda i: i < 0), lambda i: -1 - i),
        spots: F.filter(spots, lambda i: i >= 0),
        rest: F.filter(words, lambda w: ~anchor(w)),
    })
    # Before the j-th anchor, at place p, there are p - j content words: its chain begins at that one.
    after_anchor = F.transform(
        spots, lambda p, j: F.when(p - j < F.size(rest), signature(F.get(words, p), *(content(p - j + k) for k in range(chain))))
    )
    # Before the k-th content word, at place p, there are p - k anchors.
    alone = F.transform(
        places,
        lambda p, k: F.when((p == k) | (p - F.get(spots, p - k - 1) > REACH), signature(*(content(k + n) for n in range(chain + 1)))),
    )
    df = df.withColumn(spots, F.array_compact(F.concat(after_anchor, alone)))
    return df.withColumn(
        name, F.array_sort(F.array_distinct(F.when(F.size(spots) > 0, F.col(spots)).otherwise(F.transform(words, lambda w: signature(w)))))
    ).drop(words, spots, places, rest)


def fingerprint(signatures: Column) -> Column:
    """The set as text: eight hexadecimal digits a signature, in order."""
    return F.concat_ws("", F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")))


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard likeness; two empty sets are alike. With a ``floor``, sets whose lengths' ratio, which bounds it, is below that count as 0."""
    shorter, longer = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return (
        F.when(longer == 0, F.lit(1.0)).when(shorter < floor * longer, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))
    ).cast("double")


def _numbers(xs: list, kind: str = "long") -> Column:
    """A constant array. One text costs the driver one call, where a column for each number costs one each."""
    return F.split(F.lit(",".join(map(repr, xs))), ",").cast(f"array<{kind}>")


def _placed(docs: DataFrame, bucket_rows: int) -> DataFrame:
    """Adds ``cell`` and ``bucket``, both ascending with (doc_id, tie), and ``tie``, a hash of the text.

    Cells are cut at quantiles of the identifiers, so that identifiers with gaps are spread too; within a cell buckets are
    even steps of the identifier. An identifier that is a quantile twice has a cell of its own, and rows
    without one too: there buckets are even steps of ``tie``.
    """
    n, none, low, high = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id")).first()
    cells = max(2, min(_CELLS * _CELLS, ceil(n / bucket_rows)))
    cuts: list[int] = []
    if n > bucket_rows and high is not None:
        shares = _numbers([k / cells for k in range(1, cells)], "double")
        cuts = docs.agg(F.percentile_approx("doc_id", shares, F.lit(16 * cells))).first()[0]
    often = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    starts = sorted({low or 0, *cuts, *often, *(c + 1 for c in often if c + 1 <= (high or 0))})
    per_cell = max(1, ceil((n - none) / max(len(set(cuts)), 1) / bucket_rows))
    own = {c: max(1, ceil(n * sum(x == c for x in cuts) / cells / bucket_rows)) for c in often}
    parts = [own.get(c, per_cell) for c in starts]
    firsts = [0, *accumulate(parts)]
    # The cell is found in two steps: a row of cells, then the cell in it.
    place = F.col("doc_id")
    row = F.greatest(F.size(F.filter(_numbers(starts[::_CELLS]), lambda c: c <= place)), F.lit(1))
    within = F.size(F.filter(F.slice(_numbers(starts), (row - 1) * _CELLS + 1, F.lit(_CELLS)), lambda c: c <= place))
    at = lambda xs: F.element_at(_numbers(xs), F.col("cell"))
    placed = docs.withColumn("tie", F.xxhash64("text"))
    placed = placed.withColumn("cell", F.when(place.isNotNull(), F.greatest((row - 1) * _CELLS + within, F.lit(1)).cast("int")).otherwise(F.lit(0)))
    start, end = at(starts).cast("double"), at([*starts[1:], (high or 0) + 1]) if (high or 0) < (1 << 63) - 1 else at([*starts[1:], high or 0])
    by_tie = (F.col("tie").cast("double") + float(1 << 63)) / float(1 << 64)
    by_id = (place.cast("double") - start) / F.greatest(end.cast("double") - start, F.lit(1.0))
    own_cell = F.array_contains(_numbers(often), at(starts)) if often else F.lit(False)
    step = lambda share, of: F.least(F.floor(F.greatest(share, F.lit(0.0)) * of), of - 1)
    apart = max(1, ceil(none / bucket_rows))
    bucket = F.when(F.col("cell") == 0, step(by_tie, F.lit(apart)) - apart).otherwise(at(firsts) + step(F.when(own_cell, by_tie).otherwise(by_id), at(parts)))
    return placed.withColumn("bucket", bucket.cast("long"))


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, Window]:
    """Rows in ordered buckets of descending doc_id, each bucket ending with a guest: the first row of the bucket after.

    Returns the rows with ``guest`` and the window over which ``lead`` finds the next row; drop guests
    after that. Null identifiers come last; rows of one identifier follow a hash of their text.
    """
    placed = _placed(docs, bucket_rows)
    # One row a bucket; the bucket above takes its first row as a guest, the lowest takes the highest's.
    # A cell's buckets are ordered among themselves; only the cells, a fixed number, are ordered in one task.
    heads = placed.groupBy("cell", "bucket").agg(F.max(F.struct("doc_id", "tie")).alias("head"))
    heads = materialize(heads, "bucket-heads")
    cells = heads.groupBy("cell").agg(F.min("bucket").alias("first"))
    cells = cells.withColumns({
        "after": F.lead("first").over(Window.orderBy("cell")), "lowest": F.min("first").over(Window.partitionBy()),
    }).select("cell", F.coalesce("after", "lowest").alias("after"))
    heads = heads.withColumn("host", F.lead("bucket").over(Window.partitionBy("cell").orderBy("bucket"))).join(F.broadcast(cells), "cell")
    heads = materialize(heads.select("bucket", "head", F.coalesce("host", "after").alias("host")), "bucket-hosts")
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("tie") == F.col("head.tie"))
    rows = placed.drop("cell").join(heads, "bucket", "left").withColumn(
        "places",
        F.when(is_head, F.array(F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))))
        .otherwise(F.array(F.struct("bucket", F.lit(False).alias("guest")))),
    )
    rows = rows.drop("bucket", "head", "host").select("*", F.explode("places").alias("place")).select("*", "place.bucket", "place.guest").drop("places", "place")
    return rows, Window.partitionBy("bucket").orderBy("guest", F.desc("doc_id"), F.desc("tie"))


def edited_and_next(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: signatures of its text, of the next row's, and of its edited text, and that text.

    The next row is the one after it in descending doc_id; after the last comes the first. The edited text
    ends in the next text's beginning: as many code points as a third of the text has, which it replaces.
    Null texts count as empty. A single row is its own next.
    """
    rows = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows, order = with_next(rows)
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    rows = with_signatures(rows, "text", "sigs").withColumn("next_sigs", F.lead("sigs").over(order)).where(~F.col("guest"))
    chars = F.length("text")
    third = F.floor(chars / 3).cast("int")
    rows = rows.select(
        "doc_id", "sigs", "next_sigs", chars.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), chars - third), F.substring("next_text", F.lit(1), third)).alias("edited"),
    )
    return with_signatures(rows, "edited", "edited_sigs")


def near_classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """For each row of ``docs``: doc_id, ``n_signatures`` and ``class_id``, the smallest doc_id reachable by likeness of ``least``.

    Equal sets are one node. Sets are partitioned by length, so that only equal and neighbouring partitions
    meet; there, sets meet at the rarest of their signatures, as many as two sets that are alike must
    share one of. At such a meeting all sets are compared with a few of it, the hubs, and then with four times
    as many, round by round, until what meets is one class or every set has been a hub: no
    likeness is missed, and large groups of copies cost their number, not its square. Rows without
    words are alike nothing; null identifiers count after all others.
    """
    none = F.lit((1 << 63) - 1)
    rows = with_signatures(id_and_text(docs), "text", "sigs")
    rows = materialize(rows.select(F.col("doc_id"), F.coalesce("doc_id", none).alias("id"), F.sha2(fingerprint(F.col("sigs")), 256).alias("print"), "sigs"), "spot-rows")
    sets = rows.where(F.size("sigs") > 0).groupBy("print").agg(F.min("id").alias("id"), F.first("sigs").alias("sigs"))
    sets = materialize(sets.select("print", F.xxhash64("print").alias("node"), "id", "sigs", F.size("sigs").alias("n")), "spot-sets")
    signatures = sets.select("node", "n", F.explode("sigs").alias("sig"))
    shared = signatures.groupBy("sig").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    ranked = signatures.join(shared, "sig").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("by_df"))
    # Signatures of one set alone come first in the order, and cannot be met.
    spare = F.size("by_df") - F.ceil(least * F.col("n")) + 1
    probes = ranked.where(spare > 0).select("node", "n", F.explode(F.slice("by_df", F.lit(1), spare.cast("int"))["sig"]).alias("sig"))
    part = F.floor(F.log(F.col("n").cast("double")) / log(1 / least)).cast("long")
    met = materialize(probes.select("node", "n", "sig", F.explode(F.array(part, part + 1)).alias("part")), "spot-meetings")
    links = sets.sparkSession.createDataFrame([], "a long, b long")
    roots = components(links)
    for step in count():
        known = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = known.groupBy("part", "sig").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
        open_ = open_.where(F.col("low") != F.col("high")).select("part", "sig", F.greatest(F.lit(1), F.floor(F.col("size") / 4**step)).alias("every"))
        here = materialize(known.join(open_, ["part", "sig"]), "spot-open")
        most = here.agg(F.max("every")).first()[0]
        if most is None:
            break
        hubs = here.where(F.pmod(F.xxhash64("node"), "every") == 0).select("part", "sig", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("root").alias("hub_root"))
        near = (F.least("n", "hub_n") >= least * F.greatest("n", "hub_n")) & (F.col("root") != F.col("hub_root"))
        pairs = here.join(hubs, ["part", "sig"]).where(near).select("node", "hub").distinct()
        pairs = pairs.join(sets.select("node", "sigs"), "node").join(sets.select(F.col("node").alias("hub"), F.col("sigs").alias("hub_sigs")), "hub")
        found = pairs.where(likeness(F.col("sigs"), F.col("hub_sigs"), least) >= least).select(F.col("node").alias("a"), F.col("hub").alias("b"))
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
        if most == 1:
            break
    named = sets.select("print", "node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("id").alias("least_id"))
    named = named.join(names, "root").select("print", "least_id")
    rows = rows.select("doc_id", "id", "print", F.size("sigs").alias("n_signatures")).join(named, "print", "left")
    return rows.select("doc_id", "n_signatures", F.nullif(F.coalesce("least_id", "id"), none).alias("class_id"))
