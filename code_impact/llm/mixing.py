"""Sources mixed to target weights: entropy balancing of document rates by Newton's method, then whole copies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from code_impact.llm.common import numbered
from code_impact.session import cut_lineage

# Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Rates are whole multiples of a billionth, so that sums of them are exact in any order.
UNIT = 1_000_000_000


def with_targets(sources: DataFrame, percent: int = 100, most: int = 3) -> DataFrame:
    """Add ``target`` to sources (weight, source_size): words by weight, at most ``most`` times the source's size.

    What goes beyond is shared by weight among the others, until none is above: all that stay below get one and the same
    number of words a unit of weight. It rises in rounds of one aggregate each, as more sources reach their limit.
    """
    level, total = -1.0, None
    full = F.col("weight") * F.lit(level) >= most * F.col("source_size")
    while True:
        row = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"),
            F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        total = row["size"] * percent / 100
        fresh = (total - row["taken"]) / row["weight"] if row["weight"] else math.inf
        if fresh <= level or row["weight"] == 0:
            break
        level = fresh
        full = F.col("weight") * F.lit(level) >= most * F.col("source_size")
    shared = F.col("weight") * F.lit(total - row["taken"]) / F.lit(float(row["weight"] or 1))
    return sources.withColumn("target", F.when(full, most * F.col("source_size")).otherwise(shared).cast("double"))


def _rate(tilt: Column, size: Column, most: int) -> Column:
    """exp(tilt * size) in units, at most ``most``."""
    return F.round(F.exp(F.least(tilt * size, F.lit(math.log(most)))) * UNIT).cast("long")


def balance(classes: DataFrame, sources: DataFrame, most: int = 3, rounds: int = 80, close: float = 1e-8) -> DataFrame:
    """(source_no, tilt) for sources (source_no, source_size, target) whose documents are counted in classes (source_no, size, n).

    Of all rates r that take a source's target of words, sum(r * size) = target, with 0 <= r <= ``most``, those nearest to one
    copy of each document in relative entropy are r = min(most, exp(tilt * size)). The tilt is the maximum of the concave dual, one
    number a source. A round sums the gradient and the curvature of all sources over the counted sizes and makes a Newton step for
    each, on the logarithm of the words taken; a step out of the bracket that the signs of the gradient leave is halved instead.
    Sums are whole numbers, so a rerun makes the same steps. A source at its limit has the tilt null: every rate is ``most``.
    """
    words = F.sum(F.col("n") * F.col("size"))
    least = F.min(F.when(F.col("size") > 0, F.col("size")))
    ratio = F.try_divide("target", "source_size")
    at_limit = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = classes.groupBy("source_no").agg(words.alias("words"), least.alias("least")).join(sources.select("source_no", "source_size", "target"), "source_no")
    # With the lower end no rate is above the ratio, with the upper end all rates are at their limit.
    state = state.select(
        "source_no",
        "target",
        F.when((F.col("words") == 0) | at_limit, None).otherwise(F.lit(0.0)).alias("tilt"),
        F.when(ratio < 1, F.log(ratio) / F.col("least")).otherwise(0.0).alias("low"),
        F.when(ratio < 1, 0.0).otherwise(F.lit(math.log(most)) / F.col("least")).alias("high"),
        ((F.col("words") == 0) | at_limit).alias("done"),
    )
    state = cut_lineage(state)
    for _ in range(rounds):
        if not state.where("NOT done").limit(1).count():
            break
        rate = _rate(F.col("tilt"), F.col("size"), most)
        taken = F.col("n").cast("decimal(18,0)") * F.col("size").cast("decimal(18,0)") * F.col("rate").cast("decimal(12,0)")
        bent = F.when(F.col("rate") < most * UNIT, F.col("n").cast("double") * F.col("size") * F.col("size") * F.col("rate") / UNIT)
        each = classes.join(state.where("NOT done").select("source_no", "tilt"), "source_no").withColumn("rate", rate)
        sums = each.groupBy("source_no").agg((F.sum(taken).cast("double") / UNIT).alias("taken"), F.coalesce(F.sum(F.round(bent).cast("decimal(38,0)")).cast("double"), F.lit(0.0)).alias("bend"))
        moved = state.join(sums, "source_no", "left")
        over = F.col("taken") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") + F.when((F.col("bend") > 0) & (F.col("taken") > 0), F.log(F.col("target") / F.col("taken")) * F.col("taken") / F.col("bend"))
        near = F.abs(F.col("taken") - F.col("target")) <= close * F.col("target")
        tight = (high - low) <= 1e-15 * F.greatest(F.abs(low), F.abs(high))
        ended = F.col("done") | F.coalesce(near | tight, F.lit(False))
        moved = moved.select(
            "source_no",
            "target",
            F.when(ended, F.col("tilt")).when((step > low) & (step < high), step).otherwise((low + high) / 2).alias("tilt"),
            F.when(ended, F.col("low")).otherwise(low).alias("low"),
            F.when(ended, F.col("high")).otherwise(high).alias("high"),
            ended.alias("done"),
        )
        state = cut_lineage(moved)
    return state.select("source_no", "tilt")


def _copies(before: Column, n: Column, rate: Column, shift: Column) -> Column:
    """Copies of the ``n`` documents that follow those with ``before`` units of rate: whole units passed, from ``shift`` on."""
    return n * F.floor(rate / UNIT) + F.floor((before + shift + n * (rate % UNIT)) / UNIT) - F.floor((before + shift) / UNIT)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), percent: int = 100, most: int = 3, shifts: int = 16) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken), one row per input row.

    Sizes are counts of words; a null or empty text has none. Sources by code point, null last, get the ``weights`` in turn and share
    ``percent`` of a hundred of all words, see ``with_targets``. A document's rate comes from ``balance``; a document without words keeps the
    rate that its source's tilt gives a size of 0, one, or ``most`` where the source is at its limit.

    Rates become copies by walking through a source from its largest documents to its smallest and giving a copy whenever the sum
    of rates passes a whole number: a document gets its rate rounded up or down, never more than ``most``, and as sizes fall
    along the walk, the words of a source miss their target by less than one document. Of ``shifts`` starts of the walk the one that
    misses by least is taken. Documents of a size are in order of a hash of id and text, so a rerun makes the same choice;
    equal rows may swap places. No source or size is gathered in a task: rows are numbered in ranges, and a source's table has one
    row for each size that it has, at most the square root of twice its words.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(id_col, text_col).alias("mark"))
    own = cut_lineage(own)
    sources = cut_lineage(own.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = numbered(sources, [F.col("source").asc_nulls_last()], "source_no")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    sources = cut_lineage(with_targets(cut_lineage(sources.withColumn("weight", weight)), percent, most))

    named = sources.select("source_no", F.col("source").alias("named"))
    own = own.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    order = [F.col("source_no"), F.col("size").desc(), F.col("mark"), F.col("doc_id").asc_nulls_last()]
    own = cut_lineage(numbered(cut_lineage(own), order, "place"))
    classes = cut_lineage(own.groupBy("source_no", "size").agg(F.count("*").alias("n"), F.min("place").alias("first")))
    tilts = balance(classes, sources, most)

    rate = F.when(F.col("tilt").isNull(), most * UNIT).otherwise(_rate(F.col("tilt"), F.col("size"), most))
    rated = cut_lineage(classes.join(tilts, "source_no").withColumn("rate", rate))
    before = Window.partitionBy("source_no").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("before", F.coalesce(F.sum((F.col("n") * (F.col("rate") % UNIT)) % UNIT).over(before), F.lit(0)) % UNIT)
    rated = cut_lineage(rated)
    starts = [UNIT * (2 * k + 1) // (2 * shifts) for k in range(shifts)]
    sums = rated.groupBy("source_no").agg(*[F.sum(F.col("size") * _copies(F.col("before"), F.col("n"), F.col("rate"), F.lit(s))).alias(f"s{s}") for s in starts])
    missed = F.least(*[F.struct(F.abs(F.col(f"s{s}") - F.col("target")).alias("by"), F.lit(s).alias("shift")) for s in starts])
    chosen = sums.join(sources, "source_no").select("source_no", "source_size", "target", missed["shift"].alias("shift"))
    rated = cut_lineage(rated.join(chosen, "source_no").select("source_no", "size", "first", "rate", "before", "shift", "source_size", "target"))

    placed = own.join(rated, ["source_no", "size"])
    passed = F.col("before") + (F.col("place") - F.col("first")) * (F.col("rate") % UNIT)
    copies = _copies(passed, F.lit(1), F.col("rate"), F.col("shift")).cast("long")
    return placed.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", (F.col("rate") / UNIT).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))
