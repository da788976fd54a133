"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import row_key, unused, written

WORD = r"[^\x20\x09-\x0D]+"
#: A source's documents are summed in this many ranges of their rank; only one range is put in order.
RANGES = 4096
_DIGITS = 13


def uniform(key: Column, seed: str) -> Column:
    """A number between 0 and 1, the same in every run, from a row's key."""
    digest = F.substring(F.md5(F.concat(key, F.lit(seed))), 1, _DIGITS)
    return (F.conv(digest, 16, 10).cast("long") + 0.5) / F.lit(float(16**_DIGITS))


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with their place by code point, null last; ranges are numbered side by side."""
    order = F.col("source").asc_nulls_last()
    part, inner = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = sources.repartitionByRange(order).sortWithinPartitions(order)
    ranged = written(ranged.withColumn("part", part).withColumn("inner", inner), "mix-sources")
    sums = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("part", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("offset"))
    return ranged.join(offsets, "part").withColumn("place", F.col("offset") + F.col("inner")).drop("part", "inner", "offset")


def _targets(sources: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Add each source's target: shares by weight, cut at ``most`` times the source, the excess dealt out again.

    Every round brings two sums to the driver. Sizes and weights are whole
    numbers, so a round that cuts the same sources ends the loop exactly.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = written(sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "mix-weights")
    totals = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level = share * (totals[0] or 0), 0.0
    left, open_weight = budget, totals[1]
    while open_weight and left / open_weight != level:
        level = left / open_weight
        cut = F.col("weight") * F.lit(level) > F.col("cap")
        sums = weighed.agg(F.sum(F.when(cut, F.col("cap"))), F.sum(F.when(~cut, F.col("weight")))).first()
        left, open_weight = budget - (sums[0] or 0), sums[1]
    target = F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double"))
    return weighed.withColumn("target", target if open_weight else F.col("cap").cast("double"))


def _chances(sizes: DataFrame, known: DataFrame) -> DataFrame:
    """For each source what its documents' chances of one more copy follow from.

    A document larger than the words that are missing has none. The others have
    chances in proportion to their sizes, ``factor`` times the size, that add up
    to the missing words; sizes from ``certain`` on, where this reaches 1, are
    taken for sure. ``sizes`` has a row for each source and size, so the sums in
    order of size run over different sizes, not over documents.
    """
    fits = sizes.join(known, "name").where((F.col("size") > 0) & (F.col("size") <= F.col("missing")))
    words, squares = F.col("size") * F.col("n"), (F.col("size") * F.col("size")).cast("decimal(38,0)") * F.col("n")
    larger = Window.partitionBy("name").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("name").orderBy(F.desc("size")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    taken = F.coalesce(F.sum(words).over(larger), F.lit(0))
    factor = (F.col("missing") - taken) / F.sum(squares).over(rest).cast("double")
    judged = fits.withColumn("factor", factor).withColumn("sure", F.col("factor") * F.col("size") >= 1)
    return judged.groupBy("name").agg(
        F.min(F.when(F.col("sure"), F.col("size"))).alias("certain"),
        F.max(F.when(~F.col("sure"), F.struct("size", "factor")))["factor"].alias("factor"),
        F.sum(F.when(F.col("sure"), words).otherwise(0)).alias("certain_words"),
        F.sum(words).alias("fit_words"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: str = ":mix",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    Sources, by code point with null last, have the given weights in turn and
    share ``share`` times all words; a target stops at ``most`` times its
    source. A source that is taken ``t`` times on average gives ``floor(t)``
    whole copies of every document. The rest of its words come from a Pareto
    order sample: every document has a chance in proportion to its size, which
    is certain for the largest that fit, and documents are taken by their random
    odds over their inclusion odds until the words are nearest to what is
    missing. As large documents are certain, the last one taken is small. A
    document larger than what is missing is passed over; if all that fit are
    not enough, the smallest such document is taken where that comes nearer.

    The random number comes from the id, so reruns agree. Null and wordless
    texts have size 0 and add nothing. Rows of one id share their number and
    stand side by side in the order; equal rows are interchangeable. A null
    source is a source. Columns in ``carry`` are passed on; their names must not
    be those of the columns above.

    Of a source with any number of documents one row goes into the plan: where
    its chances come from and which of ``RANGES`` ranges of the rank the sample
    ends in. Only the documents of that range are put in order.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).cast("string").alias("source"),
        words.alias("size"),
        uniform(key, seed).alias("u"),
        *(F.col(c).alias(f"_carry{k}") for k, c in enumerate(carry)),
    )
    rows = written(rows, "mix-rows")
    sizes = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    sources = _numbered(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    targets = _targets(sources, weights, share, most)

    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("name")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    missing = F.col("target") - F.col("whole") * F.col("source_size")
    known = targets.withColumn("whole", whole.cast("long")).select(name, "source_size", "target", "whole", missing.alias("missing"))
    chances = _chances(sizes.select(name, "size", "n"), known.select("name", "missing"))
    known = written(known.join(chances, "name", "left"), "mix-known")

    # ranks of the documents that are neither certain nor too large
    drawn = (F.col("size") > 0) & (F.col("size") <= F.col("missing")) & (F.col("size") < F.coalesce("certain", F.col("size") + 1))
    chance = F.col("factor") * F.col("size")
    odds = (F.col("u") / (1 - F.col("u"))) / (chance / (1 - chance))
    place = F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * RANGES), F.lit(RANGES - 1)).cast("int")
    ranked = rows.withColumn("name", name).join(known, "name")
    ranked = ranked.withColumn("rank", F.when(drawn, odds)).withColumn("range", F.when(drawn, place))
    ranges = ranked.where("range is not null").groupBy("name", "range").agg(F.sum("size").alias("words"))
    in_order = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("certain_words") + F.coalesce(F.sum("words").over(in_order), F.lit(0))
    summed = ranges.join(known, "name").withColumn("before", before)
    ends = summed.where(F.col("before") + F.col("words") > F.col("missing")).groupBy("name").agg(
        F.min(F.struct("range", "before")).alias("end")
    )
    too_large = ranked.where((F.col("missing") > 0) & (F.col("size") > F.col("missing")))
    smallest = too_large.groupBy("name").agg(F.min(F.struct("size", "_id")).alias("next"))
    cuts = written(known.select("name").join(ends, "name", "left").join(smallest, "name", "left"), "mix-cuts")

    judged = ranked.join(cuts, "name")
    end = F.coalesce(F.col("end.range"), F.lit(RANGES))
    nearer = F.coalesce("fit_words", F.lit(0)) + F.col("size") / 2 <= F.col("missing")
    is_next = (F.col("size") > F.col("missing")) & (F.col("size") == F.col("next.size")) & F.col("_id").eqNullSafe(F.col("next._id"))
    ordered = ((F.col("range") == end) | ((F.col("missing") > 0) & is_next & nearer)) & (F.col("missing") > 0)
    sure = (F.col("size") > 0) & (F.col("size") <= F.col("missing")) & (F.col("size") >= F.col("certain"))
    judged = judged.withColumn("ordered", F.coalesce(ordered, F.lit(False)))
    plain = judged.where("not ordered").withColumn("more", F.coalesce(sure, F.lit(False)) | F.coalesce(F.col("range") < end, F.lit(False)))
    # of equal rows that are too large one is taken; in the last range those before the end
    inside = Window.partitionBy("name").orderBy("rank", "_id", "size")
    reached = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("size") / 2
    cut = judged.where("ordered").withColumn(
        "more",
        F.when(F.col("rank").isNull(), F.row_number().over(inside) == 1).otherwise(F.col("end.before") + reached <= F.col("missing")),
    )
    copies = F.col("whole") + F.col("more").cast("long")
    return plain.unionByName(cut).withColumn("copies", copies).select(
        F.col("_id").alias(id_col),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        *(F.col(f"_carry{k}").alias(c) for k, c in enumerate(carry)),
    )


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy: str = "copy", **options
) -> DataFrame:
    """Input rows as often as the mix takes them, numbered by ``copy`` from 1; rows not taken are gone.

    Input columns may have any name; one called ``copy`` is replaced.
    """
    docs = docs.drop(copy)
    key, least, every, rows, number, copies = unused([*docs.columns, copy], "_key", "_least", "_all", "_rows", "_row", "_copies")
    keyed = docs.withColumn(key, row_key(docs, id_col, text_col, source_col))
    mixed = mix(keyed, id_col=id_col, source_col=source_col, text_col=text_col, carry=(key,), **options)
    taken = mixed.groupBy(key).agg(
        F.min("copies").alias(least), F.sum("copies").alias(every), F.count(F.lit(1)).alias(rows)
    )
    row = F.row_number().over(Window.partitionBy(key).orderBy(key))
    met = keyed.join(taken.where(F.col(every) > 0), key).withColumn(number, row)
    more = (F.col(number) <= F.col(every) - F.col(least) * F.col(rows)).cast("long")
    counted = met.withColumn(copies, F.col(least) + more).where(F.col(copies) > 0)
    return counted.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copy))
