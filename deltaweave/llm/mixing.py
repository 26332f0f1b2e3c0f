"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

Every source gets a target amount of words. A document's expected number of copies is its source's
target divided by the source's size (times a preference, if given). The whole part of it is taken for
certain. The rest is its inclusion probability p: documents are ranked, within their source, by
``(u / (1 - u)) / (p / (1 - p))`` with u random in (0, 1), and taken in that order until the words of the
sample reach the sum of p times size. That is a Pareto sample of fixed size in words.

Scale: documents are never sorted as a whole. The rank is cut into buckets of about ``BUCKET_ROWS`` rows,
words are summed per source and bucket before the shuffle, and only the one bucket of each source in which
the sample ends is ordered row by row. What comes out is a cutoff per source, which is joined to the
documents, so a hot source is neither shuffled whole nor sorted in one task.

Nulls: a null text has size 0, a null source is a source of its own (last in order). A document's draw comes from its
id. Where ids repeat or are null, all rows are numbered, and the draw comes from id and number: every row then has a
draw of its own, and a rerun over the same files repeats it. Repeated rows are documents each. No documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deltaweave.llm.staging import before, stage

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 1000
DRAW = 2.0**52


def word_count(text: str | Column) -> Column:
    """Words of the whole text; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(DRAW)


def source_targets(per_source: DataFrame, source: str, size: str, weights: list[float], share: float, most: float) -> DataFrame:
    """Add ``target`` to one row per source: ``share`` of all sizes dealt by weight, none above ``most`` times
    its own size, what is above dealt again by weight.

    The level at which the dealing ends comes from sorting sources by the level at which each is full. The
    windows see one row per source, already summed.
    """
    order = Window.orderBy(F.col(source).isNull(), F.col(source))
    ranked = per_source.withColumn("_n", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_n") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", w).withColumn("_full", F.lit(float(most)) * F.col(size))
    by_level = Window.orderBy(F.col("_full") / F.col("_w"), "_n")
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum(size).over(everything) - F.coalesce(F.sum("_full").over(earlier), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))
    )
    ranked = ranked.withColumn("_level", level).withColumn("_open", F.col("_level") <= F.col("_full") / F.col("_w"))
    ranked = ranked.withColumn("_level", F.max(F.when(F.col("_open"), F.col("_level"))).over(everything))
    target = F.least(F.col("_full"), F.coalesce(F.col("_w") * F.col("_level"), F.col("_full")))
    return ranked.withColumn("target", target).drop("_n", "_w", "_full", "_level", "_open")


def sample(
    docs: DataFrame,
    size: Column | None = None,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    preference: Column | None = None,
    seed: int = 5,
) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` of every row of ``docs``; as ``mix``,
    which see, but without the other columns. Texts are read once."""
    return _sampled(docs, [F.col(f"`{doc_id}`").alias(doc_id)], size, doc_id, source, weights, share, most, preference, seed, again=False)


def mix(
    docs: DataFrame,
    size: Column | None = None,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    preference: Column | None = None,
    seed: int = 5,
) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` beside their own columns.

    ``weights`` repeat over the sources in code-point order, null last. A document's copies never exceed
    ``most``. With a ``preference``, its copies follow it within the source; a document whose share would pass
    ``most`` stays there. Own columns whose names clash with these five are replaced; all others stay as they are.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    return _sampled(docs, keep, size, doc_id, source, weights, share, most, preference, seed, again=True)


ADDED = ("size", "source_size", "target", "copies", "taken")


def _sampled(docs: DataFrame, keep: list[Column], size: Column | None, doc_id: str, source: str, weights: tuple[float, ...], share: float, most: float, preference: Column | None, seed: int, again: bool) -> DataFrame:
    """``keep`` and ``ADDED`` of every row. ``again``: read ``docs`` a second time for ``keep``, instead of writing it with
    the sizes. Own columns travel in one struct, so that none meets the columns made here."""
    ids = docs.select(F.col(f"`{doc_id}`").alias("_id")).groupBy("_id").count()
    unique = ids.where("_id is null or count > 1").isEmpty()
    name = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    if not unique and again:  # both readings have to see the same numbers
        row = "_row" + "_" * max(len(c) for c in docs.columns)  # no column has this name
        docs = stage(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
        name = F.concat(name, F.lit("#"), F.col(row).cast("string"))
    elif not unique:
        name = F.concat(name, F.lit("#"), F.monotonically_increasing_id().cast("string"))
    size = word_count("text") if size is None else size
    pref = F.lit(1.0) if preference is None else preference.cast("double")
    wide = docs.select(F.struct(*keep).alias("_own"), F.col(f"`{source}`").alias("_s"), size.alias("size"), pref.alias("_pref"), name.alias("_id")).withColumn("_u", draw(F.col("_id"), seed))
    narrow = stage(wide.drop("_own") if again else wide, "mix-sizes")
    sums = narrow.groupBy("_s").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"), F.sum(F.col("_pref") * F.col("size")).alias("_pref_size"))
    plan = source_targets(sums, "_s", "source_size", list(weights), share, most)
    plan = stage(plan.withColumn("_unit", F.when(F.col("_pref_size") > 0, F.col("target") / F.col("_pref_size")).otherwise(0.0)).withColumn("_n", F.ceil(F.col("_rows") / BUCKET_ROWS)), "mix-plan")

    def ranked(rows: DataFrame) -> DataFrame:
        """Add each row's certain copies and its bucket and place in the order of its source."""
        expected = F.col("_unit") if preference is None else F.least(F.lit(float(most)), F.col("_unit") * F.col("_pref"))
        rows = rows.withColumn("_e", expected).withColumn("_whole", F.floor("_e")).withColumn("_p", F.col("_e") - F.col("_whole"))
        odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
        rows = rows.withColumn("_q", F.when(F.col("_p") > 0, odds))
        return rows.withColumn("_b", F.least(F.floor(F.col("_q") / (1 + F.col("_q")) * F.col("_n")), F.col("_n") - 1))

    rows = narrow.drop("_own").join(plan.withColumnRenamed("_s", "_k"), F.col("_s").eqNullSafe(F.col("_k"))).drop("_k")
    rows = ranked(rows).where("_q is not null")
    budget = rows.groupBy("_s").agg(F.sum(F.col("_p") * F.col("size")).alias("_budget")) if preference is not None else plan.select("_s", ((F.col("_unit") - F.floor("_unit")) * F.col("source_size")).alias("_budget"))
    sofar = before(rows, "_b", {"_sofar": "size"}, ["_s"])
    at = sofar.join(budget.withColumnRenamed("_s", "_k"), F.col("_s").eqNullSafe(F.col("_k"))).where("_sofar <= _budget")
    last = stage(at.groupBy("_s").agg(F.max_by(F.struct("_b", "_sofar", "_budget"), "_b").alias("_x")).select("_s", "_x.*"), "mix-ends")
    ending = rows.join(last.select(F.col("_s").alias("_k"), F.col("_b").alias("_kb"), "_sofar", "_budget"), F.col("_s").eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    w = Window.partitionBy("_s").orderBy("_q", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ending = ending.withColumn("_upto", F.col("_sofar") + F.sum("size").over(w) - F.col("size") / 2).where("_upto <= _budget")
    cut = ending.groupBy("_s").agg(F.max(F.struct("_q", "_id")).alias("_cut"))
    cuts = last.select("_s", F.col("_b").alias("_end")).join(cut.withColumnRenamed("_s", "_k"), F.col("_s").eqNullSafe(F.col("_k")), "left").drop("_k")
    whole_plan = plan.join(cuts.withColumnRenamed("_s", "_k"), F.col("_s").eqNullSafe(F.col("_k")), "left").select(F.col("_s").alias("_ps"), "source_size", "target", "_unit", "_n", "_end", "_cut")
    whole_plan = stage(whole_plan, "mix-cuts")

    out = ranked((wide if again else narrow).join(whole_plan, F.col("_s").eqNullSafe(F.col("_ps"))))
    extra = F.col("_q").isNotNull() & ((F.col("_b") < F.col("_end")) | ((F.col("_b") == F.col("_end")) & (F.struct("_q", "_id") <= F.col("_cut"))))
    out = out.withColumn("copies", (F.col("_whole") + F.coalesce(extra.cast("long"), F.lit(0))).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("_own.*", *ADDED)
