"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a seeded hash order, are cut into blocks of ``BLOCK_CHARS`` characters; a block holds the
documents that begin in it. Block j of a source of weight w may run from slot floor((j - 1) / w) and must have run
before slot ceil(j / w); earliest deadline first then gives every slot one block, and at any time a source has had
less than one block more or less than its weight asks for. Weights are rounded to ``PERIOD``-ths (every positive one
gets a part at least), so the schedule repeats after ``PERIOD`` slots: only one period is worked out, by a fold over
slots in a single row whose size is that of the weights, not of the data. A block then finds its slot by a join.

Slots of a source that has run out stay empty, and the others go on in their proportions. No document is dropped.
Without given weights, a source's weight is its share of characters to the power ``ALPHA``.

A null source is a source of its own. A null, missing or negative n_chars counts 0: the document joins the block that
begins there. Rows with equal ids are ordered by id alone and share what their order decides. Sources without a
positive weight follow after all others. An empty table has an empty schedule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipegrid.session import cut_lineage

BLOCK_CHARS = 65_536
PERIOD = 2_000
ALPHA = 0.5
SEED = 42
PARTS = 4096  #: hash ranges a source is cut into, so that no source is ordered in one task


def _masses(docs: DataFrame) -> DataFrame:
    """Rows with source, mass, order hash and hash range."""
    mass = F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(0)).cast("long")
    key = F.md5(F.concat_ws(":", F.lit(f"mix{SEED}"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("n"), F.col("n_chars").cast("string")))))
    keyed = docs.withColumns({"source": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "mass": mass, "key": key})
    return keyed.withColumn("part", F.substring("key", 1, 3))


def default_weights(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(source, weight): characters to the power alpha, to be normalised."""
    mass = F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(0))
    return docs.groupBy("source").agg(F.pow(F.sum(mass).cast("double"), F.lit(alpha)).alias("weight"))


def quotas(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, quota, period): whole shares of the period by largest remainder, one for each source at least.

    The period grows if there are more sources than half of it.
    """
    good = weights.filter("weight > 0").select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"), "weight")
    good = good.groupBy("source").agg(F.sum("weight").alias("weight"))
    everything = W.partitionBy()
    sized = good.withColumns({"n": F.count("*").over(everything), "total": F.sum("weight").over(everything)})
    sized = sized.withColumn("period", F.greatest(F.lit(period), 2 * F.col("n")).cast("long"))
    # one slot each beforehand, the rest in proportion
    share = sized.withColumn("exact", F.col("weight") / F.col("total") * (F.col("period") - F.col("n")))
    share = share.withColumn("whole", F.floor(F.round("exact", 9))).withColumn("left", F.round(F.col("exact") - F.col("whole"), 9))
    rank = F.row_number().over(everything.orderBy(F.desc("left"), "source"))
    spare = F.col("period") - F.col("n") - F.sum("whole").over(everything)
    return share.withColumn("quota", 1 + F.col("whole") + (rank <= spare).cast("long")).select("source", F.col("quota").cast("long"), "period")


def period_slots(shares: DataFrame) -> DataFrame:
    """(source, quota, period, turn, slot): the slots of one period, earliest deadline first among released blocks.

    Ties go to the source that is first by name. The fold runs in one row with an entry per source.
    """
    one = shares.groupBy("period").agg(F.array_sort(F.collect_list(F.struct("source", "quota"))).alias("s"))
    step = (
        "aggregate(sequence(0, cast(period as int) - 1), "
        "named_struct('had', transform(s, x -> 0L), 'picks', cast(array() as array<int>)), "
        "(state, t) -> transform(array(array_min(filter(transform(s, (x, i) -> named_struct('deadline', "
        "if(state.had[i] < x.quota and state.had[i] * period div x.quota <= t, ((state.had[i] + 1) * period + x.quota - 1) div x.quota, cast(null as bigint)), 'i', i)), "
        "y -> y.deadline is not null)).i), "
        "pick -> named_struct('had', transform(state.had, (h, i) -> if(i = pick, h + 1, h)), 'picks', array_append(state.picks, pick)))[0], "
        "state -> state.picks)"
    )
    picked = one.select("period", "s", F.posexplode(F.expr(step)).alias("slot", "pick"))
    named = picked.select("period", F.col("slot").cast("long").alias("slot"), F.col("s")[F.col("pick")].alias("x")).select("period", "slot", "x.*")
    return named.withColumn("turn", F.row_number().over(W.partitionBy("source").orderBy("slot")).cast("long") - 1)


def _before(parts: DataFrame) -> DataFrame:
    """(source, part, before): mass of a source in earlier hash ranges. A source has PARTS rows at most."""
    ahead = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return parts.select("source", "part", F.coalesce(F.sum("mass").over(ahead), F.lit(0)).alias("before"))


def _blocks(masses: DataFrame, block: int) -> DataFrame:
    """The rows with their block number within the source."""
    parts = masses.groupBy("source", "part").agg(F.sum("mass").alias("mass"))
    begin = W.partitionBy("source", "part").orderBy("key").rangeBetween(W.unboundedPreceding, W.currentRow)
    run = masses.withColumn("upto", F.sum("mass").over(begin)).withColumn("same", F.sum("mass").over(W.partitionBy("source", "part", "key")))
    placed = run.join(_before(parts), ["source", "part"])
    start = F.col("before") + F.col("upto") - F.col("same")
    return placed.withColumn("block", F.floor(start / block).cast("long")).drop("before", "upto", "same")


def _slotted(blocks: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows with the slot of their block; sources without weight have the last slot of all."""
    shares = quotas(weights)
    plan = cut_lineage(period_slots(shares))
    size = shares.select("source", F.col("quota").alias("q")).distinct()
    turned = blocks.join(F.broadcast(size), "source", "left") if _few(size) else blocks.join(size, "source", "left")
    turned = turned.withColumn("turn", F.col("block") % F.col("q"))
    slots = plan.select("source", "turn", F.col("slot").alias("at"), "period")
    slots = F.broadcast(slots) if _few(slots) else slots
    slot = F.floor(F.col("block") / F.col("q")) * F.col("period") + F.col("at")
    return turned.join(slots, ["source", "turn"], "left").withColumn("slot", F.coalesce(slot, F.lit((1 << 62)))).drop("q", "turn", "at", "period")


def _few(table: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table of weights is small enough to broadcast."""
    return table.limit(rows + 1).count() <= rows


def schedule(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, source, n_chars, block, slot, position): where each document stands in the mixture.

    ``position`` counts documents from 1 by slot and, within a slot, by the seeded order.
    """
    narrow = docs.select("doc_id", "source", "n_chars")
    masses = _masses(narrow.withColumn("name", F.col("source")))
    placed = cut_lineage(_slotted(_blocks(masses, block), weights if weights is not None else default_weights(narrow)))
    per_slot = placed.groupBy("slot").agg(F.count("*").alias("n")).withColumn("super", F.floor(F.col("slot") / 4096))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    supers = per_slot.groupBy("super").agg(F.sum("n").alias("n")).select("super", ahead(W.orderBy("super")).alias("base"))
    starts = per_slot.withColumn("within", ahead(W.partitionBy("super").orderBy("slot"))).join(supers, "super").select("slot", (F.col("base") + F.col("within")).alias("start"))
    rank = F.row_number().over(W.partitionBy("slot", "source").orderBy("key", "n_chars"))
    ranked = placed.withColumn("rank", rank).join(starts, "slot")
    return ranked.select("doc_id", F.col("name").alias("source"), "n_chars", "block", F.when(F.col("slot") < (1 << 62), F.col("slot")).alias("slot"), (F.col("start") + F.col("rank")).alias("position"))


def _mixed(docs: DataFrame, weights: DataFrame | None, block: int) -> DataFrame:
    """(doc, slot, ...) of all rows, in the order of the mixture across and within partitions."""
    packed = docs.select("doc_id", "source", "n_chars", F.struct("*").alias("doc"))
    slotted = _slotted(_blocks(_masses(packed), block), weights if weights is not None else default_weights(docs))
    return slotted.repartitionByRange(F.col("slot"), F.col("key")).sortWithinPartitions("slot", "key")


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK_CHARS) -> DataFrame:
    """All rows and columns of ``docs``, sorted into the order of the mixture across and within partitions."""
    return _mixed(docs, weights, block).select("doc.*")


def texts_with_slots(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, text, slot) in that order, for steps that follow it; files that are read again don't keep it."""
    return _mixed(docs, weights, block).select("doc.doc_id", "doc.text", F.when(F.col("slot") < (1 << 62), F.col("slot")).alias("slot"))
