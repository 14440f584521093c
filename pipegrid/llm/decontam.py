"""Benchmark decontamination by templates.

A text becomes a list of tokens: words, and numbers together with a unit behind them. The template of a token is ``#u``
for a number with a unit, ``#`` for a bare number, ``@`` for a capitalised word (a possible name), else the lower-case
word. Windows of ``WINDOW`` template tokens are hash-joined with those of the benchmark items, so that a question with
other numbers, names or units still meets its original. The values behind the placeholders are the slots: over one
alignment (same difference of positions) each value of the item must stand for one value of the document and the other
way round. Alignments that break this rule count only with windows whose slots are the same on both sides.

An item is also entered in lower case, without name placeholders, which finds copies that lost or changed their case.
Windows of the item with fewer than ``LITERALS`` plain words are no evidence and are left out; an item of fewer tokens
than a window is one window of its own length. A document is contaminated by an item if one alignment covers at
least ``COVERAGE`` of the item's windows or ``RUN`` of them (thirteen tokens).

Items with equal templates are all reported. Nulls and texts without tokens match nothing. Rows with the same id are
one document in the report; :func:`decontaminate` decides by row. Windows are only shuffled if the benchmark has
more than ``BROADCAST_ROWS`` windows; below that counted bound its window table is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipegrid.llm.common import row_key
from pipegrid.session import cut_lineage

WINDOW = 8
LITERALS = 4
COVERAGE = 0.6
RUN = 6
BROADCAST_ROWS = 200_000  #: of about 30 bytes each

# Units that may follow a number.
UNITS = "km cm mm m kg mg g lb lbs oz ml l s sec seconds min minutes h hours days weeks months years miles feet inches pounds dollars euros cents percent degrees mph kmh % $ € £ °"

_TOKEN = r"[0-9]+(?:[.,:/][0-9]+)*(?: ?(?:%|€|£|\$|°|(?:" + "|".join(u for u in UNITS.split() if u.isalpha()) + r")(?![\p{L}\p{N}])))?|[\p{L}\p{M}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))


def template(found: Column, names: bool = True) -> Column:
    """The template of a token list. Without ``names``, capitalised words are plain words."""

    def one(token):
        plain = F.lower(token)
        number = F.when(F.rlike(token, F.lit(r"[\p{L}%€£$°]$")), "#u").otherwise("#")
        first = F.substring(token, 1, 1)
        if names:  # a capital first letter, and a second one that is not
            second = F.substring(token, 2, 1)
            plain = F.when((first != F.substring(plain, 1, 1)) & (second != "") & (second == F.substring(plain, 2, 1)), "@").otherwise(plain)
        return F.when(first.between("0", "9"), number).otherwise(plain)

    return F.transform(found, one)


def _windows(shape: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` tokens; empty if there are fewer tokens."""
    starts = F.sequence(F.lit(1), F.size(shape) - size + 1)
    return F.when(F.size(shape) >= size, F.transform(starts, lambda i: F.xxhash64(F.lit(size), F.slice(shape, i, size)))).otherwise(F.array().cast("array<bigint>"))


def _slots(found: Column, shape: Column) -> Column:
    """The lower-case values behind a window's placeholders, in order."""
    marked = F.arrays_zip(shape.alias("shape"), found.alias("found"))
    return F.transform(F.filter(marked, lambda x: x["shape"].isin("#", "#u", "@")), lambda x: F.lower(x["found"]))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, form, at, hash, size, slots, windows): the evidence windows of items in both forms.

    ``windows`` is the number of an item's evidence windows in that form.
    """
    cut = benchmark.select("item_id", tokens(F.col("text")).alias("found")).distinct()
    cut = cut.withColumn("forms", F.array(F.struct(F.lit(0).alias("form"), template(F.col("found")).alias("shape")), F.struct(F.lit(1).alias("form"), template(F.col("found"), names=False).alias("shape"))))
    forms = cut.select("item_id", "found", F.explode("forms").alias("f")).select("item_id", "found", "f.*").filter(F.size("shape") > 0)
    size = F.least(F.size("shape"), F.lit(WINDOW))
    at = forms.select("item_id", "form", "found", "shape", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("shape") - size + 1)).alias("at"))
    part = F.slice("shape", F.col("at"), F.col("size"))
    plain = F.size(F.filter(part, lambda t: ~t.isin("#", "#u", "@")))
    kept = at.withColumn("part", part).filter((plain >= LITERALS) | ((F.col("size") < WINDOW) & (plain > 0)))
    rows = kept.select("item_id", "form", "at", "size", F.xxhash64("size", "part").alias("hash"), _slots(F.slice("found", F.col("at"), F.col("size")), F.col("part")).alias("slots"))
    counts = rows.groupBy("item_id", "form").agg(F.count("*").alias("windows"))
    return rows.join(counts, ["item_id", "form"])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, doc_id, item_id, matched, windows, coverage, first_token, consistent) of contaminated documents.

    One row per row key and item: its best alignment. ``docs`` has doc_id and text.
    """
    items = cut_lineage(item_windows(benchmark))
    facts = items.agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("size") < WINDOW, F.col("size"))).alias("short")).first()
    hashes = items.groupBy("hash").agg(F.collect_list(F.struct("item_id", "form", "at", "size", "slots", "windows")).alias("entries"))
    if facts.n <= BROADCAST_ROWS:
        hashes = F.broadcast(hashes)
    cut = docs.select("doc_id", row_key().alias("row"), tokens(F.col("text")).alias("found"))
    cut = cut.withColumn("shape", template(F.col("found")))
    hits = None
    for size in [WINDOW, *sorted(facts.short)]:
        at = cut.select("row", "doc_id", "found", "shape", F.posexplode(_windows(F.col("shape"), size)).alias("pos", "hash"))
        met = at.join(hashes, "hash").select(
            "row", "doc_id", F.col("pos").alias("first"), _slots(F.slice("found", F.col("pos") + 1, size), F.slice("shape", F.col("pos") + 1, size)).alias("values"), "entries"
        )
        hits = met if hits is None else hits.unionByName(met)
    hits = hits.select("row", "doc_id", "first", "values", F.explode("entries").alias("e")).select("row", "doc_id", "first", "values", "e.*")
    # The lower-case form has fewer placeholders: its slots are the numbers alone, on both sides.
    pairs = F.arrays_zip(F.col("slots").alias("item"), F.col("values").alias("doc"))
    same = F.col("slots") == F.col("values")
    aligned = hits.groupBy("row", "doc_id", "item_id", "form", (F.col("first") - F.col("at")).alias("shift")).agg(
        F.count("*").alias("all"),
        F.sum(same.cast("int")).alias("same"),
        F.min("first").alias("first_token"),
        F.max("windows").alias("windows"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
    )
    distinct = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    consistent = (distinct("item") == F.size("pairs")) & (distinct("doc") == F.size("pairs"))
    judged = aligned.withColumn("consistent", consistent).withColumn("matched", F.when(F.col("consistent"), F.col("all")).otherwise(F.col("same")))
    judged = judged.withColumn("coverage", F.col("matched") / F.col("windows"))
    found = judged.filter((F.col("coverage") >= COVERAGE) | (F.col("matched") >= RUN))
    best = F.struct("coverage", "matched", -F.col("form"), -F.col("first_token"))
    return found.groupBy("row", "doc_id", "item_id").agg(
        *[F.max_by(c, best).alias(c) for c in ("matched", "windows", "coverage", "first_token", "consistent")]
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item."""
    found = matches(docs, benchmark)
    best = F.struct("coverage", "matched", -F.col("first_token"))
    columns = ("matched", "windows", "coverage", "first_token", "consistent")
    return found.groupBy("doc_id", "item_id").agg(*[F.max_by(c, best).alias(c) for c in columns])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without its contaminated rows, all columns kept."""
    bad = matches(docs.select("doc_id", "text"), benchmark).select("row").distinct()
    return docs.select(row_key().alias("row"), F.struct("*").alias("doc")).join(bad, "row", "left_anti").select("doc.*")
