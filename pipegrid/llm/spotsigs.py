"""SpotSigs: chains of content words behind common-word anchors, as a document's signature set.

Text is lower-cased and cut into words of letters and digits. Every common word (an anchor) opens a chain of the next
``CHAIN`` content words, further common words skipped, ``SKIP`` in a row at most. A signature is the 64-bit hash of
anchor and chain, and a document is the set of its signatures. A text without a chain has one signature, the hash of
its whole word sequence, so that equal texts always have equal sets and the set is never empty (null counts as empty).

Pairs: sets are parted by length, since sets whose lengths differ by more than the threshold allows can't reach it.
A set is looked up by its rarest-first prefix only, which any set near enough must share, and surviving pairs are
compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipegrid.llm.common import components
from pipegrid.session import cut_lineage

# The common words that serve as anchors, by language.
ANCHORS = {
    "en": "the a an of to and in is it that was for on with as at by be are this from or he she not have has had but which you they we his her its were been will would can their there",
    "de": "der die das und ist ein eine den dem des zu mit von auf für im nicht sich als auch es an werden aus er hat dass sie nach bei um am sind noch wie einem über",
    "fr": "le la les de des du et un une est que qui dans en pour par sur pas au aux avec ce il elle ne se son sa ses plus nous vous ou",
    "es": "el la los las de del y que en un una es por con para no se su al lo como más pero sus le ha me si sin sobre este",
}
CHAIN = 2  #: content words per signature
SKIP = 8  #: common words in a row that a chain steps over
BUCKET = 256  #: documents that are put in order together


def anchor_words() -> list[str]:
    return sorted(set(" ".join(ANCHORS.values()).split()))


def _anchor_pattern(words: list[str]) -> str:
    """An alternation that branches on the first letter."""
    by_letter: dict[str, list[str]] = {}
    for word in words:
        by_letter.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{letter}(?:{'|'.join(sorted(rest, reverse=True))})" for letter, rest in sorted(by_letter.items()))


def signatures(text: Column, chain: int = CHAIN, anchors: list[str] | None = None) -> Column:
    """The sorted set of a text's signatures, an array of longs with one entry at least."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "), F.lit(" "))
    marked = F.regexp_replace(words, f" ({_anchor_pattern(anchors or anchor_words())})(?= )", " +$1")
    content = rf"(?: \+\S++){{0,{SKIP}}}+ ([^+\s]\S*+)"
    found = F.regexp_replace(marked, rf"\+(\S++)(?={content * chain})", "\n" + "~".join(f"${k}" for k in range(1, chain + 2)) + "\t")
    chains = F.filter(F.split(found, "\n"), lambda s: F.contains(s, F.lit("\t")))
    hashed = F.transform(chains, lambda s: F.xxhash64(F.substring_index(s, "\t", 1)))
    return F.when(F.size(hashed) > 0, F.array_sort(F.array_distinct(hashed))).otherwise(F.array(F.xxhash64(words)))


def likeness(one: Column, other: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    both = F.size(F.array_intersect(one, other))
    return both / (F.size(one) + F.size(other) - both)


def digest(sigs: Column) -> Column:
    """The set's length and 128 bits of hash."""
    return F.format_string("%d-%016x%016x", F.size(sigs), F.xxhash64(sigs), F.xxhash64(F.lit("spots"), sigs))


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, jaccard): pairs of different signature sets, ``a`` and ``b`` being the digests of the sets.

    Every set whose likeness to another reaches ``threshold`` is found. Equal sets are one class and need no pair.
    """
    sets = docs.select(signatures(F.col("text")).alias("sigs")).distinct()
    sets = cut_lineage(sets.select(digest(F.col("sigs")).alias("set"), "sigs", F.size("sigs").alias("n")))
    entries = sets.select("set", F.explode("sigs").alias("sig"))
    counts = entries.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = entries.join(counts.filter("df > 1"), "sig").withColumn("part", F.pmod(F.xxhash64("set"), F.lit(1 << 30)))
    # A signature in no other set can't be shared: the prefix is taken over the rest, shortened by as many.
    order = F.array_sort(F.collect_list(F.struct("df", "sig")))
    kept = ranked.groupBy("set").agg(order.alias("rare")).join(sets, "set")
    length = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("rare"))
    prefixes = kept.filter(length > 0).select("set", "n", F.explode(F.slice("rare", F.lit(1), length.cast("int"))).alias("r"))
    prefixes = prefixes.select("set", "n", F.col("r.sig").alias("sig"))
    x, y = prefixes.alias("x"), prefixes.alias("y")
    reach = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.set") < F.col("y.set")))
    pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & reach & (F.col("x.n") >= F.lit(threshold) * F.col("y.n") - 1e-9))
    pairs = pairs.select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct()
    named = sets.select("set", "sigs")
    full = pairs.join(named.select(F.col("set").alias("a"), F.col("sigs").alias("left")), "a").join(named.select(F.col("set").alias("b"), F.col("sigs").alias("right")), "b")
    return full.select("a", "b", likeness(F.col("left"), F.col("right")).alias("jaccard")).filter(F.col("jaccard") >= threshold - 1e-12)


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, fingerprint, component): documents with the digest of their set and the least digest of their class."""
    linked = components(near_pairs(docs, threshold).select("a", "b")).withColumnRenamed("node", "fingerprint")
    marked = docs.select("doc_id", digest(signatures(F.col("text"))).alias("fingerprint"))
    return marked.join(linked, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))


def _in_order(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents in buckets of consecutive ids (descending, nulls last, ties by text), and the bucket after each.

    Only a few numbers about the ids come to the driver.
    """
    tied = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tied = tied.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("tie"))
    facts = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("doc_id").alias("n"), F.count("*").alias("rows")).first()
    place, first, last = F.lit(None).cast("long"), 0, 0
    if facts.n:
        width = min(max(1, (facts.hi - facts.lo + 1) * BUCKET // facts.n), 1 << 62)
        last = (facts.hi - facts.lo) // width + 1
        place = F.floor((F.lit(facts.hi).cast("decimal(20,0)") - F.col("doc_id")) / F.lit(width)).cast("long")
    if facts.n < facts.rows:  # rows without id follow, in buckets by their hash
        if not facts.n:
            first = tied.agg(F.min(F.shiftright("tie", 51)).alias("least")).first().least
        place = F.coalesce(place, F.lit(last) + F.shiftright("tie", 51))
    placed = tied.select(place.alias("bucket"), "doc_id", "tie", "text").repartition("bucket")
    used = tied.select(place.alias("bucket")).distinct().withColumn("block", F.floor(F.col("bucket") / 4096))
    blocks = used.groupBy("block").agg(F.min("bucket").alias("head")).withColumn("next_head", F.lead("head").over(W.orderBy("block")))
    after = used.withColumn("near", F.lead("bucket").over(W.partitionBy("block").orderBy("bucket"))).join(blocks, "block")
    return placed, after.select("bucket", F.coalesce("near", "next_head", F.lit(first)).alias("next_bucket"))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Every document beside its edited text and the next document, in descending order of id.

    doc_id, text, next_text, sigs, next_sigs, edited. The edited text ends in as much of the next document as it loses
    of its own second half. The document after the last is the first. Nulls are empty texts; null ids come last,
    ordered like rows with equal ids by a hash of their text. Texts are shuffled once, in buckets of ``BUCKET`` ids.
    """
    placed, after = _in_order(docs)
    order = W.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "tie")
    inside = (
        placed.withColumn("sigs", signatures(F.col("text")))
        .withColumn("next", F.lead(F.struct("text", "sigs")).over(order))
        .filter("next is not null")
        .select("doc_id", "text", "sigs", F.col("next.text").alias("next_text"), F.col("next.sigs").alias("next_sigs"))
    )
    ranked = placed.withColumn("rank", F.row_number().over(order)).withColumn("more", F.lead(F.lit(1)).over(order))
    heads = ranked.filter("rank = 1").select(F.col("bucket").alias("next_bucket"), F.col("text").alias("next_text"))
    edge = (
        ranked.filter("more is null")
        .select("bucket", "doc_id", "text")
        .join(after, "bucket")
        .join(heads, "next_bucket")
        .select("doc_id", "text", signatures(F.col("text")).alias("sigs"), "next_text", signatures(F.col("next_text")).alias("next_sigs"))
    )
    both = inside.unionByName(edge)
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("next_text"), F.lit(1), half))
    return both.withColumn("edited", edited)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The fingerprints of texts and edited texts with their likenesses, one row per document."""
    compared = compare_with_next(docs).withColumn("edited_sigs", signatures(F.col("edited")))
    sigs, other = F.col("sigs"), F.col("edited_sigs")
    return compared.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(sigs).alias("fingerprint"),
        digest(other).alias("edited_fingerprint"),
        likeness(sigs, other).alias("near_edited"),
        likeness(sigs, F.col("next_sigs")).alias("near_next"),
    )
