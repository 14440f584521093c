"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pipegrid.llm import alignment, chaining, decontam, htmltext, langid, lines, mixing, negatives, packing, simhash, spotsigs, sql, toxicity, warc
from pipegrid.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op7_simhash")
def op7(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


@query("op2_spotsigs")
def op2(spark, sf_dir):
    return spotsigs.fingerprint_edits(read(spark, sf_dir, "documents"))


@query("op1_decontamination")
def op1(spark, sf_dir):
    return decontam.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op4_pfair_mixing", sql.MIXING)
def op4(spark, sf_dir):
    return mixing.schedule(read(spark, sf_dir, "documents"))


@query("op10_language_id")
def op10(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


@query("op9_html_extraction")
def op9(spark, sf_dir):
    return htmltext.main_text(read(spark, sf_dir, "pages"))


@query("op6_warc", sql.WARC)
def op6(spark, sf_dir):
    found = warc.round_trip(read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_token_packing")
def op8(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


@query("op11_line_cleaning", sql.LINES)
def op11(spark, sf_dir):
    return lines.report(read(spark, sf_dir, "documents"))


@query("op12_token_alignment")
def op12(spark, sf_dir):
    return alignment.align(read(spark, sf_dir, "documents"))


@query("op13_hard_negatives", sql.NEGATIVES)
def op13(spark, sf_dir):
    return negatives.mine(read(spark, sf_dir, "embeddings"))


@query("op3_toxicity")
def op3(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


@query("op5_passages")
def op5(spark, sf_dir):
    return chaining.passages(read(spark, sf_dir, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
