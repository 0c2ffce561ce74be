"""The operators applied with production parameters to their whole tables, and the SQL that checks
those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import (op01_mixing, op02_neardup, op03_pii, op04_repeats, op05_langid, op06_topk, op07_warc, op08_main_text,
                           op09_fingerprint, op11_fim, op12_trie, op13_tokenids)
from riskweave.llm import op10_packing as packing
from riskweave.llm.sql import ORACLES
from riskweave.sources.tables import read_table

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = op01_mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_neardup.classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op03_pii.find(read_table(spark, sf_dir, "documents"))

    def written(kind: str):
        return F.transform(F.col(kind), lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))

    def every(kind: str):
        extra = F.transform(F.filter("extra", lambda e: e["kind"] == kind), lambda e: F.struct(e["start"], e["end"]))
        own = F.transform(F.col(kind), lambda m: F.struct(m["start"], m["end"]))
        return F.transform(F.array_sort(F.concat(own, extra)), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    kinds = op03_pii.KINDS
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
                        F.sha2(F.array_join(F.concat(*map(written, kinds)), ","), 256).alias("base_sha256"),
                        F.array_join(F.concat(*map(every, kinds)), ",").alias("spans"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_repeats.strip_repeats(read_table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = op05_langid.fit(docs.where(~F.coalesce(held_out, F.lit(False))), order_by=F.xxhash64("doc_id"))
    tagged = op05_langid.tag(docs, model, keep=("doc_id",))
    return tagged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = op07_warc.archives(read_table(spark, sf_dir, "pages"))
    return op07_warc.read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_main_text.extract(read_table(spark, sf_dir, "pages"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = op09_fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))
    return marks.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = op11_fim.transform(read_table(spark, sf_dir, "documents"))
    return op11_fim.restore(outputs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_trie.trie(read_table(spark, sf_dir, "conversations"))


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_tokenids.read(op13_tokenids.write(read_table(spark, sf_dir, "documents"), BYTE_TOKENIZER))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_mixing, op2_neardup, op3_pii, op4_repeats, op5_langid, op6_topk, op7_warc, op8_main_text, op9_fingerprint, op10_packing,
    op11_fill_in_middle, op12_prefix_trie, op13_token_ids, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
