"""The training-data pipeline: five stages, each one operator of ``riskweave.llm`` over all that the stage
before kept. ``run`` writes each stage's result as Parquet below ``spark.checkpoint.dir`` and reads it back
as the documents of the next.

A stage takes (spark, docs, sf_dir) and returns the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import op01_mixing, op02_neardup, op03_pii, op05_langid, op10_packing
from riskweave.llm.shared import stored
from riskweave.sources.tables import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus, with ``lang`` as identified from the text. Texts without a
    letter go; all others stay, as ``und`` if no document has a label to learn from."""
    model = op05_langid.fit(docs, order_by=F.xxhash64("doc_id"))
    tagged = op05_langid.tag(docs.select(*COLUMNS), model, keep=COLUMNS)
    named = F.col("lang_pred") != op05_langid.UNKNOWN if model.langs else F.col("text").rlike(r"\p{L}")
    return tagged.where(named).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest id."""
    return op02_neardup.keep_one(docs.select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets, ``n_chars`` counted anew."""
    return op03_pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times (0 to 2) as the mix to target weights takes it."""
    return op01_mixing.repeat(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that fill sequences of at most 4096 tokens."""
    return op10_packing.sequences(docs, TOKENIZER)


STAGES = [("language_id", identify_language), ("near_duplicates", drop_near_duplicates), ("personal_data", redact_personal_data),
          ("mixing", mix_sources), ("packing", pack_sequences)]

#: The signatures, the language model and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return stored(STAGES[-1][1](spark, docs, sf_dir), "stage-packing")
