"""The stages of the pipeline and run() against brute force on a small table with nulls; and on an empty one."""

import collections
import re

import pytest

import corpus_pipeline
from riskweave.llm import op01_mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
ROWS = [(1, LONG, "en", "a"), (2, LONG, "en", "b"), (3, LONG + " more", "en", "a"), (4, None, "en", "a"), (5, "12 !?", None, None),
        (6, "write to a.b@c.de soon, one two three", "en", "b"), (7, "", "en", "a"), (8, "uno dos tres " * 9, "es", None), (9, "one two three four " * 5, None, "b")]


@pytest.mark.parametrize("labels", [True, False])
def test_stages_and_run(spark, tmp_path, labels):
    import public_tokenizers
    from tokenizers import Tokenizer

    table = spark.createDataFrame([(i, t, x if labels else None, s, len(t or "")) for i, t, x, s in ROWS], SCHEMA)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    tagged = stage["language_id"](spark, table, "").collect()
    lettered = {i: t for i, t, *_ in ROWS if t and re.search("[a-z]", t)}
    assert {r.doc_id: r.text for r in tagged} == lettered and len(tagged) == len(lettered)
    assert all(r.lang in ("en", "es") if labels else r.lang == "und" for r in tagged)
    docs = spark.createDataFrame([tuple(r) for r in tagged], SCHEMA)
    kept = stage["near_duplicates"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 6, 8, 9]
    docs = spark.createDataFrame([tuple(r) for r in kept], SCHEMA)
    clean = {r.doc_id: r for r in stage["personal_data"](spark, docs, "").collect()}
    expected = {i: lettered[i].replace("a.b@c.de", "[EMAIL]") for i in (1, 6, 8, 9)}
    assert {i: (r.text, r.n_chars) for i, r in clean.items()} == {i: (t, len(t)) for i, t in expected.items()}
    docs = spark.createDataFrame([tuple(r) for r in clean.values()], SCHEMA)
    copies = {r.doc_id: r.copies for r in op01_mixing.mix(docs).collect()}
    mixed = collections.Counter(r.doc_id for r in stage["mixing"](spark, docs, "").collect())
    assert mixed == collections.Counter({i: n for i, n in copies.items() if n})
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    tokens = collections.Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        tokens[r.doc_id] += r.length
    assert tokens == {i: n * (len(tok.encode(expected[i], add_special_tokens=False).ids) + 1) for i, n in mixed.items()}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
