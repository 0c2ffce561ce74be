"""Cases in which earlier forms of the operators were wrong, and the thin queries against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from riskweave.llm import op02_neardup, op03_pii, op05_langid, op06_topk, queries
from pyspark.sql import functions as F

RNG = random.Random(8)


def test_equal_vectors_of_repeated_ids(spark):
    made = [(50, [1.0, 2.0])] * 7 + [(60, [1.0, 2.0]), (61, [1.0, 2.0]), (61, [1.0, 2.0])]
    got = op06_topk.top_k(spark.createDataFrame(made, "vec_id long, embedding array<double>"), F.col("vec_id") == 50, k=2).collect()
    score = 256 * 256 + 512 * 512
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(50, 1, 60, score), (50, 2, 61, score)]


def test_top_k_on_many_repeats_equals_brute_force(spark):
    points = [[float(RNG.randint(-2, 2)), float(RNG.randint(-2, 2))] for _ in range(4)]
    made = [(RNG.randint(0, 6) * 10, RNG.choice(points)) for _ in range(120)]
    got = op06_topk.top_k(spark.createDataFrame(made, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3, shard=16)
    want = set()
    for q, v in {(q, tuple(v)) for q, v in made if q % 20 == 0}:
        want |= {(q, v)}
    best = collections.defaultdict(list)
    for q, v in want:
        best[q] += [(-int(np.dot(np.array(v) * 256, np.array(c) * 256)), x) for x, c in made if x != q]
    expected = {(q, i + 1, x, -s) for q, rows in best.items() for i, (s, x) in enumerate(sorted(rows)[:3])}
    assert {tuple(r) for r in got.collect()} == expected


@pytest.mark.parametrize("batch", [7, 10_000])
def test_top_k_with_a_hot_id_and_a_hot_vector(spark, batch):
    """A third of the rows has one id, a third one vector; batches end anywhere in a shard."""
    def vector():
        return [float(RNG.randint(-3, 3)) for _ in range(3)]

    made = [(20, vector()) for _ in range(100)] + [(1000 + i, [1.0, 2.0, 3.0]) for i in range(100)] + [(i, vector()) for i in range(100)]
    made += [(i, [float(i % 5), 1.0]) for i in range(0, 60, 10)]
    table = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {tuple(r) for r in op06_topk.top_k(table, F.col("vec_id") % 20 == 0, k=4, shard=32).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = collections.defaultdict(list)
    for q, v in {(q, tuple(v)) for q, v in made if q % 20 == 0}:
        best[q] += [(-int(np.dot(np.array(v) * 256, np.array(c) * 256)), x) for x, c in made if x != q and len(c) == len(v)]
    assert got == {(q, i + 1, x, -s) for q, rows in best.items() for i, (s, x) in enumerate(sorted(rows)[:4])}


def test_a_band_key_is_made_of_the_bits_of_the_signature():
    import pyarrow as pa

    words = "abc def ghi jkl mno pqr stu vwx yza bcd".split()
    texts = [" ".join(RNG.choices(words, k=n)) for n in [40] * 30 + [5, 3, 0]]
    texts += [t + " tail" for t in texts] + [texts[0]]
    batch = pa.RecordBatch.from_arrays([pa.array([bytes([i]) for i in range(len(texts))]), pa.array(texts)], ["node", "text"])
    rows = [r for out in op02_neardup._bands(5, 28, 5)([batch]) for r in out.to_pylist()]
    signs = np.array([np.frombuffer(r["signature"], np.uint16).reshape(28, 5) for r in rows])
    keys = np.array([r["keys"] for r in rows])
    assert len(rows) == len(texts) - 1                          # the empty text has no signature
    assert ((signs[:, None] == signs[None]).all(axis=3) == (keys[:, None] == keys[None])).all()


def test_scores_past_64_bits_are_an_error(spark):
    with pytest.raises(ValueError):
        op06_topk.top_k(spark.createDataFrame([(50, [3e7, 4e7]), (1, [3e7, 4e7])], "vec_id long, embedding array<double>"), F.col("vec_id") == 50)


def test_every_labelled_language_is_in_the_model(spark):
    rows = [(i, "aa bb cc aa", "xx") for i in range(5)] + [(9, "zed zulu", "zz")]
    model = op05_langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["xx", "zz"]
    score = op05_langid.Scorer(model)
    assert score("zed")[0] == "zz" and score("aa bb")[0] == "xx" and score("zulu zed aa")[0] == "zz"


def test_many_languages(spark):
    rows = [(i, f"w{c * 3} {c}{chr(97 + i % 26)}x shared", f"l{i:04d}") for i in range(1200) for c in [chr(97 + i // 26 % 26) + chr(97 + i // 676) + chr(97 + i % 26)]]
    model = op05_langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 1200
    score = op05_langid.Scorer(model)
    assert sum(score(text)[0] == lang for _, text, lang in rows[::40]) >= 29
    small = op05_langid.Model(["a", "b"], [("a", 0, "x", 3), ("b", 0, "x", 1), ("b", 1, "y", 2)])
    sparse = [small.mixed([r], np.ones(1)) for r in range(2)]
    assert np.allclose(sparse, [small.ready().mixed([r], np.ones(1)) for r in range(2)])


def test_redaction_by_place(spark):
    seeds = [(i, f"please write to contact: user{i}x@host{i}.org today") for i in range(12)]
    other = [(100, "please write to contact: bob@inner circle and crabbob@inner circle"), (101, None), (102, ""),
             (103, "x" * 9000 + " mail ann@host.org and 10.0.0.1 " + "é" * 5000 + " +1 (523) 555-1055 end")]
    table = spark.createDataFrame([(*r, "a", 1, 2.0) for r in seeds + other], "doc_id long, text string, `d_` string, `t_` int, extra double")
    out = op03_pii.redact(table)
    assert out.columns == ["doc_id", "text", "d_", "t_", "extra"]
    clean = {r.doc_id: r.text for r in out.collect()}
    assert clean[101] is None and clean[102] == ""
    assert "crabbob" in clean[100]
    assert clean[103] == "x" * 9000 + " mail [EMAIL] and [IP] " + "é" * 5000 + " [PHONE] end"
    assert clean[3] == "please write to contact: [EMAIL] today"


def test_candidates_apart_from_spans(spark):
    texts = ["a@b.co " * 3000 + "write to contact: joe@host and 1.2.3.4", "no span joe[at]host.org", "joe@host a@b.co"]
    rows = op03_pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        spans = [(m.start, m.end) for k in op03_pii.KINDS for m in r[k]]
        assert all(e <= m.start or m.end <= s for m in r.free for s, e in spans)
        assert "joe" in "".join(m.hit for m in r.free)


def test_clashing_names_pass_through(spark):
    rows = [(i, "one two three four five six seven eight nine " + ("ten" if i % 2 else "ten"), "p", 1, 2, 3) for i in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, `d_` string, `n_` int, `_node` int, part int")
    kept = op02_neardup.keep_one(table)
    assert kept.columns == table.columns
    assert [tuple(r) for r in kept.collect()] == [rows[0]]


def test_query_of_personal_data(spark, sf_small):
    shapes = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
              "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def right(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(p) <= 255 for p in hit.split("."))
        if kind == "card":
            own = [int(d) for d in reversed(digits)]
            return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(own)) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    want = {}
    for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect():
        found = {k: [m.span() for m in re.finditer(p, r.text or "") if right(k, m.group())] for k, p in shapes.items()}
        base = ",".join(f"{k}:{a}:{b}" for k in shapes for a, b in found[k])
        want[r.doc_id] = (*[len(found[k]) for k in shapes], hashlib.sha256(base.encode()).hexdigest())
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in queries.op3_pii(spark, sf_small).collect()}
    assert got == want


def test_query_of_languages(spark, sf_small):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = queries.op5_langid(spark, sf_small).collect()
    assert {r.doc_id for r in got} == set(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    asked = [r for r in got if r.held_out and rows[r.doc_id].lang and any(c.isalpha() for c in rows[r.doc_id].text or "")]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in asked) >= 0.95 * len(asked)


def test_repeats_among_rows_without_an_id(spark):
    """Many rows of no id, some repeated: each text keeps its own spans."""
    from riskweave.llm import op04_repeats

    letters = "abcdefghijklmnopqrstuvwxyz "
    shared = "".join(RNG.choice(letters) for _ in range(260))
    texts = ["".join(RNG.choice(letters) for _ in range(RNG.randint(1, 300))) for _ in range(60)]
    texts = [t[:40] + shared[:k] + t[40:] if i % 3 == 0 else t for i, t in enumerate(texts) for k in (RNG.randint(150, 260),)]
    rows = [(None, t) for t in texts] + [(None, texts[1])] * 5 + [(7, texts[2])]
    seen = collections.Counter()
    for _, t in rows:
        for i in range(len(t) - 199):
            seen[t[i:i + 200]] += 1
    want = collections.Counter()
    for d, t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i:i + 200] = [True] * 200
        kept = "".join(c for c, g in zip(t, gone) if not g)
        runs = sum(g and not p for g, p in zip(gone, [False, *gone]))
        want[d, len(t), sum(gone), runs, hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = op04_repeats.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert collections.Counter(tuple(r) for r in got) == want
