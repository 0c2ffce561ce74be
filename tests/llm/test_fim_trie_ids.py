"""Fill-in-middle, the conversation trie and the files of token ids against brute force: nulls, empty and very long texts,
ties, repeated rows, empty tables and extra columns with clashing names; and the queries built on them."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from riskweave.llm import op11_fim, op12_trie, op13_tokenids, queries

RNG = random.Random(11)
TOKENIZER = "byte_bpe_50k.json"
EXTRA = ", pos long, output string, part int, k1 string, mark string, form int, depth string"
CLASH = (7, "x", 3, "y", "z", 9, "w")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    texts = ["", None, "a", "ab", "é", "日本語テキスト", "with <P> inside", "<M>", "odd <P <S M> >", "tail <", " lead", "two  spaces  ", " ", "\n", "a \n b\t c ",
             "end<|endoftext|> mid <|endoftext|>x", "it's we'll I'M 12 345 a1b2", " nbsp  em\x1cfs \x85 nel", "🙂 🙂🙂 é", "x" * 70 + " y", "<S>P>"]
    for _ in range(200):
        texts.append("".join(RNG.choice(["the", " ", " ", "é", "\n", "foo", "Bar", "9", ",", "<", "日", "  ", "'s"]) for _ in range(RNG.randint(1, 60))))
    texts.append("".join(RNG.choice("abcd efgh ijé日 \n") for _ in range(300_000)))
    out = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5]), (6, "other"), (None, "no id"), (None, None), (-4, "minus")]
    RNG.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], "doc_id long, text string" + EXTRA).repartition(5).cache()


def fim(doc_id, text):
    """The contract, written with slices of Python strings."""
    t = text or ""
    n, h = len(t), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}")
    return (doc_id, n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}")


def test_fim_equals_brute_force(docs, rows):
    key = lambda r: tuple(map(str, r))
    got = op11_fim.transform(docs).collect()
    want = [fim(*r) for r in rows]
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted(want, key=key)
    assert all(r.output_sha256 == sha(r.output) for r in got)
    assert {"plain", "psm", "spm"} == {r.form for r in got}


def test_fim_restores(spark, docs, rows):
    back = op11_fim.restore(op11_fim.transform(docs), keep=("doc_id",), with_text=True).collect()
    assert collections.Counter((r.doc_id, r.restored) for r in back) == collections.Counter((d, t or "") for d, t in rows)
    assert all(r.restored_sha256 == sha(r.restored) for r in back)


def test_fim_rules(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op11_fim.restore(op11_fim.transform(none)).count() == 0
    with pytest.raises(ValueError):
        op11_fim.transform(none, marks=(b"<<", b"<S>", b"<M>"))
    pieces = [(0, 0, 3), (0, 3, 5), (0, 5, 9), (1, 0, 3), (1, 3, 6), (1, 6, 9)]
    for order in op11_fim.ORDER.values():
        assert op11_fim.unarrange(op11_fim.arrange(pieces, order), order) == pieces
    points = op11_fim.CodePoints(np.frombuffer(("é日a" * 5000).encode(), np.uint8))
    text = "é日a" * 5000
    assert [points.place(k) for k in (0, 1, 4095, 9999, 14999, 15000)] == [len(text[:k].encode()) for k in (0, 1, 4095, 9999, 14999, 15000)]


def trie(turns):
    """The contract by sets of prefixes. ``turns``: (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + said[h:])
    members = collections.defaultdict(set)
    for c, said in built.items():
        for d in range(len(said) + 1):
            members[said[:d]].add(c)
    kids = collections.defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    below = {}
    for path in sorted(members, key=len, reverse=True):
        weight = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        below[path] = (sum(below[k][0] for k in kids[path]) or 1, weight + sum(below[k][1] for k in kids[path]))
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *below[p],
             hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()}


def conversations():
    said = [(RNG.choice(["user", "assistant", None]), RNG.choice(["hi", "yes", "no", "", None, "Été", "why not"])) for _ in range(6)]
    out = []
    for c in [*range(300), *range(2000, 2100), *range(9_000_000_000_000_000_000, 9_000_000_000_000_000_030)]:
        for t in range(RNG.choice([1, 1, 2, 5, 9, 14])):
            out.append((c, t, *RNG.choice(said[:2] if t < 3 else said)))
    for c in range(5000, 5007):             # long ones with equal beginnings over several blocks of positions
        for t in range(150 if c < 5004 else 330):
            out.append((c, t, "user", f"turn {t}" if t < 140 + c % 5 else f"own {c % 3} {t}"))
    out += [(2001, None, "system", "first")] * 2 + [(3, 1, "user", "again"), (3, 1, "user", "again"), (None, 0, "user", "lost")]
    RNG.shuffle(out)
    return out


def test_trie_equals_brute_force(spark):
    turns = [(c, i, r, x) for c, i, r, x in conversations()]
    distinct = {}
    for c, i, r, x in turns:                # ties are equal rows only: other ties are ordered by a hash
        distinct.setdefault((c, i), (r, x))
    turns = [(c, i, *distinct[c, i]) for c, i, _, _ in turns]
    frame = spark.createDataFrame([(*t, *CLASH) for t in turns], "conv_id long, turn long, role string, text string" + EXTRA).repartition(7)
    got = op12_trie.trie(frame).collect()
    want = trie(turns)
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


def test_trie_rules(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert op12_trie.trie(spark.createDataFrame([], schema)).count() == 0
    only = op12_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], schema))
    assert only.count() == 0
    # h of 1 is above 0 and its leader 0 is absent: a conversation without turns is still a member of the root
    assert zlib.crc32(b"1") % 9 > 1
    rows = op12_trie.trie(spark.createDataFrame([(1, 1, "user", "x")], schema)).collect()
    assert [tuple(r) for r in rows] == [(1, 0, None, 1, 0, 1, 0, sha("1"))]


def test_trie_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(0, 1, "user", x) for x in "abcdefgh"] + [(1, 1, "user", x) for x in "abcdefgh"]
    schema = "conv_id long, turn long, role string, text string"
    one, two = (sorted(map(tuple, op12_trie.trie(spark.createDataFrame(r, schema).repartition(k)).collect())) for r, k in ((rows, 1), (rows[::-1], 4)))
    assert one == two


def test_code_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 5, 1000, 4097):
        values = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = op13_tokenids.pack(values)
        assert len(control) == -(-n // 4) and len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in values)
        back = op13_tokenids.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n)
        assert np.array_equal(back, values)


def expected_ids(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    return [(d, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]


def test_token_files_equal_the_tokenizer(spark, docs, rows, monkeypatch):
    manifest = op13_tokenids.write(docs, TOKENIZER)
    got = op13_tokenids.read(manifest, with_ids=True).collect()
    want = expected_ids(rows)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == collections.Counter((d, tuple(i)) for d, i in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert manifest.agg({"ids": "sum"}).first()[0] == at


def test_frequent_ids_come_first():
    ids = np.array([9, 9, 9, 4, 4, 70000, 70000, 2], dtype=np.uint32)
    assert op13_tokenids.ranked(ids).tolist() == [9, 4, 70000, 2]


def test_long_files_and_blocks_are_cut(spark, docs, rows, monkeypatch):
    """Files and blocks of few ids, in the process of the test: the tasks' own bounds are far above small tables."""
    many = [(i, [*ids]) for i, (_, ids) in enumerate(expected_ids(rows))]
    total = sum(len(i) for _, i in many)
    manifest = op13_tokenids.write(docs.repartition(1), TOKENIZER)
    assert manifest.agg({"docs": "sum", "ids": "sum"}).first().asDict() == {"sum(docs)": len(rows), "sum(ids)": total}
    for path in manifest.toPandas()["path"]:
        for names, lengths, ids in op13_tokenids.blocks(path):
            assert len(names) == len(lengths) and int(lengths.sum()) == len(ids)


def test_token_files_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op13_tokenids.read(op13_tokenids.write(none, TOKENIZER)).count() == 0


def same_ids(texts, encode, step):
    got = [ids.tolist() for a in range(0, len(texts), step) for ids in encode(pa.array(texts[a:a + step], pa.string()))]
    assert got == [ids[:-1] for _, ids in expected_ids([(0, t) for t in texts])]


def test_words_forget_and_stay_right(monkeypatch):
    monkeypatch.setattr(op13_tokenids, "WORD_BYTES", 20_000)
    texts = [" ".join(f"{RNG.choice(['word', 'Été', '日'])}{RNG.choice(['', ',', '1'])}{RNG.randint(0, 400)}" for _ in range(30)) for _ in range(60)]
    encode = op13_tokenids.Words(op13_tokenids._path(TOKENIZER))
    same_ids(texts, encode, 7)
    assert 0 < len(encode.known) < 300
    same_ids(["", None, "a", ""], encode, 4)


def test_words_of_every_low_character():
    """Each character up to U+3001, bare, doubled, spaced, and after letters, digits and signs."""
    encode = op13_tokenids.Words(op13_tokenids._path(TOKENIZER))
    marks = [chr(c) for c in [*range(0x301), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), *range(0x2FF0, 0x3002)]]
    same_ids([f"{c} {c}{c} a{c}b 1{c} .{c} {c}\n{c}'s" for c in marks], encode, 50)
    same_ids([f"{c}  a {c} b{c}  {c}" for c in marks], encode, 50)
    same_ids([f"{c} a{c} {c}b{c} {c}" for c in marks], encode, 1)
    same_ids([" ".join(marks), "".join(marks), "<|endoftext|>a b<|endoftext|> <|endoftext|>c d"], encode, 1)


def test_queries_of_the_three(spark, sf_small):
    read = lambda name: spark.read.parquet(f"{sf_small}/{name}.parquet")
    rows = [(r.doc_id, r.text) for r in read("documents").select("doc_id", "text").collect()]
    got = {tuple(r) for r in queries.op11_fill_in_middle(spark, sf_small).collect()}
    assert got == {(*(w := fim(*r))[:5], sha(w[5]), sha(r[1] or "")) for r in rows}
    at, want = 0, set()
    for d, ids in expected_ids(sorted(rows)):
        want.add((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {tuple(r) for r in queries.op13_token_ids(spark, sf_small).collect()} == want
    turns = [tuple(r) for r in read("conversations").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.op12_prefix_trie(spark, sf_small).collect()} == trie(turns)
