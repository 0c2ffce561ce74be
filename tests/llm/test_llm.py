"""The training-data operators against brute force on small tables with nulls, empty texts, ties, repeated
rows and clashing extra columns; and on empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import (op01_mixing, op02_neardup, op03_pii, op04_repeats, op05_langid, op06_topk, op07_warc, op08_main_text,
                           op09_fingerprint, op10_packing)
from riskweave.llm.gsaca import suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, range int, node string, h long"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, prose(RNG.choice([1, 3, 40, 120])), RNG.choice(["en", "fr"]), f"s{i % 4}") for i in range(60)]
    out += [(60, None, "en", "s0"), (61, "", None, None), (62, out[2][1], "fr", "s1"), (62, out[2][1], "fr", "s1"), (None, prose(50), "en", "s2")]
    passage = prose(60)
    out += [(70 + i, prose(10) + " " + passage + " " + prose(12), "en", "s3") for i in range(6)]
    near = prose(150).split()
    out += [(80 + i, " ".join(near[:100 + i] + ["changed"] + near[101 + i:]), "fr", "s3") for i in range(6)]
    out += [(90, "of " * 300, "en", "s0"), (91, "Mail a.b@c.de or +1 (523) 555-1055, 10.0.0.1 and 999.1.1.1; 4111 1111 1111 1111 x", "en", "s1")]
    return [(*r, None, 1, "x", 2) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, none):
    assert op01_mixing.mix(none).count() == 0
    assert op02_neardup.classes(none).count() == 0
    assert op03_pii.find(none).count() == 0
    assert op04_repeats.strip_repeats(none).count() == 0
    assert op05_langid.tag(none, op05_langid.fit(none), keep=("doc_id",)).count() == 0
    assert op09_fingerprint.fingerprints(none).count() == 0
    assert op10_packing.sequences(none, "word_bpe_49k.json").count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert op08_main_text.extract(pages).count() == 0
    assert op07_warc.read(op07_warc.archives(pages)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op06_topk.top_k(vectors, F.col("vec_id") % 50 == 0).count() == 0


def test_mixing(docs, rows):
    got = op01_mixing.mix(docs).collect()
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(size.values()), set()
    while True:
        level = (budget - sum(2 * size[s] for s in capped)) / max(1, sum(weight[s] for s in order if s not in capped))
        over = {s for s in order if s not in capped and level * weight[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    target = {s: 2 * size[s] if s in capped else level * weight[s] for s in order}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    largest = max(r.size for r in got)
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 2 * largest for s in order)
    repeated = op01_mixing.repeat(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r.copies for r in got)


def shingles(text):
    words = [w for w in re.split("[ \t\n\r\x0b\x0c]+", text) if w]
    return collections.Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def brute_classes(texts, threshold=0.8):
    top = list(range(len(texts)))
    sets = [shingles(t) for t in texts]

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            every = sum((sets[i] | sets[j]).values())
            if texts[i] == texts[j] or every and sum((sets[i] & sets[j]).values()) / every >= threshold:
                top[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_near_duplicates(docs, rows):
    texts = [r[1] or "" for r in rows]
    expected = collections.defaultdict(set)
    for i, c in enumerate(brute_classes(texts)):
        expected[c].add((rows[i][0], hashlib.md5(texts[i].encode()).hexdigest()))
    got = collections.defaultdict(set)
    for r in op02_neardup.classes(docs).collect():
        got[r.part].add((r.doc_id, bytes(r.node).hex()))
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in expected.values()}
    kept = op02_neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(expected)


def test_half_alike_texts_in_one_bucket(spark):
    """Copies of one base, each linked to some of the others only: components as by all pairs."""
    base = prose(60).split()
    made = []
    for i in range(60):
        words = list(base)
        for _ in range(RNG.choice([1, 1, 2, 3])):
            words[RNG.randrange(len(words))] = f"new{RNG.randrange(10 ** 6)}"
        made.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in op02_neardup.classes(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(60)] == brute_classes([t for _, t in made])


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    element = rng.integers(0, 2 ** 63, 60).astype(np.uint64)
    a, b = rng.uniform(0.2, 4, 60), rng.uniform(0.2, 4, 60)
    owner = np.repeat([0, 1], 60)
    ranks = op02_neardup.dart_minhash(owner, np.concatenate([element, element]), np.concatenate([a, b]), 2, 4000)
    assert (ranks[0] == ranks[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def luhn(digits):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0

    def fine(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in hit.split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if fine(k, m.group())] for k, p in BASE.items()}


def test_personal_data(spark, docs, rows):
    odd = ["a@b.c%d@e.f.g. x@y", "1.2.3.4.5.6.7.8.9", "4111-1111 1111 1111 12 34567890123456789012", "+12 (34) 567-8901+4 9 1 2 3 4 5 6 7 8 9",
           "é😀 a_b+c@d-e.fg 😀 255.255.255.255 256.1.1.1", "+1 (2.", "5" * 3000, "x@" * 500, "1." * 900, "".join(f"10.0.{i % 300}.1 " for i in range(700))]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for table, texts in ((made, dict(enumerate(odd))), (docs, {r[0]: r[1] for r in rows})):
        for r in op03_pii.find(table).collect():
            for kind, spans in base_spans(texts[r.doc_id] or "").items():
                assert [(m.start, m.end) for m in r[kind]] == spans, (r.doc_id, kind)
    clean = {r.doc_id: r.text for r in op03_pii.redact(docs).collect()}
    assert clean[91] == "Mail [EMAIL] or [PHONE], [IP] and 999.1.1.1; [CARD] x" and clean[60] is None and clean[0] == rows[0][1]


def test_bootstrap_finds_what_patterns_vouch_for(spark):
    seeds = [(i, f"please write to user{i}@mail.example.org today") for i in range(30)]
    table = spark.createDataFrame(seeds + [(99, "please write to user12345[at]mail.example.org today")], "doc_id long, text string")
    extra = {r.doc_id: [(e.kind, e.hit) for e in r.extra] for r in op03_pii.find(table).collect()}
    assert extra[99] == [("email", "user12345[at]mail.example.org")] and not any(extra[i] for i in range(30))


def test_bootstrap_takes_loose_shapes_of_each_kind(spark):
    """No digits for e-mail addresses; blanks and brackets in phone and card numbers; a sentence may end after them."""
    base = {"email": "please write to ada{}@mail.example.org", "phone": "please call me on +1 (555) 123-4{:03}",
            "ip": "from the host 10.0.3.{}", "card": "paid with card {}"}
    cards = [f"{n}{next(c for c in range(10) if luhn_ok(f'{n}{c}'))}" for n in range(411111111111100, 411111111111130)]
    made = [(k, text.format(cards[i] if k == "card" else i)) for k, text in base.items() for i in range(30)]
    loose = {"email": ["jane.doe[at]example.org", "jane.doe (at) example (dot) org", "jane at example dot org"],
             "phone": ["555 123 4567", "(555) 123-4567", "555.123.4567"], "ip": ["10-0-0-1", "10[.]0[.]0[.]1"],
             "card": ["4111 1111 1111 1112", "4111  1111  1111  1111", "4111.1111.1111.1111"]}
    asked = [(k, base[k].split("ada")[0].split("+1")[0].split("10.")[0].split("{")[0], hit, end) for k, hits in loose.items() for hit in hits for end in (".", " today")]
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(made)] + [(1000 + i, a + hit + end) for i, (_, a, hit, end) in enumerate(asked)],
                                  "doc_id long, text string")
    extra = {r.doc_id: [(e.kind, e.hit, e.start) for e in r.extra] for r in op03_pii.find(table).collect()}
    for i, (k, a, hit, _) in enumerate(asked):
        assert (k, hit, len(a)) in extra[1000 + i], (hit, extra[1000 + i])
    assert not any(extra[i] for i in range(len(made)))
    clean = {r.doc_id: r.text for r in op03_pii.redact(table).collect()}
    assert [clean[1000 + i] for i in range(len(asked))] == [f"{a}[{k.upper()}]{end}" for k, a, _, end in asked]


def luhn_ok(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_bootstrap_goes_on_from_what_it_found(spark):
    """Contexts that no base address stands in, each reached through the instances of the one before."""
    texts = [f"please write to user{i}@mail.example.org" for i in range(40)]
    hops = ["please write to", "reach us under", "our box is", "send it here"]
    for n, (a, b) in enumerate(zip(hops, hops[1:])):
        texts += [f"{x} {c}.n{n}[at]example.org" for c in "abcdefghijkl"[:(12, 8, 6)[n]] for x in (a, b)]
    texts += ["send it here last[at]example.org", "never seen words other[at]example.org"]
    found = op03_pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    extra = {r.doc_id: [e.hit for e in r.extra] for r in found}
    assert [extra[i] for i in range(len(texts))] == [[t.split()[-1]] if "[at]" in t and "other" not in t else [] for t in texts]


def brute_repeats(texts, length):
    data = [t.encode() for t in texts]
    seen = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mask = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                mask[i:i + length] = b"\1" * length
        out.append((len(d), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(bytes(x for x, m in zip(d, mask) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [1000, 2])
def test_repeats(docs, rows, group):
    """Also with a group size that sends the ends of repeats through the halving."""
    expected = collections.Counter(zip([r[0] for r in rows], brute_repeats([r[1] or "" for r in rows], 200)))
    got = collections.Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in
                              op04_repeats.strip_repeats(docs, group=group).collect())
    assert got == expected


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(400):
        s = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(25))]
        assert suffix_array(np.array(s, dtype=np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_language(spark):
    words = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["uno", "dos", "tres", "cuatro"]}
    made = [(i, " ".join(RNG.choice(words[k]) for _ in range(20)), k) for i in range(40) for k in words]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = op05_langid.fit(table)
    asked = spark.createDataFrame([(0, "gamma beta", "yy"), (1, "cuatros dose", None), (2, None, "xx"), (3, "12 !?", "xx"), (4, "", "yy"), (5, "½ ²", "yy")], table.schema)
    got = {r.doc_id: (r.lang_pred, r.score) for r in op05_langid.tag(asked, model, keep=("doc_id",)).collect()}
    assert [got[i][0] for i in range(6)] == ["xx", "yy", "und", "und", "und", "und"] and 0.5 < got[0][1] <= 1


def test_language_of_long_words(spark):
    """A run of letters counts to its end, in fitting and in prediction."""
    made = [(i, " ".join(RNG.choice(w) for _ in range(20)), k) for i in range(40) for k, w in
            (("xx", ["alpha", "beta", "gamma"]), ("yy", ["uno", "dos", "tres"]))]
    made += [(100 + i, "k" * 70 + "q" * 30, "xx") for i in range(3)] + [(200 + i, "k" * 70 + "w" * 30, "yy") for i in range(3)]
    model = op05_langid.fit(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    assert "k" * 70 + "q" * 30 in model.tables[0] and "qqqqq" in model.tables[5] and "wwwww" in model.tables[5]
    score = op05_langid.Scorer(model)
    asked = ["unodostres" * 7 + "alphabetagamma" * 40, "alphabetagamma" * 5 + "unodostres" * 60, "k" * 70 + "q" * 30, "k" * 70 + "w" * 30, "dos " * 50 + "kk" * 40]
    assert [score(t)[0] for t in asked] == ["xx", "yy", "xx", "yy", "yy"] and all(len(w) <= 64 for w in score.place)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    made = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 400)]
    made += [(1000, None), (1001, []), (1002, [float("nan")] * 8), (1003, [None] * 8), (1050, [1.0, 2.0])]
    got = op06_topk.top_k(spark.createDataFrame(made, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, shard=64)
    held = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in made if i < 1000}
    expected = []
    for q in range(0, 400, 50):
        best = sorted((-int(held[q] @ v), i) for i, v in held.items() if i != q)[:5]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == expected


def test_warc(spark):
    made = [(i, f"http://x/{i}", f"<p>{prose(30)}</p>") for i in range(50)] + [(60, None, None), (61, "u", ""), (None, "v", "same\r\n\r\nWARC/1.1"),
                                                                              (7, "w", "same\r\n\r\nWARC/1.1"), (70, "y", "same\r\n\r\nWARC/1.1")]
    manifest = op07_warc.archives(spark.createDataFrame(made, "page_id long, url string, html string").repartition(2))
    got = {(r.page_id, r.url): r for r in op07_warc.read(manifest, with_payload=True).collect()}
    assert len(got) == len(made) == sum(r.records for r in manifest.collect())
    for page_id, url, html in made:
        r, payload = got[page_id, url], (html or "").encode()
        assert r.payload_bytes == len(payload) and r.record_type == ("revisit" if (page_id, url) in ((61, "u"), (None, "v"), (70, "y")) else "response")
        assert r.refers_to == {(61, "u"): 60, (None, "v"): 7, (70, "y"): 7}.get((page_id, url))
        assert bytes(r.payload) == (b"" if r.record_type == "revisit" else payload)


def test_main_text():
    page = ("<html><head><title>T</title><script>var a='</p>'</script></head><body><header>Top</header><nav><a>Home</a></nav><div class='cookie-notice'>Accept"
            "</div><article><h1>Head &amp; line</h1><p>One\n  two<br>three<p>Four <b>five</b></p><aside>Side</aside><p>Six</p></article>"
            "<section id=comments><p>First!</p></section><form>Mail <input></form><footer>&copy; x</footer>")
    assert op08_main_text.main_text(page) == "Head & line\nOne two\nthree\nFour five\nSix"
    assert op08_main_text.main_text(None) == op08_main_text.main_text("") == op08_main_text.main_text("<p> </p>") == ""


def test_main_text_by_the_distribution_of_text():
    """No article, no main, no listed name: menus, adverts and footers go by their little text, short paragraphs stay."""
    long = ["A long paragraph of the story that goes on for a good while. " * n for n in (5, 9, 3, 40)]
    menu = "".join(f"<div><a href='/{i}'>Section number {i}</a></div>" for i in range(8))
    body = f"<h1>Title</h1><p>{long[0]}</p><p>{long[1]}</p><p>Short one.</p><p>{long[3]}</p><p>Closing words.</p>"
    foot = "<table><tr><td>Buy shoes now</td></tr></table><div>All rights reserved</div><div>Imprint</div>" + menu
    expected = "\n".join(["Title", long[0].strip(), long[1].strip(), "Short one.", long[3].strip(), "Closing words."])
    page = f"<body><div class=top>{menu}<div>Buy hats now</div></div><div class=x>{body}</div><div class=y>{foot}</div></body>"
    assert op08_main_text.main_text(page) == expected
    flat = f"<body>{menu}<div>Buy hats now</div>" + "".join(f"<div>{x}</div>" for x in long) + foot
    assert op08_main_text.main_text(flat) == "\n".join(x.strip() for x in long)
    few = "".join(f"<div>{x}</div>" for x in ("Buy hats now", long[0], long[1], "All rights reserved"))
    assert op08_main_text.main_text(few) == long[0].strip() + "\n" + long[1].strip()
    assert op08_main_text.main_text("<div>One</div><div>Two words</div>") == "One\nTwo words"
    assert op08_main_text.main_text(f"<ul>{menu}</ul>").count("Section") == 8


def test_main_text_keeps_short_ends_of_articles():
    """Whatever the length of the article and the boilerplate between."""
    aside = "<aside><p>One</p><p>Two</p><p>Three</p><p>Four</p></aside>"
    for root in ("article", "main"):
        page = f"<{root}><p>{'x' * 9000}</p>{aside}<p>{'y' * 60}</p>{aside}<p>z</p></{root}><div>Imprint</div>"
        assert op08_main_text.main_text(page) == "\n".join(["x" * 9000, "y" * 60, "z"])
    page = f"<div><p>{'x' * 9000}</p>{aside}<p>{'y' * 60}</p></div>" + "<div>Imprint</div>" * 5
    assert op08_main_text.main_text(page) == "x" * 9000 + "\n" + "y" * 60


@pytest.mark.parametrize("name", ["page no-sidebar", "has-sidebar", "search-layout", "side-by-side", "sidebar", "search page"])
def test_main_text_in_wrappers(name):
    story = "".join(f"<p>{c * 300}</p>" for c in "abc")
    expected = "\n".join(c * 300 for c in "abc")
    named = "<div class='cookie-notice'>Accept</div><div class='x ads'>Buy</div><div id=comments><article>First!</article></div>"
    assert op08_main_text.main_text(f"<div class='{name}'><article>{story}</article>{named}</div>") == expected
    assert op08_main_text.main_text(f"<div id='{name}'>{story}</div><div class='ad'>{'d' * 300}</div>") == expected
    assert op08_main_text.main_text(f"<div class=ad><p>Ad<p>Ad</div><div data-class=ad>{story}</div>") == expected


def test_fingerprints(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    expected = collections.Counter()
    for a, b in zip(order, order[1:] + order[:1]):
        t, u = a[1] or "", b[1] or ""
        other = t[:len(t) - len(t) // 4] + u[:len(t) // 4]
        expected[a[0], len(t), hashlib.sha256(other.encode()).hexdigest(), op09_fingerprint.fingerprint(t), op09_fingerprint.fingerprint(other)] += 1
    got = op09_fingerprint.fingerprints(docs).collect()
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == expected
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    expected = collections.Counter((r[0], tuple(tok.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows)
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in op10_packing.sequences(docs, "word_bpe_49k.json", with_ids=True).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and len(r.ids) == r.length
        pieces[r.doc_id].append((r.start, tuple(r.ids), r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
    for at in places.values():
        at.sort()
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:])) and sum(n for _, n in at) <= 4096
    for (doc, ids), n in expected.items():
        assert sum(len(p) for _, p, _ in pieces[doc]) == sum(len(i) * k for (d, i), k in expected.items() if d == doc)
        if n == 1 and doc != 62:
            assert sum((p for _, p, _ in sorted(pieces[doc])), ()) == ids and {t for *_, t in pieces[doc]} == {len(ids)}


def test_packing_takes_added_tokens_as_the_tokenizer_does(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["a <|endoftext|> b", "<|startoftext|>One<|endoftext|>\nTwo", "x<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|end", "plain words", ""]
    got = {r.doc_id: r for r in op10_packing.sequences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1),
                                                       "word_bpe_49k.json", with_ids=True).collect() if r.length == r.doc_tokens}
    expected = [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    encode = op10_packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert [x.tolist() for x in encode(texts, 2)] == expected and expected[0] == [320, 49407, 321, 2]
    assert got and all(r.ids == expected[i] for i, r in got.items())
