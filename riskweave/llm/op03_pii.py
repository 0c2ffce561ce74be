"""Personal data by fixed shapes and by bootstrapped contextual extraction; DataFrame functions only.

Base: e-mail addresses, IP addresses, card numbers and phone numbers of fixed shape, validated. They are
also the seeds of the bootstrap:

1. the words before a seed form its lexical pattern;
2. what has the loose shape of a kind (``LOOSE``) and overlaps no base match is a candidate for that kind, with
   the patterns it stands in;
3. the bipartite graph of patterns and instances is scored in ``ROUNDS`` rounds: a pattern's score is the
   share of trusted instances among all instances seen in it, an instance's is ``1 - prod(1 - score)``
   over its patterns; patterns with under ``MIN_SEEDS`` distinct seeds score nothing;
4. candidates that reach ``CONFIDENT`` for a kind are seeds of the next hop, which does 3 again; the hops end when no
   new candidate reaches it. All that did add their spans. Base spans always stay.

The graph holds one row per distinct (pattern, instance, kind); joins on patterns follow aggregation, so a
pattern that stands before a third of all identifiers is a key of pre-aggregated rows.

Positions come from cutting a text at the matches: the length of what precedes a match is its start. All
expressions are linear in the text; quantifiers are possessive or bounded, and guards let a match begin
only where the leftmost match can begin.

Rules: null text is empty; offsets are code points, ends exclusive; rows with the same id and text have the
same spans; empty tables give no rows; other columns are not read (``redact`` passes them through).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.shared import stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 2
MIN_SEEDS = 5
CONFIDENT = 0.8
CONTEXT = 40
_LOCAL = "A-Za-z0-9._%+-"
#: A match starts at the start of a run of its first class, or where the match before ended (\G).
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
#: The longest run of digits joined by single blanks or hyphens, of 13 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: ``(at)``, ``[dot]`` and the like.
_AT, _DOT = (rf"\x20?[\[({{<]\x20?(?i:{w})\x20?[\])}}>]\x20?" for w in ("at", "dot"))
_HOST = "[A-Za-z0-9-]++"
#: Seps of loose IP addresses: one mark, or a point or ``dot`` in brackets.
_SEP = r"(?:[./-]|[\[(](?:\.|(?i:dot))[\])])"
_CARD_GAP, _PHONE_GAP = r"[\x20./-]{0,3}", r"[\x20()./+-]{0,3}"
#: The loose shapes of candidates. Cards and phones are the longest runs of digits with gaps, of as many digits as the kind has.
LOOSE = {
    "email": rf"(?<![{_LOCAL}@])[{_LOCAL}]++(?:(?:@|{_AT}){_HOST}(?:(?:\.|{_DOT}|\x20(?i:dot)\x20){_HOST})*+"
             rf"|\x20(?i:at)\x20{_HOST}(?:(?:\.|{_DOT}|\x20(?i:dot)\x20){_HOST})++)(?!@)",
    "ip": rf"(?<![A-Za-z0-9_@])(?<![0-9][./-])[0-9]{{1,3}}+(?:{_SEP}[0-9]{{1,3}}+){{3}}(?:[/:][0-9]++)?+(?![A-Za-z0-9_@]|[./-][0-9])",
    "card": rf"(?<![A-Za-z0-9_@])(?<![0-9]{_CARD_GAP})[0-9](?:{_CARD_GAP}+[0-9]){{12,18}}+(?![A-Za-z_@]|{_CARD_GAP}[0-9])",
    "phone": rf"(?<![A-Za-z0-9_@])(?<![0-9]{_PHONE_GAP})(?:\+?\((?=\+?[0-9]{{1,5}}\))\+?|\+)?+[0-9](?:{_PHONE_GAP}+[0-9]){{8,14}}+"
             rf"(?![A-Za-z_@]|{_PHONE_GAP}[0-9])",
}
_STEP = 256
#: Code points of a block: places of long texts are looked up by block.
BLOCK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, also where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _prefix(values: Column) -> Column:
    """Sums of all values before each one; in steps, so that the work stays linear."""
    def running(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _STEP).cast("int")),
                        lambda i: running(F.slice(values, i * _STEP + 1, _STEP)))
    return let(parts, lambda inner: let(
        running(F.transform(inner, lambda xs: F.element_at(xs, -1))),
        lambda offsets: F.flatten(F.transform(inner, lambda xs, i: F.transform(
            F.slice(xs, F.lit(1), F.size(xs) - 1), lambda x: x + F.get(offsets, i))))))


_MATCH = "array<struct<start:bigint,end:bigint,hit:string,before:string>>"


def matches(text: Column, pattern: str) -> Column:
    """(start, end, hit, text before it up to ``CONTEXT``) of every match, left to right."""
    def located(both: Column) -> Column:
        hits, pieces = both["hits"], both["pieces"]
        lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: (F.length(p) + F.length(h)).cast("long"))

        def one(h: Column, i: Column, before: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(pieces, i))
            return F.struct(start.alias("start"), (start + F.length(h)).alias("end"), h.alias("hit"),
                            F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("before"))

        found = let(_prefix(lengths), lambda before: F.transform(hits, lambda h, i: one(h, i, before)))
        return F.when(F.size(hits) > 0, found).otherwise(F.lit(None).cast(_MATCH))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
                        F.split(text, pattern, -1).alias("pieces")), located)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    each = F.transform(F.split(F.reverse(_digits(x)), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return _luhn(hit)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _present(kind: str, text: Column) -> Column:
    """A cheap necessary condition."""
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"),
            "card": text.rlike(r"[0-9][\x20-]?[0-9]")}[kind]


PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def base(kind: str, text: Column) -> Column:
    found = F.when(_present(kind, text), matches(text, PATTERNS[kind]))
    return F.coalesce(F.filter(found, lambda m: _valid(kind, m["hit"])), F.lit(None).cast(_MATCH), F.array().cast(_MATCH))


def _pattern(before: Column) -> Column:
    """The last two words (or marks like ``:``) before an identifier, lower case; null if there is none."""
    parts = F.regexp_extract_all(F.lower(before), F.lit(r"\p{L}++|[:=#]"), F.lit(0))
    return F.when(F.size(parts) >= 2, F.concat_ws(" ", F.slice(parts, -2, 2)))


def _loose(kind: str, text: Column) -> Column:
    """The candidates of a kind: (start, end, hit, before, kind)."""
    present = text.rlike("@|(?i:at)") if kind == "email" else text.rlike("[0-9]")
    found = F.coalesce(F.when(present, matches(text, LOOSE[kind])), F.array().cast(_MATCH))
    return F.transform(found, lambda m: F.struct(m["start"], m["end"], m["hit"], m["before"], F.lit(kind).alias("kind")))


def _clear(loose: Column, spans: Column) -> Column:
    """The candidates that meet no span. Each is held against the spans of the blocks it touches, so that a text of
    many spans and candidates does not meet each with each."""
    def meets(m: Column, among: Column) -> Column:
        return F.exists(among, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))

    last = F.greatest(F.array_max(F.transform(spans, lambda b: b["end"])), F.array_max(F.transform(loose, lambda m: m["end"])))
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(last / BLOCK)), lambda i: F.filter(
        spans, lambda b: (b["start"] < (i + 1) * BLOCK) & (b["end"] > i * BLOCK)))

    def at(by: Column, place: Column) -> Column:
        return F.get(by, F.floor(place / BLOCK).cast("int"))

    return let(blocks, lambda by: F.filter(loose, lambda m: ~F.when(
        m["end"] - m["start"] <= BLOCK, meets(m, at(by, m["start"])) | meets(m, at(by, m["end"] - 1))).otherwise(meets(m, spans))))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, th (hash of the text), the base matches by kind, and candidates."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("doc_id", F.xxhash64("t").alias("th"), *[base(k, F.col("t")).alias(k) for k in KINDS],
                       F.concat(*[_loose(k, F.col("t")) for k in KINDS]).alias("loose"))
    taken = F.concat(*[F.col(k) for k in KINDS])
    free = F.when((F.size("loose") > 0) & (F.size(taken) > 0), let(taken, lambda spans: _clear(F.col("loose"), spans))).otherwise(F.col("loose"))
    return rows.select("doc_id", "th", *KINDS, free.alias("free"))


def bootstrap(scanned: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confident: float = CONFIDENT) -> DataFrame:
    """(kind, hit) of the candidates that the patterns vouch for."""
    def seeded(kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), _pattern(m["before"]).alias("pattern"), m["hit"].alias("hit")))

    seeds = scanned.select(F.explode(F.concat(*map(seeded, KINDS))).alias("s")).select("s.*")
    loose = scanned.select(F.explode("free").alias("m")).select(
        "m.kind", _pattern(F.col("m.before")).alias("pattern"), "m.hit")
    graph = (seeds.withColumn("seed", F.lit(1.0)).unionByName(loose.withColumn("seed", F.lit(0.0)))
             .where(F.col("pattern").isNotNull()).groupBy("kind", "pattern", "hit").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")))
    graph = stored(graph, "pii-graph")
    found = None
    while True:
        hop = graph
        if found is not None:
            hop = graph.join(found.withColumn("sure", F.lit(1.0)), ["kind", "hit"], "left").withColumn(
                "seed", F.greatest("seed", F.coalesce("sure", F.lit(0.0)))).drop("sure")
        new = stored(_trust(hop, rounds, min_seeds).where(F.col("conf") >= confident).select("kind", "hit"), "pii-new")
        if new.isEmpty():
            return new if found is None else found
        found = new if found is None else stored(found.unionByName(new), "pii-found")


def _trust(graph: DataFrame, rounds: int, min_seeds: int) -> DataFrame:
    """(kind, hit, conf) of the instances that are no seeds."""
    trust = None
    for _ in range(rounds):
        edges = graph.withColumn("trust", F.col("seed"))
        if trust is not None:
            edges = graph.join(trust, ["kind", "hit"], "left").withColumn("trust", F.greatest("seed", F.coalesce("conf", F.lit(0.0))))
        scored = (edges.groupBy("kind", "pattern").agg((F.sum("trust") / F.count(F.lit(1))).alias("score"), F.sum("seed").alias("seeds"))
                  .where(F.col("seeds") >= min_seeds).select("kind", "pattern", "score"))
        doubt = F.sum(F.log(F.lit(1.0) - F.least(F.col("score"), F.lit(0.999))))
        trust = stored(graph.where("seed = 0").join(scored, ["kind", "pattern"])
                       .groupBy("kind", "hit").agg((F.lit(1.0) - F.exp(doubt)).alias("conf")), "pii-trust")
    return trust


def _extra(scanned: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, th, extra): the spans of discovered identifiers by document, each document once."""
    seen = scanned.where(F.size("free") > 0).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", F.explode("free").alias("m"))
    seen = seen.select("doc_id", "th", "m.kind", "m.hit", "m.start", "m.end")
    return (seen.join(found, ["kind", "hit"]).groupBy("doc_id", "th")
            .agg(F.collect_set(F.struct("kind", "start", "end", "hit")).alias("extra"))
            .select(F.col("doc_id").alias("d_"), F.col("th").alias("t_"), F.col("extra")))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base spans by kind (arrays of start, end, hit) and ``extra`` spans (kind, start, end, hit)."""
    scanned = stored(scan(docs, doc_id, text), "pii-scan")
    extra = _extra(scanned, bootstrap(scanned))
    joined = scanned.join(extra, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("th") == F.col("t_")), "left")
    return joined.select("doc_id", *KINDS, F.coalesce("extra", F.array().cast(extra.schema["extra"].dataType)).alias("extra"))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text cut into blocks."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    left, right = (start % BLOCK).cast("int"), (end % BLOCK).cast("int")
    head, tail = F.coalesce(F.get(blocks, first), F.lit("")), F.coalesce(F.get(blocks, last), F.lit(""))
    return F.when(end <= start, F.lit("")).when(first == last, F.substr(head, left + 1, right - left)).otherwise(F.concat(
        F.substr(head, left + 1), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.left(tail, right)))


def _cut(text: Column, spans: Column) -> Column:
    """The text with its spans (start, end, kind), in order and apart, replaced by their kinds in brackets."""
    def piece(blocks: Column) -> Column:
        parts = F.transform(spans, lambda s, i: F.concat(
            _between(blocks, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0).cast("long")), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        rest = _between(blocks, F.element_at(spans, -1)["end"], F.length(text).cast("long"))
        return F.concat(F.array_join(parts, ""), rest)

    return let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)), piece)


_SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def _apart(spans: Column) -> Column:
    """Spans in order; what overlaps becomes one span, of the kind that begins first."""
    def step(parts: Column, s: Column) -> Column:
        last = F.element_at(parts, -1)
        merged = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(parts) > 0) & (s["start"] < F.get(parts, F.size(parts) - 1)["end"]),
                      F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(merged))).otherwise(F.concat(parts, F.array(s)))

    def chained(ordered: Column) -> Column:
        clash = F.exists(F.sequence(F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(1))),
                         lambda i: F.coalesce(F.get(ordered, i)["start"] < F.get(ordered, i - 1)["end"], F.lit(False)))
        return F.when(clash, F.aggregate(ordered, F.array().cast(_SPANS), step)).otherwise(ordered)

    return let(F.array_sort(spans), chained)


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input with every found span in ``text``, by its place, replaced by its kind in brackets; overlapping spans
    become one. A null text stays null. The columns of the input travel as one, so that theirs may have any name."""
    scanned = stored(scan(docs, doc_id, text), "pii-scan")
    extra = _extra(scanned, bootstrap(scanned))
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("own"),
                       F.col(text).alias("content"), F.xxhash64(content).alias("mark"))
    joined = rows.join(extra, F.col("own").eqNullSafe(F.col("d_")) & (F.col("mark") == F.col("t_")), "left")

    def tagged(found: Column, kind: str) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    found = [F.when(_present(k, F.col("content")), tagged(base(k, F.col("content")), k)).otherwise(F.array().cast(_SPANS)) for k in KINDS]
    more = F.transform("extra", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["kind"].alias("kind")))
    spans = F.when(F.col("content").isNotNull(), F.concat(*found, F.coalesce(more, F.array().cast(_SPANS))))
    marked = joined.select("row", "content", spans.alias("spans"))
    clean = F.when(F.size("spans") > 0, let(_apart(F.col("spans")), lambda s: _cut(F.col("content"), s))).otherwise(F.col("content"))
    return marked.withColumn("row", F.col("row").withField(f"`{text}`", clean)).select("row.*")
