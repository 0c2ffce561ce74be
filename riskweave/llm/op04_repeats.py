"""Removal of repeated passages: every byte covered by a ``LENGTH``-byte string that starts twice or more.

Sorting all suffixes of a corpus in one place does not scale, so Spark first brings together what can be
equal, and a suffix array over each such group decides.

1. Anchors. Of the ``GRAM``-byte strings inside every window of ``LENGTH`` bytes the one of the lowest hash
   (the leftmost of equals) is an anchor. Equal windows choose equal anchors at equal places, so two equal
   windows meet in the group of their anchor's string. About one position in 60 is an anchor.
2. Counts. An anchor's extract holds all windows that can choose it. Extracts that occur twice are covered
   whole; this settles the inside of repeats, exact copies and hot passages by pre-aggregated counts.
3. Suffix arrays. What is left of a group, the distinct extracts at the ends of repeats, is searched in one
   task: extracts are cut into blocks aligned at the anchor, and the suffixes of the block sequences of
   many groups are sorted by the linear grouping construction (``gsaca``). A window of ``LENGTH`` bytes
   holds at least ``RUN`` whole blocks, so equal windows lie at neighbours in that order that share
   ``RUN`` blocks; these candidates are then checked to the byte.
4. A group of over ``GROUP`` distinct extracts is not put into one task: its windows are halved by the place
   of the anchor in them. Each half has a longer string in common, by which it falls apart into smaller
   groups, and shorter extracts, of which more are equal; halves still too large are halved again, down to
   one window each, which is settled by its count alone. Nothing is capped.

Texts are shuffled once, and only the texts that hold a repeated anchor are kept after that. Substrings are
identified by 64-bit hashes.

Rules: null text is empty; strings never cross rows; repeated rows are copies of each other; rows of one id, or of none,
are told apart by their text; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.bytesview import Substrings, U, mix, slices
from riskweave.llm.gsaca import suffix_array
from riskweave.llm.shared import ship, stored

LENGTH = 200
GRAM = 80
GROUP = 1000
BATCH = 8000
_PLACE = 24                                   # bits of a position in the key of the sliding minimum
_SEGMENT = 1 << 23


def _anchors(data: np.ndarray, ends: np.ndarray, grams: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Positions of the anchors of one segment; ``ends[p]`` is where the text of byte p ends."""
    reach = length - gram + 1
    key = (grams >> U(_PLACE) << U(_PLACE)) | np.arange(len(grams), dtype=U)
    width = 1
    while width * 2 <= reach:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if reach > width:
        key = np.minimum(key[:len(key) - (reach - width)], key[reach - width:])
    starts = np.arange(len(key))
    low = (key[ends[:len(key)] - starts >= length] & U((1 << _PLACE) - 1)).astype(np.int64)
    return low[np.concatenate([[True], low[1:] != low[:-1]])] if len(low) else low


def anchors(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text, position in the text, hash of the gram, hash of the extract) of every anchor."""
    n = len(data)
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(U), empty.astype(U)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    sub = Substrings(data)
    at = np.arange(n - gram + 1)
    grams = sub(at, at + gram)
    found = []
    for a in range(0, n - length + 1, _SEGMENT):
        b = min(n, a + _SEGMENT + length - 1)
        found.append(a + _anchors(data[a:b], ends[a:b] - a, grams[a:b - gram + 1], length, gram))
    place = np.unique(np.concatenate(found))
    text = np.searchsorted(offsets, place, side="right") - 1
    left = np.minimum(place - offsets[text], length - gram)
    right = np.minimum(offsets[text + 1] - place, length)
    extract = mix(sub(place - left, place + right) ^ mix(left.astype(U) * U(1 << 20) + right.astype(U)))
    return text, place - offsets[text], grams[place], extract


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows with the key that tells texts apart: a 64-bit hash of id and text, and 31 more bits of the text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("did"),
                       F.shiftrightunsigned(F.xxhash64("text", F.lit(7)), 33).alias("th"), "text")


def _emit_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for a, _, offsets, data in slices(batch.column(2)):
                own, place, gram_, extract = anchors(offsets, data, length, gram)
                where = (th[a + own].astype(np.int64) << 32) | place
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram_.view(np.int64)), pa.array(extract.view(np.int64)), pa.array(did[a + own]), pa.array(where)],
                    ["h", "e", "did", "tp"])

    return run


_MEMBER = "g long, c long, did long, tp long, lo int, hi int, left int, data binary, n long"


def _emit_extracts(length: int, gram: int):
    """A member row for every marked anchor of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                did, th, text, marks = (batch.column(i)[row].as_py() for i in range(4))
                data, out = text.encode(), []
                for m in marks:
                    left, right = min(m["pos"], length - gram), min(len(data) - m["pos"], length)
                    out.append((m["g"], m["c"], did, (th << 32) | m["pos"], 0, length - gram, left,
                                data[m["pos"] - left:m["pos"] + right], m["n"]))
                if out:
                    yield _members(out)

    return run


def _members(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary(), pa.int64()]
    names = [x.split()[0] for x in _MEMBER.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(what, dtype=np.uint8) if what is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def block_size(length: int) -> int:
    return max(1, length // 5)


def search(batch: pa.RecordBatch, length: int, block: int, run: int) -> pa.RecordBatch:
    """(did, tp, low, high): what is repeated around the anchors of the members that occur once."""
    offsets, data = _buffer(batch.column("data"))
    g, c, did, tp, lo, hi, left = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7))
    centre, right = offsets[:-1] + left, np.diff(offsets) - left
    sub = Substrings(data)
    before, after = left // block, right // block
    count = before + after + 1                                      # blocks and the separator
    member = np.repeat(np.arange(len(g)), count)
    step = np.arange(len(member)) - np.repeat(np.cumsum(count) - count, count) - before[member]
    is_block = step < after[member]
    start = np.where(is_block, centre[member] + step * block, 0)
    symbols = np.zeros(len(member), dtype=np.int64)
    symbols[is_block] = np.unique(sub(start[is_block], start[is_block] + block), return_inverse=True)[1].ravel() + 1
    order = suffix_array(symbols)
    order = order[step[order] + run <= after[member[order]]]        # with a whole run before the separator
    alike = np.ones(max(0, len(order) - 1), dtype=bool)
    for j in range(run):
        alike &= symbols[order[1:] + j] == symbols[order[:-1] + j]
    near = np.zeros(len(order), dtype=bool)
    near[1:] |= alike
    near[:-1] |= alike
    held = order[near]
    shift = np.arange(block + 1)
    who = np.repeat(member[held], len(shift))
    j = (-(step[held] * block)[:, None] + shift[None, :]).ravel()   # bytes of the window before the anchor
    fits = (j >= lo[who]) & (j <= hi[who]) & (j <= left[who]) & (length - j <= right[who])
    code = np.unique(who[fits] * (length + 1) + j[fits])
    who, j = code // (length + 1), code % (length + 1)
    window = mix(sub(centre[who] - j, centre[who] - j + length) ^ mix(g[who].astype(U) * U(3) + j.astype(U)))
    _, kind = np.unique(window, return_inverse=True)
    kind = kind.ravel()
    again = (np.bincount(kind, weights=c[who], minlength=1)[kind] >= 2) & (c[who] == 1) if len(who) else np.zeros(0, bool)
    who, j = who[again], j[again]
    first = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    ids = who[at]
    low, high = (np.minimum.reduceat(j, at), np.maximum.reduceat(j, at)) if len(at) else (j, j)
    pos = tp[ids] & 0xFFFFFFFF
    # windows of one anchor overlap each other, so their union is one interval
    return pa.RecordBatch.from_arrays([pa.array(did[ids]), pa.array(tp[ids] >> 32), pa.array(pos - high), pa.array(pos - low + length)],
                                      ["did", "th", "low", "high"])


def _search_groups(length: int):
    block = block_size(length)
    run = min(j // block + (length - j) // block for j in range(length))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            """Search the complete groups; the last group may go on in the next batch."""
            nonlocal held, rows
            table = pa.Table.from_batches(held).combine_chunks()
            g = table.column("g").to_numpy()
            whole = len(g) if last else int(np.searchsorted(g, g[-1]))
            edges = np.append(np.flatnonzero(np.diff(g[:whole])) + 1, whole)
            a = 0
            while a < whole:
                b = int(edges[max(0, np.searchsorted(edges, a + BATCH, side="right") - 1)])
                b = b if b > a else int(edges[np.searchsorted(edges, a, side="right")])
                for part in table.slice(a, b - a).combine_chunks().to_batches():
                    yield search(part, length, block, run)
                a = b
            held = table.slice(whole).to_batches()
            rows = len(g) - whole

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
                if rows >= BATCH:
                    yield from settle(False)
        if rows:
            yield from settle(True)

    return work


_FOUND = "did long, th long, low long, high long"


def _halves(length: int):
    """Members with half of the windows each, keyed anew: ``g`` by what all windows share, ``e`` by all bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = _buffer(batch.column("data"))
            g, lo, hi, left = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("g", "lo", "hi", "left"))
            centre, right, sub = offsets[:-1] + left, np.diff(offsets) - left, Substrings(data)
            middle = (lo + hi) // 2
            for a, b in ((lo, middle), (middle + 1, hi)):
                low, high = np.maximum(a, length - right), np.minimum(b, left)     # the windows that fit
                ok = np.flatnonzero((low <= high) & (a <= b))
                if not len(ok):
                    continue
                x, y, s, t, mid = a[ok], b[ok], low[ok], high[ok], centre[ok]
                key = mix(sub(mid - x, mid + length - y) ^ mix(g[ok].astype(U) + (x * 1000 + y).astype(U)))
                own = mix(sub(mid - t, mid + length - s) ^ mix((s * 1000 + t).astype(U)))
                part = batch.take(pa.array(ok))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(own.view(np.int64)), part.column("c"), part.column("did"), part.column("tp"),
                     pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), part.column("left"), part.column("data"),
                     pa.array(s), pa.array(t)],
                    ["g", "e", "c", "did", "tp", "lo", "hi", "left", "data", "s", "t"])

    return run


def _large_groups(members: DataFrame, length: int, group: int) -> list[DataFrame]:
    """What is repeated around the members of groups of over ``group``."""
    out: list[DataFrame] = []
    while not members.isEmpty():
        parts = stored(members.select("g", "c", "did", "tp", "lo", "hi", "left", "data").mapInArrow(
            _halves(length), "g long, e long, c long, did long, tp long, lo int, hi int, left int, data binary, s long, t long"), "rep-halves")
        counts = parts.groupBy("g", "e").agg(F.sum("c").alias("total"), F.min(F.struct("did", "tp")).alias("pick"))
        sizes = counts.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("least"), F.sum("total").alias("all"))
        state = stored(counts.join(sizes.where("all > 1"), "g").select("g", "e", "total", "pick", "n", "least"), "rep-counts")
        parts = stored(parts.join(state, ["g", "e"]), "rep-parts")
        pos = F.col("tp").bitwiseAND(F.lit(0xFFFFFFFF))
        out.append(parts.where("total > 1 and c = 1").select("did", F.shiftright("tp", 32).alias("th"), (pos - F.col("t")).alias("low"),
                                                             (pos - F.col("s") + length).alias("high")))
        open_ = parts.where("least = 1 and n > 1").where(F.struct("did", "tp") == F.col("pick")).select(
            "g", F.col("total").alias("c"), "did", "tp", "lo", "hi", "left", "data", "n")
        out.append(_searched(open_.where(F.col("n") <= group), length))
        members = open_.where(F.col("n") > group)
    return out


def _searched(members: DataFrame, length: int) -> DataFrame:
    return members.repartition("g").sortWithinPartitions("g").mapInArrow(_search_groups(length), _FOUND)


def _apply(length: int, gram: int):
    """n_removed, n_spans, kept_sha256 and the kept bytes' spans of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                did, th, text, whole, found = (batch.column(i)[row].as_py() for i in range(5))
                data = text.encode()
                spans = [(max(0, p - (length - gram)), min(len(data), p + length)) for p in whole or []]
                spans += [(f["low"], f["high"]) for f in found or []]
                spans.sort()
                kept, end, removed, runs = [], 0, 0, 0
                for a, b in spans:
                    if a > end or not runs:
                        kept.append(data[end:a])
                        runs += 1
                        removed, end = removed + b - a, b
                    elif b > end:
                        removed, end = removed + b - end, b
                kept.append(data[end:])
                out.append((did, th, removed, runs, hashlib.sha256(b"".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(
                [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()])], ["did", "th", "n_removed", "n_spans", "kept_sha256"])

    return run


def strip_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                  group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    ship(docs.sparkSession)
    rows = _keyed(docs, doc_id, text)
    found = rows.select("did", "th", "text").where(F.octet_length("text") >= length).mapInArrow(
        _emit_anchors(length, gram), "h long, e long, did long, tp long")
    # counts are stored before they are joined, so that a join's stage holds no aggregate and a hot anchor can be split
    twice = stored(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "rep-twice")
    found = stored(found.join(twice, "h", "left_semi"), "rep-anchors")
    counts = found.groupBy("h", "e").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("did", "tp")).alias("pick"))
    counts = stored(counts, "rep-counts")
    sizes = counts.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"))
    sizes = stored(sizes.where("n > 1 and least = 1"), "rep-sizes")
    picks = counts.join(sizes, "h").select(F.col("h").alias("g"), "c", "n", "pick.did", "pick.tp")
    place = F.col("tp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos")
    key = F.shiftright("tp", 32).alias("th")
    whole = (found.join(counts.where("c > 1").select("h", "e"), ["h", "e"], "left_semi").select("did", key, place)
             .groupBy("did", "th").agg(F.collect_set("pos").alias("whole")))       # each place once, however often a row is repeated
    marks = picks.select("did", key, F.struct(place, "g", "c", "n").alias("m")).groupBy("did", "th").agg(F.collect_list("m").alias("marks"))
    touched = whole.join(marks, ["did", "th"], "full")
    # the one shuffle of texts
    held = stored(rows.select("did", "th", "text").join(touched, ["did", "th"]), "rep-texts")
    members = held.where("marks is not null").select("did", "th", "text", "marks").mapInArrow(_emit_extracts(length, gram), _MEMBER)
    members = stored(members, "rep-members")
    pieces = [_searched(members.where(F.col("n") <= group), length), *_large_groups(members.where(F.col("n") > group), length, group)]
    spans = pieces[0]
    for p in pieces[1:]:
        spans = spans.unionByName(p)
    spans = stored(spans, "rep-spans").groupBy("did", "th").agg(F.collect_list(F.struct("low", "high")).alias("found"))
    done = held.select("did", "th", "text", "whole").join(spans, ["did", "th"], "left").select("did", "th", "text", "whole", "found").mapInArrow(
        _apply(length, gram), "did long, th long, n_removed long, n_spans long, kept_sha256 string")
    done = done.dropDuplicates(["did", "th"]).withColumnRenamed("kept_sha256", "kept")
    thin = rows.select("doc_id", "did", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("all_"))
    return thin.join(done, ["did", "th"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "all_").alias("kept_sha256"))
