"""Context-triggered piecewise hashing of documents.

A rolling hash over the last seven bytes cuts a text wherever it hits the block size's trigger value, so
cuts follow content. Each chunk contributes one character, the hash of its bytes. The block size starts
where the text would give ``LENGTH`` chunks and is halved while there are too few. A fingerprint is
``blocksize:signature:signature at twice the blocksize``. Two fingerprints compare by edit distance where
they share a block size; the likeness is ``1 - distance / length of the longer``, 0 without a shared size.

Neighbours: ``with_next`` gives each document the one that follows in ascending id, without a global
sort in one task. Ids are cut at quantiles into ranges, each task sorts one range, and the first document
of each range is sent to the range before it as well (that of the first range to the last).

Rules: null text is empty; the fingerprint of an empty text is ``3::``; two empty signatures are alike
(1.0); ties of ids are ordered by text; null ids come last; a single document is its own next; an empty
table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.bytesview import Substrings
from riskweave.llm.shared import ship

WINDOW = 7
SMALLEST = 3
LENGTH = 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the last ``WINDOW`` bytes at every position: sum, weighted sum and shift-xor added."""
    n, wide = len(data), data.astype(np.uint32)
    plain, weighted, xored = wide.copy(), wide * np.uint32(WINDOW), wide.copy()
    for j in range(1, min(WINDOW, n)):
        past = wide[:n - j]
        plain[j:] += past
        weighted[j:] += past * np.uint32(WINDOW - j)
        xored[j:] ^= past << np.uint32(5 * j)
    return plain + weighted + xored


def _signature(hashes: np.ndarray, chunks: Substrings, n: int, block: int) -> str:
    ends = np.flatnonzero(hashes % np.uint32(block) == np.uint32(block - 1)) + 1
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    if len(ends) > LENGTH:                    # the rest of the text is one chunk, as signatures have a bounded length
        ends = np.append(ends[:LENGTH - 1], n)
    starts = np.concatenate([[0], ends[:-1]])
    return ALPHABET[(chunks(starts, ends) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    if not len(data):
        return f"{SMALLEST}::"
    hashes, chunks, block = rolling(data), Substrings(data), SMALLEST
    while block * LENGTH < len(data):
        block *= 2
    while True:
        signature = _signature(hashes, chunks, len(data), block)
        if len(signature) >= LENGTH // 2 or block == SMALLEST:
            return f"{block}:{signature}:{_signature(hashes, chunks, len(data), block * 2)}"
        block //= 2


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprint columns."""
    pa_, pb = F.split(a, ":"), F.split(b, ":")
    size_a, size_b = pa_[0].cast("long"), pb[0].cast("long")

    def alike(x: Column, y: Column) -> Column:
        return F.when((F.length(x) == 0) & (F.length(y) == 0), F.lit(1.0)).otherwise(
            1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))

    return (F.when(a == b, F.lit(1.0))
            .when(size_a == size_b, F.greatest(alike(pa_[1], pb[1]), alike(pa_[2], pb[2])))
            .when(size_a == size_b * 2, alike(pa_[1], pb[2]))
            .when(size_b == size_a * 2, alike(pa_[2], pb[1]))
            .otherwise(F.lit(0.0)))


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by the start of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


_LAST = (1 << 63) - 1


def _longs(values: list[int]) -> Column:
    """A constant array; one literal in the plan however many values it has."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def ranges(docs: DataFrame, doc_id: str, text: str, rows_per_range: int = 2000) -> tuple[DataFrame, int]:
    """((range, place, id_, text, ghost), number of ranges): every row in its range, and the rows of the
    smallest id of each range again as ghosts at the end of the range before it. Only quantiles and the
    smallest id of each range reach the driver, at most 10,000 numbers each; beyond so many ranges they
    get more rows, which the tasks sort and stream."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id_"), F.col(text).alias("text"),
                       F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("place"))
    n = rows.count()
    wanted = min(10_000, n // rows_per_range)
    cuts = sorted({int(x) for x in rows.approxQuantile(
        "place", [i / (wanted + 1) for i in range(1, wanted + 1)], 1 / (4 * (wanted + 1)))}) if wanted else []
    at = _bucket(_longs(cuts), F.col("place"), len(cuts)) if cuts else F.lit(0)
    rows = rows.withColumn("range", at.cast("int"))
    first = {r["range"]: r["low"] for r in rows.groupBy("range").agg(F.min("place").alias("low")).collect()}
    held = sorted(first)
    before = {x: held[i - 1] for i, x in enumerate(held)}   # held[-1] precedes held[0]
    every = range(len(cuts) + 1)
    own = F.struct(F.col("range"), F.lit(False).alias("ghost"))
    sent = F.struct(F.get(_longs([before.get(x, 0) for x in every]), F.col("range")).cast("int").alias("range"),
                    F.lit(True).alias("ghost"))
    is_first = F.col("place") == F.get(_longs([first.get(x, 0) for x in every]), F.col("range"))
    rows = rows.select("id_", "place", "text", F.explode(F.when(is_first, F.array(own, sent)).otherwise(F.array(own))).alias("h"))
    return rows.select("h.range", "place", "id_", "text", "h.ghost"), max(1, len(held))


def _bucket(edges: Column, x: Column, n: int) -> Column:
    """How many of the sorted edges are at most x, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, n.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= n) & (F.coalesce(F.get(edges, at + step - 1), F.lit(0)) <= x), at + step).otherwise(at))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint, near_edited,
    near_next for each row."""
    ship(docs.sparkSession)
    rows, n = ranges(docs, doc_id, text)
    rows = rows.repartition(n, "range").sortWithinPartitions("range", "ghost", "place", F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                           # the row whose next is not known yet
        for batch in batches:
            out: list[tuple] = []
            for place, name, content, ghost in zip(*(batch.column(i) for i in (0, 2, 3, 4))):
                place, ghost, content = place.as_py(), ghost.as_py(), content.as_py() or ""
                if held is not None and held[0] == place:
                    if held[4] is None:
                        held[4] = fingerprint(held[2])
                    other = edited(held[2], content)
                    mark = fingerprint(content)
                    out.append((held[1], len(held[2]), hashlib.sha256(other.encode()).hexdigest(), held[4],
                                fingerprint(other), mark))
                    held = None if ghost else [place, name.as_py(), content, ghost, mark]
                elif not ghost:
                    held = [place, name.as_py(), content, ghost, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.int64()] + [pa.string()] * 4)],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"])

    made = rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                "edited_fingerprint string, next_fingerprint string")
    return made.select("*", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
