"""Near duplicates with DartMinHash signatures and banded joins.

A text is a weighted set: its shingles of five words, weighted by how often they occur. Two texts are
linked if their weighted Jaccard similarity is at least ``threshold``; classes are the components of the
links.

Signatures. The darts are a fixed random pattern over (shingle, weight, rank): every unit cell of weight of
every shingle holds a Poisson number of darts in each layer of ranks, all derived from hashes. A text's
region is each shingle up to its weight. A dart in the region goes to one of ``BANDS * ROWS`` coordinates
by its hash, and each coordinate keeps its earliest dart (lowest rank). Two texts agree in a coordinate
with probability equal to their similarity. Layers of rank double in width and a text leaves the throwing
as soon as all its coordinates are filled, so a text of n shingles costs about n + k log k darts,
whatever k is.

Joining. ``ROWS`` coordinates make a band key, texts that share a key of a band are a bucket. No bucket is
ever collected or paired up in full:

1. each member is compared with the smallest text of its bucket (a join on the pre-aggregated minimum,
   which Spark splits where it is skewed), exactly, on the whole texts; the links give components;
2. members of one bucket that ended in different components meet in cells of at most two blocks (a bucket
   of over ``BLOCK`` members or ``BLOCK_WEIGHT`` shingles is dealt to all pairs of its blocks). There their
   whole signatures tell which members have a partner whose agreement is at most ``MARGIN`` standard
   deviations under the threshold; these members alone get their texts, and the cell compares such pairs
   exactly, each pair in the first band it shares (a band key is made of the bits of the signature, so no
   pair agrees in a band without sharing its bucket). A cell returns only links that join components. So
   neither a passage that many unlike texts share nor a large group of half-alike texts makes rows of pairs.

Exact copies are one node throughout (the MD5 of the text).

At similarity 0.8 a pair misses all bands with probability (1 - 0.8**5)**28, about 2e-5.

Rules: null text counts as empty; texts without words have no shingles and are linked to exact copies
only; a text of fewer than five words has one shingle of all its words; words end at ASCII white space;
repeated ids with different texts are different rows; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.bytesview import U, mix, shingles, slices, unit, words
from riskweave.llm.components import components
from riskweave.llm.shared import lean, narrow, ship, stored

SIZE = 5
THRESHOLD = 0.8
BANDS = 28
ROWS = 5
BLOCK = 512
BLOCK_WEIGHT = 400_000
#: Standard deviations that the agreement of signatures may lie under the threshold.
MARGIN = 5.3
_FIRST_LAYER = 2.0 ** -6


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson variable."""
    top = int(mean + 12 * math.sqrt(mean) + 12)
    logs = np.array([-mean + i * math.log(mean) - math.lgamma(i + 1) for i in range(top)])
    return np.cumsum(np.exp(logs))


_LAYERS = [(0.0, _FIRST_LAYER)]
while _LAYERS[-1][1] < 2.0 ** 13:
    _LAYERS.append((_LAYERS[-1][1], _LAYERS[-1][1] * 2))
_CUMULATIVE = [_poisson(high - low) for low, high in _LAYERS]


def dart_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int, seed: int = 0) -> np.ndarray:
    """Signatures (n x k ranks) of n weighted sets given as rows (owner, element, weight), owners ascending.

    Sets without weight keep infinite ranks. The rank of a dart identifies it: it carries 53 random bits."""
    cells = np.ceil(weight).astype(np.int64)
    row = np.repeat(np.arange(len(owner)), cells)
    level = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
    cell = mix(mix(element[row] + U(seed)) ^ mix(level.astype(U) + U(0x51ED)))
    room = weight[row] - level                # how much of the unit cell is in the region
    owner = owner[row]
    partial = bool((room < 1).any())
    best = np.full(n * k, np.inf)
    open_ = np.arange(len(cell))
    for number, ((low, high), cumulative) in enumerate(zip(_LAYERS, _CUMULATIVE)):
        if not len(open_):
            break
        throw = mix(cell[open_] + U(number * 0x9E3779B1 + 1))
        u = unit(throw)
        hit = np.flatnonzero(u >= cumulative[0])
        count = np.searchsorted(cumulative, u[hit], side="right")
        which = np.repeat(hit, count)
        order = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(throw[which] ^ mix(order.astype(U) + U(77)))
        at = open_[which]
        if partial:
            inside = unit(mix(dart + U(3))) < room[at]
            dart, at = dart[inside], at[inside]
        place = owner[at] * k + (mix(dart + U(9)) % U(k)).astype(np.int64)
        np.minimum.at(best, place, low + (high - low) * unit(dart))
        full = np.isfinite(best.reshape(n, k)).all(axis=1)
        open_ = open_[~full[owner[open_]]]
    return best.reshape(n, k)


def weighted_shingles(offsets: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), ordered by text."""
    n = len(offsets) - 1
    text, word = words(offsets, data)
    text, sh = shingles(text, word, n, size)
    order = np.lexsort((sh, text))
    text, sh = text[order], sh[order]
    new = np.ones(len(sh), dtype=bool)
    new[1:] = (sh[1:] != sh[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], sh[at], np.diff(np.append(at, len(sh)))


def _bands(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in slices(batch.column("text")):
                text, sh, count = weighted_shingles(offsets, data, size)
                ranks = dart_minhash(text, sh, count.astype(np.float64), b - a, bands * rows)
                # keys are made of the very bits that signatures carry: texts agree in all rows of a band there
                # if and only if they share its bucket, so the first shared band of a pair is known from signatures
                short = (ranks.view(U) >> U(16)).astype(np.uint16).reshape(b - a, bands, rows)
                key = np.zeros((b - a, bands), dtype=U)
                for j in range(rows):
                    key = mix(key * U(31) + short[:, :, j].astype(U))
                some = np.isin(np.arange(b - a), text)
                at = np.flatnonzero(some)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * bands, pa.int32()),
                                                 pa.array(key[at].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a).take(pa.array(at)), lists,
                                                  pa.array([x.tobytes() for x in short[at]], pa.binary()),
                                                  pa.array(np.bincount(text, minlength=b - a)[at])], ["node", "keys", "signature", "weight"])

    return run


def _similar(size: int):
    """Weighted Jaccard similarity of the texts of each pair, whole texts, exact but for hash collisions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            for i in range(0, n, 256):
                part = batch.slice(i, 256)
                m = part.num_rows
                sides = []
                for name in ("ta", "tb"):
                    own, sh, count = [], [], []
                    for a, _, offsets, data in slices(part.column(name)):
                        t, s, c = weighted_shingles(offsets, data, size)
                        own.append(t + a)
                        sh.append(s)
                        count.append(c)
                    sides.append((np.concatenate(own), np.concatenate(sh), np.concatenate(count)))
                own = np.concatenate([sides[0][0], sides[1][0]])
                sh = np.concatenate([sides[0][1], sides[1][1]])
                count = np.concatenate([sides[0][2], sides[1][2]])
                order = np.lexsort((sh, own))
                own, sh, count = own[order], sh[order], count[order]
                same = (own[1:] == own[:-1]) & (sh[1:] == sh[:-1])
                both = np.bincount(own[1:][same], weights=np.minimum(count[1:], count[:-1])[same], minlength=m)
                every = np.bincount(own, weights=count, minlength=m) - both
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(both / np.maximum(every, 1))], ["a", "b", "sim"])

    return run


def _likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (ascending shingles, counts)."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    both = int(np.minimum(a[1][at], b[1])[same].sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


_CELL = "cell long, node binary, part long, block int, one int, band int, signature binary"


def _cells(threshold: float, bands: int, rows: int, size: int, exact: bool):
    """Over cells: their members that have a likely partner, or (``exact``, with texts) the links found."""
    least = threshold * bands * rows - MARGIN * math.sqrt(threshold * (1 - threshold) * bands * rows)

    def work(cell: pa.Table) -> pa.Table:
        m = cell.num_rows
        part, block, one, band = (cell.column(x).to_numpy() for x in ("part", "block", "one", "band"))
        signs = np.frombuffer(b"".join(cell.column("signature").to_pylist()), dtype=np.uint16).reshape(m, bands * rows)
        sets, top, likely, links = [], {int(x): int(x) for x in part}, np.zeros(m, dtype=bool), []
        if exact:
            for text in cell.column("text").to_pylist():
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                sets.append(weighted_shingles(np.array([0, len(data)]), data, size)[1:])

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for i in range(m - 1):
            meet = i + 1 + np.flatnonzero((part[i + 1:] != part[i]) & (bool(one[i]) | (block[i + 1:] != block[i])))
            if not len(meet):
                continue
            equal = signs[meet] == signs[i]
            near = equal.sum(axis=1) >= least
            first = equal[near].reshape(-1, bands, rows).all(axis=2).argmax(axis=1) == band[i]
            meet = meet[near][first]
            if not exact:
                likely[meet] = True
                likely[i] |= len(meet) > 0
                continue
            for j in meet:
                x, y = root(int(part[i])), root(int(part[j]))
                if x != y and _likeness(sets[i], sets[j]) >= threshold:
                    top[x] = y
                    links.append((i, int(j)))
        if exact:
            node = cell.column("node").to_pylist()
            return pa.table([pa.array([node[k[s]] for k in links], pa.binary()) for s in (0, 1)], ["a", "b"])
        return cell.filter(pa.array(likely))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            cell = table.column("cell").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1])
            for a, b in zip(edges[:-1], edges[1:]):
                yield from work(table.slice(a, b - a)).combine_chunks().to_batches()
            held = table.slice(edges[-1])
        if held is not None and held.num_rows:
            yield from work(held).combine_chunks().to_batches()

    return run


def _compare(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b, sim) of pairs of nodes; ``texts`` has (node, text)."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(lean(_similar(size)), "a binary, b binary, sim double")


def _node(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SIZE,
            bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node (binary key of the text), part (smallest node of the class), class_id (smallest id of the
    class) and class_size, one row per input row."""
    ship(docs.sparkSession)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.select("doc_id", "text", _node(F.col("text")).alias("node"))
    members = stored(base.select("doc_id", "node"), "dup-node")
    one = members.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    keys = stored(base.select("node", "text").mapInArrow(lean(_bands(size, bands, rows)), "node binary, keys array<long>, signature binary, weight long"),
                  "dup-keys")
    flat = keys.select("node", F.posexplode("keys").alias("band", "key")).select(
        F.xxhash64("band", "key").alias("bucket"), "band", "node")
    low = flat.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("high")).where("lead < high").drop("high")
    low = stored(narrow(low), "dup-low")              # as a table, so that the join can split a hot bucket
    # the buckets of two texts or more, copies counted once
    shared = flat.join(low, "bucket").where("node != lead").groupBy("bucket", "lead", "node").agg(F.min("band").alias("band"))
    shared = stored(narrow(shared), "dup-shared")
    star = shared.select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    wanted = shared.select("node").unionByName(shared.select(F.col("lead").alias("node"))).distinct()
    pick = one.join(wanted, "node", "left_semi").select(F.col("node").alias("n_"), F.col("first").alias("f_"))
    texts = base.join(pick, F.col("doc_id").eqNullSafe(F.col("f_")) & (F.col("node") == F.col("n_"))).select("node", "text")
    texts = stored(texts, "dup-text")
    compared = stored(_compare(star, texts, size), "dup-star")
    found = compared.where(F.col("sim") >= threshold).select("a", "b")
    parts = components(found)
    # members of one bucket in different components
    signs = keys.dropDuplicates(["node"]).select("node", "signature", "weight")
    named = (shared.join(parts.withColumnRenamed("id", "node"), "node", "left")
             .select("bucket", "band", "node", F.coalesce("part", "node").alias("part")).join(signs, "node"))
    mixed = named.groupBy("bucket").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("weight") / BLOCK_WEIGHT)).cast("int").alias("blocks")).where("x != y")
    mixed = stored(narrow(mixed.select("bucket", "blocks")), "dup-mixed")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = (named.join(mixed, "bucket").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "node",
                     F.xxhash64("part").alias("part"), "block", (F.col("block") == F.col("other")).cast("int").alias("one"), "band", "signature"))

    def in_cells(rows_: DataFrame, schema: str, exact: bool) -> DataFrame:
        return rows_.repartition("cell").sortWithinPartitions("cell").mapInArrow(lean(_cells(threshold, bands, rows, size, exact)), schema)

    likely = stored(in_cells(cells, _CELL, False), "dup-likely")
    more = stored(in_cells(likely.join(texts, "node").select("cell", "node", "part", "block", "one", "band", "signature", "text")
                           .dropDuplicates(["cell", "node"]), "a binary, b binary", True), "dup-rest")
    if not more.isEmpty():
        parts = components(found.unionByName(more))
    nodes = one.join(parts.withColumnRenamed("id", "node"), "node", "left").select(
        "node", F.coalesce("part", "node").alias("part"), "first", "copies")
    nodes = stored(narrow(nodes), "dup-nodes")
    sizes = nodes.groupBy("part").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    named = nodes.join(sizes, "part").select("node", "part", "class_id", "class_size")
    return members.join(named, "node").select("doc_id", "node", "part", "class_id", "class_size")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The input rows without all but one of each class: the one of the smallest id stays (of repeated
    smallest ids, one)."""
    held = classes(docs, doc_id, text, **how).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    held = held.groupBy("part").agg(F.min("class_id").alias("id"), F.min("node").alias("node")).drop("part")
    held = stored(narrow(held), "dup-held")
    # the columns of the input travel as one, so that theirs may have any name
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("own"),
                       _node(F.coalesce(F.col(text), F.lit(""))).alias("mark"))
    kept = rows.join(held, F.col("own").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("node")), "left_semi")
    return kept.dropDuplicates(["own", "mark"]).select("row.*")
