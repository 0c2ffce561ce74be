"""Fill-in-middle transformation over a piece table.

A task views its texts as one immutable UTF-8 buffer (the Arrow column) beside one buffer of sentinels. A
document is a descriptor (buffer, start, end). Cutting splits it into prefix, middle and suffix; a form is
a permutation of these three and the three sentinels. Outputs are written once from their descriptors, and
digests stream over them. ``restore`` finds the sentinels of an output, left to right, which gives descriptors
in the order of the form; the inverse permutation puts them back, and the first three are the text.

Rules: a null text is empty. Texts that are empty or hold a sentinel stay plain, so an output is never
ambiguous. Draws depend on doc_id and seed only, so repeated rows and reruns agree; a null doc_id draws as the empty
string. Texts of any length are cut whole: memory follows the longest text, about three times its bytes.
Empty tables give empty results; other columns are not read and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.bytesview import slices
from riskweave.llm.shared import ship

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Prefix, suffix and middle sentinel.
SENTINELS = (b"<P>", b"<S>", b"<M>")
#: What each form strings together, as indices of (prefix, middle, suffix, <P>, <S>, <M>).
ORDER = {PSM: np.array([3, 0, 4, 2, 5, 1]), SPM: np.array([4, 2, 3, 0, 5, 1])}
_BLOCK = 4096


class CodePoints:
    """Byte positions of code points in a UTF-8 buffer: counts by block, and a search within one block."""

    def __init__(self, data: np.ndarray):
        self.lead = (data & 0xC0) != 0x80
        whole = len(data) // _BLOCK * _BLOCK
        sums = self.lead[:whole].reshape(-1, _BLOCK).sum(axis=1)
        self.before = np.concatenate([[0], np.cumsum(sums)]).astype(np.int64)

    def count(self, at: int) -> int:
        """Code points before byte ``at``."""
        block = at // _BLOCK
        return int(self.before[block]) + int(np.count_nonzero(self.lead[block * _BLOCK:at]))

    def place(self, number: int) -> int:
        """The byte at which code point ``number`` begins; the end of the buffer for the number of all."""
        block = int(np.searchsorted(self.before, number, side="right")) - 1
        inside = np.flatnonzero(self.lead[block * _BLOCK:(block + 1) * _BLOCK])
        k = number - int(self.before[block])
        return block * _BLOCK + int(inside[k]) if k < len(inside) else len(self.lead)


class PieceTable:
    """Descriptors (buffer, start, end) over immutable buffers."""

    def __init__(self, *buffers):
        self.buffers = [memoryview(b) for b in buffers]

    def stream(self, pieces: list[tuple[int, int, int]]) -> Iterator[memoryview]:
        for buffer, start, end in pieces:
            yield self.buffers[buffer][start:end]

    def sha256(self, pieces: list[tuple[int, int, int]]) -> str:
        state = hashlib.sha256()
        for view in self.stream(pieces):
            state.update(view)
        return state.hexdigest()

    def written(self, pieces: list[tuple[int, int, int]]) -> bytes:
        return b"".join(self.stream(pieces))


def cut(piece: tuple[int, int, int], first: int, second: int) -> list[tuple[int, int, int]]:
    """Prefix, middle and suffix of a descriptor, split at two places of its buffer."""
    buffer, start, end = piece
    return [(buffer, start, first), (buffer, first, second), (buffer, second, end)]


def arrange(pieces: list, order: np.ndarray) -> list:
    return [pieces[i] for i in order]


def unarrange(pieces: list, order: np.ndarray) -> list:
    return [pieces[i] for i in np.argsort(order)]


def draws(doc_id: int | None, seed: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4)]


def found(raw: bytes, order: np.ndarray, marks: tuple[bytes, ...]) -> list[tuple[int, int, int]]:
    """Descriptors of an output over itself, in the order of its form: its sentinels and what is between them."""
    pieces, at = [], 0
    sentinels = [int(i) - 3 for i in order if i >= 3]
    for k, which in enumerate(sentinels):
        start = raw.find(marks[which], at)
        if start < 0 or (k == 0 and start):
            raise ValueError("an output without its sentinels")
        if k:
            pieces.append((0, at, start))
        at = start + len(marks[which])
        pieces.append((0, start, at))
    return pieces + [(0, at, len(raw))]


_FIELDS = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
           ("middle_chars", pa.int64()), ("output", pa.large_string()), ("output_sha256", pa.string())]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plain_from: int = 90, spm_below: int = 20,
              seed: str = "1", marks: tuple[bytes, ...] = SENTINELS) -> DataFrame:
    """One row per document: doc_id, n (code points), form, prefix_chars, middle_chars (null if plain), output, output_sha256.

    Of 100 documents ``plain_from`` are rearranged, ``spm_below`` in 100 of them suffix first. ``marks`` must
    be such that none can begin inside another (``<P>``: the first byte occurs once in each)."""
    if any(m.find(n[:1], 1) >= 0 for m in marks for n in marks) or len(set(marks)) < len(marks):
        raise ValueError("sentinels must differ, and hold their first bytes at the start only")
    ship(docs.sparkSession)
    joined, starts = b"".join(marks), np.cumsum([0, *map(len, marks)]).tolist()
    ends = [(1, starts[i], starts[i + 1]) for i in range(3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = batch.column(0)
            for a, b, offsets, data in slices(batch.column(1)):
                table, points, raw, rows = PieceTable(data, joined), CodePoints(data), memoryview(data), []
                edge = points.count(0)
                for i, name in enumerate(who.slice(a, b - a).to_pylist()):
                    start, end = int(offsets[i]), int(offsets[i + 1])
                    here, edge = edge, points.count(end)
                    n = edge - here
                    h1, h2, h3, h4 = draws(name, seed)
                    whole = (0, start, end)
                    held = bytes(raw[start:end])
                    if not n or h3 % 100 >= plain_from or any(m in held for m in marks):
                        rows.append((name, n, PLAIN, None, None, held, table.sha256([whole])))
                        continue
                    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                    form = SPM if h4 % 100 < spm_below else PSM
                    pieces = cut(whole, *(end if k == n else points.place(here + k) for k in (low, high)))
                    pieces = arrange(pieces + ends, ORDER[form])
                    rows.append((name, n, form, low, high - low, table.written(pieces), table.sha256(pieces)))
                yield _batch(rows, _FIELDS)

    inner = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return inner.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    arrays = []
    for i, (_, kind) in enumerate(fields):
        values = [r[i] for r in rows]
        arrays.append(pa.array(values, pa.large_binary()).cast(kind) if pa.types.is_large_string(kind) else pa.array(values, kind))
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def restore(outputs: DataFrame, keep: tuple[str, ...] = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"),
            output: str = "output", form: str = "form", with_text: bool = False, marks: tuple[bytes, ...] = SENTINELS) -> DataFrame:
    """The columns of ``keep``, restored_sha256 (and ``restored``, the text): rebuilt from output and form alone."""
    ship(outputs.sparkSession)
    kept = outputs.select(*keep, F.col(output).alias("r_output"), F.col(form).alias("r_form"))
    fields = [("restored_sha256", pa.string())] + [("restored", pa.large_string())] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 2
            forms = batch.column(n + 1)
            for a, b, offsets, data in slices(batch.column(n)):
                raw, rows = memoryview(data), []
                for i, kind in enumerate(forms.slice(a, b - a).to_pylist()):
                    held = bytes(raw[int(offsets[i]):int(offsets[i + 1])])
                    table, pieces = PieceTable(held), [(0, 0, len(held))]
                    if kind in ORDER:
                        pieces = unarrange(found(held, ORDER[kind], marks), ORDER[kind])[:3]
                    rows.append((table.sha256(pieces), table.written(pieces) if with_text else None)[:len(fields)])
                made = _batch(rows, fields)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made.columns], [*part.schema.names[:n], *made.schema.names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-2]] + ["restored_sha256 string"] + ["restored string"] * with_text)
    return kept.mapInArrow(run, schema)
