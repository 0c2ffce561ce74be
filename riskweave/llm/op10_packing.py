"""Packing documents into windows of at most ``capacity`` tokens by multiway differencing (Karmarkar-Karp).

Each task tokenises its documents and packs them in batches of a bounded number of tokens. Documents are
cut into items of at most ``ITEM`` ids (shorter ones where those don't fit). The items go through Karmarkar-Karp differencing for ``k``
windows: every item starts as a partial partition with one non-empty subset, and the two partial
partitions of the largest imbalance are merged so that the heavy subsets of one meet the light subsets of
the other, until one partition is left. If its heaviest window is over the capacity, the batch is partitioned again with items
of half the length, down to ``ITEM / 8``, and then with more windows: the count rises until all fit.

A batch rarely fills its last window. Its surplus, cut from the end of the last document, goes to
sequences whose lengths are powers of two (which need no padding), so that what is left fills ``k``
windows but for ``SLACK`` ids each.

No shuffle: a task's sequences hold its own documents only, and ids of sequences carry the partition
number. Rules: a null text is empty; an empty text still has the end id; empty input gives no row;
repeated rows are packed each; other columns are not read.
"""

from __future__ import annotations

import gc
import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.shared import lean, ship

CAPACITY = 4096
ITEM = 512
SLACK = 6
_SUM = itemgetter(0)
BATCH_TOKENS = 128 * CAPACITY
#: Bytes that the remembered words and pieces may take, about, what one takes with its ids, and the longest of them.
WORD_BYTES = 224 << 20
ENTRY_BYTES = 240
LONGEST = 64


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` dealt to ``k`` subsets of nearly equal sums.

    A partial partition is (subsets sorted by falling sum); subsets it lacks are empty. Members are kept
    as nested pairs and flattened once at the end, so a merge costs its number of subsets."""
    if k <= 1:
        return [list(range(len(sizes)))][:k]
    heap: list = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        meet = len(a) + len(b) - k          # so many subsets of each find no empty partner
        if meet <= 0:
            merged = a + b
        else:
            tail = len(a) - meet
            merged = a[:tail] + b[:len(b) - meet]
            merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[tail:], reversed(b[len(b) - meet:]))]
        merged.sort(key=_SUM, reverse=True)
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[0][0], serial, merged))
        serial += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        got, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                got.append(x)
        out.append(got)
    return out + [[] for _ in range(k - len(out))]


def pack(lengths: list[int], capacity: int = CAPACITY, item: int = ITEM) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) over documents of ``lengths`` ids."""
    pieces = [(d, s, min(item, n - s)) for d, n in enumerate(lengths) for s in range(0, n, item)]
    total = sum(lengths)
    out: list[list[tuple[int, int, int]]] = []
    k = total // (capacity - SLACK)
    surplus = total - k * (capacity - SLACK)
    if k == 0 or surplus < capacity:
        room = 1 << max(0, surplus.bit_length() - 1)
        current: list[tuple[int, int, int]] = []
        while surplus > 0:                  # from the end: sequences of 2048, 1024, ... as the surplus has bits
            d, s, n = pieces.pop()
            while not surplus & room:
                room >>= 1
            used = sum(p[2] for p in current)
            take = min(n, room - used)
            if take < n:
                pieces.append((d, s, n - take))
            current.append((d, s + n - take, take))
            if used + take == room:
                out.append(current)
                current, surplus = [], surplus - room
                room >>= 1
    k, longest = max(1, k) if pieces else 0, item
    while k:
        sizes = [p[2] for p in pieces]
        windows = karmarkar_karp(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            out += [[pieces[i] for i in sorted(w)] for w in windows if w]
            break
        if longest > item // 8:
            longest //= 2
            pieces = [(d, a, min(longest, s + n - a)) for d, s, n in pieces for a in range(s, s + n, longest)]
        else:
            k += 1
    return out


#: Composed Latin letters, with their lower case, and the letter that stands for each byte in a byte-level vocabulary.
_LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0139-\u0148\u014a-\u0177"
_LATIN = re.compile(f"[!-~{_LETTERS}]+")
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(b) for b in _OWN} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _OWN)}


class Encoder(dict):
    """Ids of texts. A text is encoded word by word at blanks and line ends, where this vocabulary never
    joins tokens, and the ids of words are remembered as bytes (the items of this dict), up to a bound in bytes.

    A new word passes the tokenizer's own steps: normalizer, pre-tokenizer, and once for each different piece
    the model. For a word of printable ASCII and composed Latin letters the first two are lower case, the pre-tokenizer's
    pattern, and the letters that stand for bytes, if the file has these steps; a piece of such a word is a word that is its
    own only piece, so both are kept in one place. A text that may hold an added token of the file goes to the tokenizer whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        tok = Tokenizer.from_file(path)
        made = json.loads(tok.to_str())
        self.tokenize, self.normalizer, self.pre_tokenizer = tok.model.tokenize, tok.normalizer, tok.pre_tokenizer
        self.pieces: dict[str, bytes] = {}
        self.ids = [i.to_bytes(4, "little") for i in range(1 + max(made["model"]["vocab"].values()))]
        self.cut, self.tok, self.added = _ascii_pattern(made), tok, _added_pattern(made)

    def _model(self, piece: str) -> bytes:
        ids = self.ids
        return b"".join([ids[t.id] for t in self.tokenize(piece)])

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self._model(piece)
            if len(piece) <= LONGEST:
                self.pieces[piece] = got
        return got

    def __missing__(self, word: str) -> bytes:
        plain, low = word.isascii(), word.lower()
        if self.cut is None or not (word.isprintable() if plain else _LATIN.fullmatch(word)):
            got = b"".join([self._piece(p) for p, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(word))])
        elif low == word and (word.isalpha() or self.cut.fullmatch(word)):          # letters are one piece
            got = self._model(word if plain else word.encode().decode("latin-1").translate(_BYTES))
        else:
            got = b"".join([self[p] for p in self.cut.findall(low)])
        if len(word) <= LONGEST:
            self[word] = got
        return got

    def __call__(self, texts: list[str], end: int) -> list[np.ndarray]:
        out, last, get = [], end.to_bytes(4, "little"), self.__getitem__
        for text in texts:
            if self.added is not None and self.added.search(text):
                out.append(np.array([*self.tok.encode(text, add_special_tokens=False).ids, end], dtype="<u4"))
                continue
            if ENTRY_BYTES * (len(self) + len(self.pieces)) > WORD_BYTES:
                self.clear()
                self.pieces.clear()
                self[""] = b""
            out.append(np.frombuffer(b"".join(map(get, text.replace("\n", " ").split(" "))) + last, dtype="<u4"))
        return out


def _added_pattern(made: dict):
    """What finds the added tokens, in any case for those that are matched in normalized text; None without any."""
    forms = [f"(?i:{re.escape(x['content'])})" if x["normalized"] else re.escape(x["content"]) for x in made.get("added_tokens") or []]
    return re.compile("|".join(forms)) if forms else None


#: A pattern each of whose matches is, read alone, its own only match.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _ascii_pattern(made: dict):
    """The pattern of the pre-tokenizer with its classes as they are in ASCII; None for a file of other steps or another pattern."""
    lower = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    steps = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
    if not lower or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
        return None
    split, as_bytes = steps
    if (split["pattern"], split["behavior"], split["invert"], as_bytes["add_prefix_space"], as_bytes["use_regex"]) != (
            {"Regex": _PATTERN}, "Removed", True, False, False):
        return None
    return re.compile(_PATTERN.replace(r"\p{L}", "A-Za-z" + _LETTERS).replace(r"\p{N}", "0-9"))


def sequences(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2,
              capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids).

    ``tokenizer`` is the name of a file of the installed ``public_tokenizers`` package or a path."""
    ship(docs.sparkSession)
    inner = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if os.sep not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        gc.disable()                            # many small lists live for a moment, none of them in a cycle; ``lean`` ends this
        encode, part = Encoder(path), TaskContext.get().partitionId()
        serial, names, ids, held = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal serial, names, ids, held
            rows: list[tuple] = []
            for seq in pack([len(x) for x in ids], capacity):
                at, number = 0, (part << 40) | serial
                for d, s, n in seq:
                    piece = ids[d][s:s + n]
                    rows.append((names[d], s, n, zlib.crc32(piece.tobytes()), len(ids[d]), number, at,
                                 *([piece.astype(np.int64).tolist()] if with_ids else [])))
                    at += n
                serial += 1
            names, ids, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            who, what = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(who), 256):
                for name, got in zip(who[a:a + 256], encode([t or "" for t in what.slice(a, 256).to_pylist()], end_id)):
                    names.append(name)
                    ids.append(got)
                    held += len(got)
                    if held >= BATCH_TOKENS:
                        yield flush()
        if ids:
            yield flush()

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return inner.mapInArrow(lean(run), ddl + (", ids array<long>" if with_ids else ""))
