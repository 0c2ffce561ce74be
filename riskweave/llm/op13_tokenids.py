"""Token ids in binary files: ids ranked by frequency, in a byte-aligned variable-length code.

1. The documents are dealt to tasks by ranges of doc_id and sorted there. A task tokenises them and holds the ids of one
   file (at most ``FILE_IDS``, but for a longer document).
2. The ids of a file are counted; the rank of an id is its place by falling count, ties by id. No pass over the whole
   corpus comes first, and every file can be read alone.
3. A block of a file holds the document ids, the number of ids of each, one control byte for four ranks (two bits each: the
   bytes of the rank less one) and, apart from these, the bytes of the ranks, low byte first. Frequent ids take one byte.
4. Reading looks the control bytes up in tables of 256 rows (lengths and offsets), gathers the bytes and
   looks the ranks up in the file's list of ids.

A file is ``MAGIC``, the zlib-compressed list of ids by rank, blocks, and a block of no documents. Files are named
for the attempt of the task; the manifest (a table) lists those of tasks that succeeded, in the order of doc_id,
with the number of ids before each, so retries and lost executors leave at most unreferenced files.

Rules: a null text is empty; an empty text has the end id alone. Null doc_ids come first. Rows of equal doc_id follow the
hash of their texts; equal rows are interchangeable, and a random part of the order key lets them spread over tasks. Empty
tables give no file and no row; other columns are not read. Nothing comes to the driver but the number of files.
Memory: the ids of one file, the words remembered (bounded in bytes) and the longest text.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.bytesview import slices
from riskweave.llm.shared import lean, shared_dir, ship, stored

#: Fixed values of the file format.
MAGIC = b"RWIDS\x00\x00\x01"
_HEAD = "<IQQQ"
BLOCK_IDS, FILE_IDS = 1 << 20, 1 << 24
#: Bytes that the remembered words may take, about, and bytes of texts that are encoded together.
WORD_BYTES, TEXT_BYTES = 160 << 20, 4 << 20

#: By control byte: the lengths of its four values, where each begins, and the bytes of all.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.int64)
OFFSETS = np.concatenate([np.zeros((256, 1), np.int64), np.cumsum(LENGTHS, axis=1)[:, :3]], axis=1)
TOTALS = LENGTHS.sum(axis=1)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, value bytes) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[:len(values)] = extra
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """``n`` values of the control bytes and value bytes, by table lookup."""
    if not n:
        return np.zeros(0, dtype=np.uint32)
    totals = TOTALS[control]
    base = np.cumsum(totals) - totals
    places = (base[:, None] + OFFSETS[control]).reshape(-1)[:n]
    lengths = LENGTHS[control].reshape(-1)[:n]
    padded = np.concatenate([data, np.zeros(4, dtype=np.uint8)])
    out = padded[places].astype(np.uint32)
    for k in range(1, int(lengths.max())):
        out |= padded[places + k].astype(np.uint32) << np.uint32(8 * k)
    return out & _MASKS[lengths]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Words:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    Its pieces hold a space as their first character only, so a text may be cut before every space that no white
    space follows, and texts so cut may be joined. The different words of a batch of texts are looked up once. New words
    of Latin letters, with or without a sign at the end, are one or two pieces and go to the tokenizer's model. Other new
    ones are joined to texts of ``JOINED`` words for the tokenizer; as its tokens stand for known numbers of bytes, the
    ids of each word are found by sums. They are remembered until the words take ``WORD_BYTES``. Texts with
    several white spaces in a row, and all texts for files with other steps, go to the tokenizer whole."""

    JOINED = 512
    #: A space before white space or the end: there a text must not be cut.
    ODD = r" ([\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"

    #: Letters that have been letters in every version of Unicode, and signs that end a word.
    LATIN, SIGNS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01f5]+"), frozenset(",.;:!?)")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.letters, self.ends = _byte_letters(), {}
        made = json.loads(self.tok.to_str())
        step, added = made.get("pre_tokenizer") or {}, made.get("added_tokens") or []
        self.plain = (made.get("normalizer") is None and step.get("type") == "ByteLevel" and not step["add_prefix_space"] and step["use_regex"]
                      and not any(x["normalized"] or x["lstrip"] or x["rstrip"] or re.search(r"\s", x["content"]) for x in added))
        # a byte-level vocabulary writes each byte as one letter; added tokens are written as they are
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        widths = {i: len(t) for t, i in vocabulary.items()} | {x["id"]: len(x["content"].encode()) for x in added}
        self.width = np.zeros(max(widths, default=0) + 1, dtype=np.int64)
        self.width[list(widths)] = list(widths.values())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}         # words after a space, by what follows it: their row in the two arrays
        self.start, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.held = 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word after a space, from texts of many words."""
        out: list[np.ndarray] = []
        for a in range(0, len(words), self.JOINED):
            part = words[a:a + self.JOINED]
            got = self._whole([" " + " ".join(part)])[0]
            ends = np.cumsum(np.array([len(w.encode()) + 1 for w in part], dtype=np.int64))
            upto = (np.searchsorted(np.cumsum(self.width[got]), ends, side="left") + 1).tolist()
            out += [got[x:y] for x, y in zip([0, *upto], upto)]
        return out

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words after a space, number of ids of each)."""
        tokenize, latin, signs = self.model.tokenize, self.LATIN.fullmatch, self.SIGNS
        made: dict[str, list] = {}
        rows: list = []
        rest: list[int] = []
        for word in words:
            base = word[:-1] if word[-1:] in signs else word
            got = made.get(base)
            if got is None:
                if not latin(base):
                    rest.append(len(rows))
                    rows.append(None)
                    continue
                plain = base if base.isascii() else base.encode().decode("latin-1").translate(self.letters)
                got = made[base] = [t.id for t in tokenize("\u0120" + plain)]
            rows.append(got if base is word else [*got, *self._sign(word[-1])])
        for i, ids in zip(rest, self._joined([words[i] for i in rest])):
            rows[i] = ids
        counts = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        return np.fromiter(chain.from_iterable(rows), dtype=np.uint32, count=int(counts.sum())), counts

    def _sign(self, sign: str) -> list[int]:
        if sign not in self.ends:
            self.ends[sign] = [t.id for t in self.model.tokenize(sign)]
        return self.ends[sign]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.ODD).to_numpy(zero_copy_only=False) if self.plain else np.ones(len(texts), dtype=bool)
        out: list = [None] * len(texts)
        for i, ids in zip(np.flatnonzero(odd).tolist(), self._whole(texts.filter(pa.array(odd)).to_pylist()) if odd.any() else []):
            out[i] = ids
        if odd.all():
            return out
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = words.dictionary_encode()
        names, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        first = np.zeros(len(words), dtype=bool)
        first[offsets[:-1]] = True              # no space before the first word of a text
        used = np.zeros(len(names), dtype=bool)
        used[codes[~first]] = True
        row = self._rows(names, used)
        heads = self._whole(words.filter(pa.array(first)).to_pylist())
        count = self.count[row][codes]
        count[first] = 0
        after = np.cumsum(count)
        ids = self.pool[np.repeat(self.start[row][codes] - (after - count), count) + np.arange(after[-1])] if after[-1] else np.zeros(0, np.uint32)
        ends = np.concatenate([[0], after])[offsets]
        for k, i in enumerate(np.flatnonzero(~odd).tolist()):
            out[i] = np.concatenate([heads[k], ids[ends[k]:ends[k + 1]]])
        return out

    def _rows(self, names: list[str], used: np.ndarray) -> np.ndarray:
        """The rows of the words that are used, new ones among them encoded; 0 for others."""
        if self.held > WORD_BYTES:
            self._forget()
        row = np.array([self.known.get(w, -1) for w in names], dtype=np.int64)
        new = np.flatnonzero(used & (row < 0))
        if len(new):
            words = [names[i] for i in new.tolist()]
            ids, counts = self._new(words)
            at = len(self.count)
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(counts) - counts])
            self.count, self.pool = np.concatenate([self.count, counts]), np.concatenate([self.pool, ids])
            row[new] = np.arange(at, at + len(new))
            self.known.update(zip(words, range(at, at + len(new))))
            self.held += sum(map(len, words)) + 180 * len(words) + 4 * len(ids)
        return np.maximum(row, 0) if len(self.count) else self._none(row)

    def _none(self, row: np.ndarray) -> np.ndarray:
        self.start, self.count = np.zeros(1, np.int64), np.zeros(1, np.int64)
        return np.zeros_like(row)


_ENCODERS: dict[str, Words] = {}


def encoder(path: str) -> Words:
    """The encoder of a file, kept by the worker from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Words(path)
    return _ENCODERS[path]


def _path(tokenizer: str) -> str:
    if os.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def ranked(ids: np.ndarray) -> np.ndarray:
    """The different ids by falling count, ties by id."""
    counts = np.bincount(ids)
    seen = np.flatnonzero(counts)
    return seen[np.argsort(-counts[seen], kind="stable")].astype("<u4")


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Write the files; the manifest (path, docs, ids, before), one row per file in the order of doc_id.

    ``tokenizer`` is the name of a file of the installed ``public_tokenizers`` package or a path."""
    spark = docs.sparkSession
    ship(spark)
    folder = f"{folder or shared_dir(spark) + '/token-ids'}/{uuid.uuid4().hex}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encode = system = base = None
        end, attempt, part = np.array([end_id], dtype=np.uint32), uuid.uuid4().hex, TaskContext.get().partitionId()
        names, lengths, ids, held, done = [], [], [], 0, []

        def close() -> None:
            nonlocal names, lengths, ids, held
            raw = np.concatenate(ids)
            by_rank = ranked(raw)
            rank = np.zeros(int(by_rank.max()) + 1, dtype=np.uint32)
            rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
            listed, path = zlib.compress(by_rank.tobytes()), f"{part:08d}-{len(done):04d}-{attempt}.ids"
            ends = np.cumsum(lengths)
            with system.open_output_stream(f"{base}/{path}") as out:
                out.write(MAGIC + struct.pack("<I", len(listed)) + listed)
                a = 0
                while a < len(names):
                    start = int(ends[a]) - lengths[a]
                    b = max(a + 1, int(np.searchsorted(ends, start + BLOCK_IDS, side="right")))
                    control, data = pack(rank[raw[start:int(ends[b - 1])]])
                    out.write(struct.pack(_HEAD, b - a, int(ends[b - 1]) - start, len(control), len(data)))
                    out.write(np.packbits(np.array([x is None for x in names[a:b]], dtype=bool)).tobytes())
                    out.write(np.array([x or 0 for x in names[a:b]], dtype="<i8").tobytes())
                    out.write(np.array(lengths[a:b], dtype="<u8").tobytes())
                    out.write(control)
                    out.write(data)
                    a = b
                out.write(struct.pack(_HEAD, 0, 0, 0, 0))
            done.append((part, len(done), f"{folder}/{path}", len(names), held))
            names, lengths, ids, held = [], [], [], 0

        gc.disable()                            # many small lists live for a moment, none of them in a cycle; ``lean`` ends this
        for batch in batches:
            if encode is None:
                encode = encoder(_path(tokenizer))
                system, base = fs.FileSystem.from_uri(folder)
                system.create_dir(base, recursive=True)
            who = batch.column(0).to_pylist()
            for a, b, _, _ in slices(batch.column(1), TEXT_BYTES):
                for name, got in zip(who[a:b], encode(batch.column(1).slice(a, b - a))):
                    names.append(name)
                    lengths.append(len(got) + 1)
                    ids += (got, end)
                    held += lengths[-1]
                    if held >= FILE_IDS:
                        close()
        if names:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done]) for i in range(5)], ["part", "serial", "path", "docs", "ids"])

    keys = ("doc_id", "mark", "spread")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.rand(13).alias("spread"))
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    files = stored(dealt.mapInArrow(lean(put), "part long, serial long, path string, docs long, ids long"), "token-files")
    earlier = Window.orderBy("part", "serial").rowsBetween(Window.unboundedPreceding, -1)   # one row per file
    before = F.coalesce(F.sum("ids").over(earlier), F.lit(0)).cast("long").alias("before")
    return stored(files.select("path", "docs", "ids", before), "token-manifest")


def blocks(path: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, number of ids of each, all ids) of each block of a file, one at a time."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_stream(name) as src:
        if src.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path}: not a file of token ids")
        by_rank = np.frombuffer(zlib.decompress(src.read(struct.unpack("<I", src.read(4))[0])), dtype="<u4")
        while True:
            head = src.read(struct.calcsize(_HEAD))
            if len(head) < struct.calcsize(_HEAD):
                raise ValueError(f"{path}: cut short")
            n_docs, n_ids, n_control, n_data = struct.unpack(_HEAD, head)
            if not n_docs:
                return
            null = np.unpackbits(np.frombuffer(src.read(-(-n_docs // 8)), np.uint8), count=n_docs)
            names = np.frombuffer(src.read(8 * n_docs), dtype="<i8").tolist()
            lengths = np.frombuffer(src.read(8 * n_docs), dtype="<u8").astype(np.int64)
            control, data = np.frombuffer(src.read(n_control), np.uint8), np.frombuffer(src.read(n_data), np.uint8)
            if len(control) < n_control or len(data) < n_data or int(lengths.sum()) != n_ids:
                raise ValueError(f"{path}: damaged block")
            yield [None if x else k for x, k in zip(null, names)], lengths, by_rank[unpack(control, data, n_ids)]


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32 (and the ids), all from the files."""
    ship(manifest.sparkSession)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for docs, lengths, ids in blocks(path):
                    ends = np.cumsum(lengths)
                    raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                    marks = [zlib.crc32(raw[4 * (e - n):4 * e]) for n, e in zip(lengths.tolist(), ends.tolist())]
                    columns = [docs, start + ends - lengths, lengths, marks]
                    if with_ids:
                        columns.append([ids[e - n:e].astype(np.int64) for n, e in zip(lengths.tolist(), ends.tolist())])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
                    start += int(ends[-1])

    tasks = max(1, min(manifest.count(), 20_000))
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return manifest.select("path", "before").repartition(tasks).mapInArrow(run, ddl + (", ids array<long>" if with_ids else ""))
