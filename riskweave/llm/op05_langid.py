"""Language identification, word first with back-off to character n-grams.

Fitting counts the words of labelled documents per language in Spark (``fit``). A word that is known to
the model scores its log frequency in every language, mixed with ``SHARED`` parts of its frequency over all languages,
so that neither a small nor a large language is favoured. A word that is not known falls back to its
character 5-grams, those unknown to 4-grams, and so on down to single letters; a piece that is unknown at
every length scores the same in all languages. The score of a text is the sum over its words.

The model is bounded: about ``per_lang`` labelled documents of each language are counted (chosen by the
hash of the id, so every run picks the same), and the ``max_words`` and ``max_grams`` most frequent
entries of each language are kept, fewer where all languages together would pass ``MAX_ENTRIES``. Every language
with a labelled text is one of the model, however rare; the model grows with the entries, not with entries times languages.
Prediction covers every document and its whole text, in time linear in its length.

Rules: null text, or a text without a letter, is ``und`` with score 0; with no labelled text at all
everything is ``und``; equal scores go to the smaller language name; null ids and repeated rows are
ordinary rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.shared import lean, ship

UNKNOWN = "und"
LONGEST = 5
PER_LANG = 3000
MAX_WORDS = 20000
MAX_GRAMS = 8000
MAX_ENTRIES = 3_000_000
SHARED = 0.02
#: Bytes of a worker for the scores of words met so far, and for the model as a full matrix.
SCORE_BYTES, MATRIX_BYTES = 40 << 20, 32 << 20
#: Longer words are scored anew each time and not kept.
LONG = 64
#: A run of letters; the same class in Java (fitting) and in Python (prediction).
_WORD = re.compile(r"[^\W\d_]+")


def _grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)] if len(padded) > n else [padded]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words and n-grams; flushed when words get many, summed up by Spark."""
    held: Counter = Counter()
    letters = 0         # of long words

    def flush() -> pa.RecordBatch:
        rows = []
        for lang in {k[0] for k in held}:
            own = {w: n for (x, w), n in held.items() if x == lang}
            rows += [(lang, 0, w, n) for w, n in own.items()]
            for size in range(1, LONGEST + 1):
                counts: Counter = Counter(chain.from_iterable(_grams(w, size) for w in own))
                for word, n in own.items():
                    if n > 1:
                        for gram in _grams(word, size):
                            counts[gram] += n - 1
                rows += [(lang, size, gram, n) for gram, n in counts.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in
                                           enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))],
                                          ["lang", "size", "piece", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            for word, n in Counter(_WORD.findall((text.as_py() or "").lower())).items():
                held[lang, word] += n
                if len(word) > LONG:
                    letters += len(word)
            if len(held) > 50_000 or letters > 1_000_000:
                yield flush()
                letters = 0
    if held:
        yield flush()


class Model:
    """Log frequencies per language of words (size 0) and n-grams. A piece has a score of its own for the languages that
    hold it, and one score for all others; small, sent with the task."""

    def __init__(self, langs: list[str], rows: list[tuple[str, int, str, int]]):
        self.langs = langs
        at = {x: i for i, x in enumerate(langs)}
        totals = np.zeros((LONGEST + 1, max(1, len(langs))))
        #: ``tables[size]`` has the row of each piece.
        self.tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        place, owner, count, sizes = [], [], [], []
        for lang, size, piece, n in rows:
            table = self.tables[size]
            row = table.get(piece)
            if row is None:
                row = table[piece] = len(sizes)
                sizes.append(size)
            place.append(row)
            owner.append(at[lang])
            count.append(n)
            totals[size, at[lang]] += n
        order = np.argsort(np.array(place, dtype=np.int64), kind="stable")
        row, self.owner, held = (np.array(x, dtype=np.int64)[order] for x in (place, owner, count))
        size = np.array(sizes, dtype=np.int64)
        self.first = np.searchsorted(row, np.arange(len(sizes) + 1))
        whole = np.bincount(row, weights=held, minlength=len(sizes)) / np.maximum(totals.sum(axis=1), 1)[size]
        self.rest = np.log(SHARED * whole)
        self.own = np.log((1 - SHARED) * held / totals[size[row], self.owner] + SHARED * whole[row])
        self.matrix: np.ndarray | None = None

    def ready(self) -> Model:
        """In a worker: all rows as one matrix, if that stays small."""
        if self.matrix is None and 8 * len(self.rest) * len(self.langs) <= MATRIX_BYTES:
            self.matrix = np.repeat(self.rest[:, None], len(self.langs), axis=1)
            self.matrix[np.repeat(np.arange(len(self.rest)), np.diff(self.first)), self.owner] = self.own
        return self

    def mixed(self, rows: list[int], shares: np.ndarray) -> np.ndarray:
        """The scores of rows, summed with weights."""
        if self.matrix is not None:
            return shares @ self.matrix[rows]
        out = np.full(len(self.langs), shares @ self.rest[rows])
        for row, share in zip(rows, shares):
            a, b = self.first[row], self.first[row + 1]
            out[self.owner[a:b]] += share * (self.own[a:b] - self.rest[row])
        return out

    def of_word(self, word: str) -> np.ndarray:
        known = self.tables[0].get(word)
        return self.mixed([known], np.ones(1)) if known is not None else self._back_off(word)

    def _back_off(self, word: str) -> np.ndarray:
        """The mean over the pieces of each length, longest first; pieces of a length that are not known are
        cut into pieces of the next. Every place of the word counts, so the work is linear in its length."""
        rows, shares, padded = [], [], f" {word} "
        at = list(range(max(1, len(padded) - LONGEST + 1)))
        for size in range(LONGEST, 0, -1):
            table, unknown = self.tables[size], []
            for i in at:
                known = table.get(padded[i:i + size])
                if known is None:
                    unknown.append(i)
                else:
                    rows.append(known)
            shares += [1.0 / len(at)] * (len(at) - len(unknown))
            if not unknown:
                break
            last = max(0, len(padded) - size + 1)
            at = list(dict.fromkeys(i for x in unknown for i in (x, x + 1) if i <= last))
        return self.mixed(rows, np.array(shares)) if rows else np.zeros(len(self.langs))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order_by: Column | None = None,
        per_lang: int = PER_LANG, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Model of the labelled rows (non-null ``lang``, non-null ``text``)."""
    ship(docs.sparkSession)
    point = F.pmod(order_by if order_by is not None else F.xxhash64(F.col(text)), F.lit(1_000_000))
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), point.alias("point"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = sorted(r["lang"] for r in sizes.select("lang").collect())      # the classes of the model
    if not langs:
        return Model([], [])
    share = sizes.select(F.col("lang").alias("of"), F.ceil(F.lit(1e6 * per_lang) / F.col("n")).alias("share"))
    # one row for each class of the model, which goes to every task itself
    sample = rows.join(F.broadcast(share), F.col("lang") == F.col("of")).where("point < share").select("lang", "text")
    counts = (sample.mapInArrow(lean(_count_batches), "lang string, size int, piece string, n long")
              .groupBy("lang", "size", "piece").agg(F.sum("n").alias("n")))
    most = [max(1, min(m, MAX_ENTRIES * m // (len(langs) * (max_words + LONGEST * max_grams)))) for m in (max_words, max_grams)]
    rank = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "piece"))
    top = counts.withColumn("r", rank).where(F.col("r") <= F.when(F.col("size") == 0, F.lit(most[0])).otherwise(F.lit(most[1])))
    got = [(r["lang"], r["size"], r["piece"], r["n"]) for r in top.select("lang", "size", "piece", "n").collect()]
    return Model(langs, sorted(got))


class Scorer:
    """Scores texts; keeps the scores of the words met so far as rows of one matrix, up to a bound in bytes."""

    def __init__(self, model: Model, most: int | None = None):
        self.model, self.most = model.ready(), most or SCORE_BYTES // (8 * max(1, len(model.langs)) + 160)
        self.place: dict[str, int] = {}     # words of up to LONG letters
        self.rows = np.zeros((1024, max(1, len(model.langs))))

    def _learn(self, new: set[str]) -> None:
        if len(self.place) + len(new) > self.most:
            self.place.clear()
        need = len(self.place) + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need, len(self.rows)), self.rows.shape[1]))])
        for word in new:
            self.rows[len(self.place)] = self.model.of_word(word)
            self.place[word] = len(self.place)

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, score); the score is the posterior at an evidence of at most 20 words, so it says
        how clear the case is and does not saturate with length."""
        found, langs = _WORD.findall((text or "").lower()), self.model.langs
        if not langs or not any(c.isalpha() for w in found for c in w):     # _WORD also takes signs like ½
            return UNKNOWN, 0.0
        try:
            at = [self.place[w] for w in found]
            total = 0.0
        except KeyError:
            kept = [w for w in found if len(w) <= LONG]
            different = set(kept)
            new = {w for w in different if w not in self.place}
            self._learn(different if len(self.place) + len(new) > self.most else new)
            at = [self.place[w] for w in kept]
            total = sum(self.model.of_word(w) for w in found if len(w) > LONG)
        total = total + self.rows[np.array(at, dtype=np.int64)].sum(axis=0)
        scaled = (total - total.max()) * (min(len(found), 20) / len(found))
        return langs[int(np.argmax(total))], float(1.0 / np.exp(scaled).sum())


def tag(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` of every row with ``lang_pred`` and ``score``."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_lid_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])
    schema = f"{schema + ', ' if schema else ''}lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(sent.value)
        for batch in batches:
            out = [score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score"])

    return inner.mapInArrow(lean(run), schema)
