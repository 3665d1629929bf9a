"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A letter trigram is the product
of its letters' vectors, the first rotated twice and the second once, so that
order counts.  A text is the sum of its trigram vectors; a language prototype
is the sum of its training texts' unit vectors, less the mean of all
prototypes (what all languages share tells nothing).  A text gets the language
whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import materialize, pick, scratch, small_batches

DIMENSIONS = 1024
SEED = 20_240_601
CODES = 128
UNKNOWN = "und"
#: Labelled texts of each language that fit and limits read at most: no limit, all of them count.
FIT_ROWS = math.inf
#: Unit vectors are summed as whole multiples of this, so that sums don't depend on how rows lie in tasks.
GRAIN = 2.0**-30
#: Labels beyond this number can't be languages; the fit refuses them.
MOST_LANGUAGES = 2_000
#: The limit of the best cosine is this quantile of held-out labelled texts, times the slack; that of another language's lead is this quantile of the leads of texts in their own.
LOW, SLACK, LEAD = 0.01, 0.7, 0.1
#: Cells of a unit of cosine, in which values are counted before the one sought is looked up.
CELLS = 2_048
#: Trigram vectors that a worker keeps.
CACHE_ROWS = 32_768


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code of each code point: 0 between words, 1-26 for a-z, 27-90 for Latin letters with marks, 91-127 for the rest by hash."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + (low - 0xC0) % 64 if 0xC0 <= low < 0x250 else 91 + low % 37
    return table


@lru_cache(1)
def _alphabet(dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = np.random.default_rng(SEED).integers(0, 2, (CODES, dimensions), np.int8) * 2 - 1
    return np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters


def trigrams(text: str) -> np.ndarray:
    """Ids of the letter trigrams of a text, with one mark between and around words; empty if it has no letter."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    codes = np.concatenate(([0], codes, [0])).astype(np.int64)
    codes = codes[np.concatenate(([True], (codes[1:] > 0) | (codes[:-1] > 0)))]
    return codes[:-2] * CODES**2 + codes[1:-1] * CODES + codes[2:] if len(codes) > 2 else codes[:0]


class Bundler:
    """Sums trigram vectors; keeps a bounded number of them."""

    def __init__(self) -> None:
        self.row = np.full(CODES**3, -1, np.int32)
        self.vectors = np.zeros((CACHE_ROWS, DIMENSIONS), np.int8)
        self.known = 0

    def _rows(self, ids: np.ndarray) -> np.ndarray:
        new = ids[self.row[ids] < 0]
        if len(new):
            if self.known + len(new) > CACHE_ROWS:
                self.row[:], self.known = -1, 0
                new = ids
            first, second, third = _alphabet()
            at = np.arange(self.known, self.known + len(new))
            self.vectors[at] = first[new // CODES**2] * second[new // CODES % CODES] * third[new % CODES]
            self.row[new] = at
            self.known += len(new)
        return self.row[ids]

    def bundle(self, text: str) -> np.ndarray | None:
        ids, counts = np.unique(trigrams(text), return_counts=True)
        if not len(ids):
            return None
        out = np.zeros(DIMENSIONS, np.float32)
        for at in range(0, len(ids), CACHE_ROWS // 2):
            out += counts[at : at + CACHE_ROWS // 2].astype(np.float32) @ self.vectors[self._rows(ids[at : at + CACHE_ROWS // 2])].astype(np.float32)
        return out


_BUNDLER: list[Bundler] = []


def _bundler() -> Bundler:
    if not _BUNDLER:
        _BUNDLER.append(Bundler())
    return _BUNDLER[0]


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, mod 4; 0 without doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4, F.lit(0))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes) from all rows of ``docs`` (doc_id, text, lang) with a lang that aren't held out.

    Each task sums its own texts; what meets in the shuffle is one vector for each
    language and task, and what comes to the driver one for each language.
    Without labelled rows there is no language and every text is ``und``.
    """
    small_batches(docs.sparkSession)
    rows = pick(docs, "doc_id", "text", "lang").where((remainder() != 2) & F.col("lang").isNotNull())
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def sent(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"lang": k, "v": v.tolist()} for k, v in sums.items()], schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.int64()))]))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text and (v := _bundler().bundle(text)) is not None:
                    unit = v.astype(np.float64) / (np.linalg.norm(v.astype(np.float64)) or 1)
                    sums.setdefault(lang, np.zeros(DIMENSIONS, np.int64))
                    sums[lang] += np.rint(unit / GRAIN).astype(np.int64)
        yield sent(sums)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, v in zip(batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy().reshape(-1, DIMENSIONS), strict=True):
                sums[lang] = sums.get(lang, 0) + v
        yield sent(sums)

    kind = "lang string, v array<long>"
    found = rows.select("lang", "text").mapInArrow(bundle, kind).repartition("lang").mapInArrow(total, kind).collect()
    sums = {r["lang"]: np.array(r["v"]) * GRAIN for r in found}
    names = sorted(sums)
    units = np.array([sums[n] / (np.linalg.norm(sums[n]) or 1) for n in names]).reshape(-1, DIMENSIONS)
    if len(names) > 1:
        units = units - units.mean(axis=0)
    lengths = np.linalg.norm(units, axis=1, keepdims=True)
    return names, (units / np.where(lengths, lengths, 1)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text), from the whole text.

    score is the cosine with the prototype, 0 where that is negative.  A null
    text, or one without letters, is ``und`` with score 0.  Ties go to the
    language first in the alphabet; repeated rows give repeated results, an empty
    table an empty one.  Texts of any length are read whole; further columns of
    any name are left out.
    """
    small_batches(docs.sparkSession)
    names, prototypes = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                v = _bundler().bundle(text) if text and names else None
                if v is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = prototypes @ v / (np.linalg.norm(v) or 1)
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def _cosines(text: str | None, prototypes: np.ndarray) -> tuple[int, np.ndarray | None]:
    """Length class (the binary logarithm of the number of trigrams) and cosines; none for a text without letters."""
    ids = trigrams(text) if text else ()
    if not len(ids) or not len(prototypes):
        return int(len(ids)).bit_length(), None
    v = _bundler().bundle(text)
    return int(len(ids)).bit_length(), prototypes @ v / (np.linalg.norm(v) or 1)


CLASSES = 33


def _quantiles(rows: DataFrame, share: float) -> dict[int, float]:
    """Of all values of ``rows`` (kind, v) in a length class and its neighbours, the one at place ``int(share * n)``.

    Exact: values are counted by cell, and the distinct ones of the cell sought
    are counted once more.  The driver gets counts, not rows.
    """
    rows = rows.withColumn("cell", F.floor(F.col("v") * CELLS).cast("int"))
    counts = {(r["kind"], r["cell"]): r["count"] for r in rows.groupBy("kind", "cell").count().collect()}
    wanted = {}
    for kind in range(CLASSES):
        near = Counter()
        for (k, cell), n in counts.items():
            if abs(k - kind) <= 1:
                near[cell] += n
        place = int(share * near.total())
        for cell in sorted(near):
            if place < near[cell]:
                wanted[kind] = cell, place
                break
            place -= near[cell]
    key = lambda k, cell: k * 1_000_000 + cell
    cells = {key(k, cell) for kind, (cell, _) in wanted.items() for k in (kind - 1, kind, kind + 1)}
    values = rows.where(key(F.col("kind"), F.col("cell")).isin(*cells)).groupBy("kind", "cell", "v").count().collect() if cells else []
    out = {}
    for kind, (cell, place) in wanted.items():
        for v, n in sorted((r["v"], r["count"]) for r in values if r["cell"] == cell and abs(r["kind"] - kind) <= 1):
            if place < n:
                out[kind] = v
                break
            place -= n
    return out


def limits(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> np.ndarray:
    """Two rows, by length class: the least best cosine that a text may have, and the lead from which on another language than its own has it.

    Measured on all held-out labelled texts, which the model hasn't seen.  A class
    takes its quantiles with its neighbours (of few texts, the least value), or,
    where they have no text, from the next shorter class that has some.  Neither
    limit moves much for a hundredth of wrong labels.
    """
    names, prototypes = model
    out = np.stack((np.full(CLASSES, -np.inf), np.full(CLASSES, np.inf)))
    if not names:
        return out
    spark = docs.sparkSession
    small_batches(spark)
    rows = pick(docs, "doc_id", "text", "lang").where((remainder() == 2) & F.col("lang").isin(names))
    at = {n: i for i, n in enumerate(names)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind, c = _cosines(text, prototypes)
                if c is not None:
                    others = np.delete(c, at[lang])
                    rows.append((kind, float(c.max()), float(c[at[lang]] - (others.max() if len(others) else 0))))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int32(), pa.float64(), pa.float64()))], names=["kind", "best", "lead"])

    with scratch(spark):
        measured = materialize(rows.select("text", "lang").mapInArrow(measure, "kind int, best double, lead double"), "limits")
        least = _quantiles(measured.select("kind", F.col("best").alias("v")), LOW)
        leads = _quantiles(measured.where("lead > 0").select("kind", F.col("lead").alias("v")), LEAD)
    for kind in range(CLASSES):
        if kind in least:
            out[0, kind] = SLACK * least[kind]
        elif kind:
            out[0, kind] = out[0, kind - 1]
        if kind in leads:
            out[1, kind] = leads[kind]
        elif kind:
            out[1, kind] = out[1, kind - 1]
    return out


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text has no letters, is unlike every language, or isn't in the language that ``lang`` names.

    Like no language: its best cosine is under the limit of its length class.
    Not in its language: another one leads its cosine as clearly as nine in ten
    held-out texts of that length are led by their own; this asks for a lang that
    the model knows.  Model
    and :func:`limits` come from ``docs`` itself; without a labelled row only
    texts without letters go, and those are null, empty and symbols too.  Rows are
    judged each by its whole text: repeated ones go or stay together, and an
    empty table stays empty.  The columns stay as they are.
    """
    model = fit(docs)
    names, prototypes = model
    least = limits(docs, model)
    known = {n: i for i, n in enumerate(names)}
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def stays(text: str | None, lang: str | None) -> bool:
        kind, c = _cosines(text, prototypes)
        if c is None:
            return kind > 0
        if c.max() < least[0, kind]:
            return False
        mine = known.get(lang)
        return mine is None or c.max() - c[mine] < max(least[1, kind], 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(text_at).to_pylist(), batch.column(lang_at).to_pylist(), strict=True)
            yield batch.filter(pa.array([stays(*p) for p in pairs], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
