"""Language identification by error-correcting output codes over n-grams of bytes.

Every language gets a codeword. For each bit of it a binary classifier tells the languages with a 1 from those with a
0: a linear one, whose weight for an n-gram is the difference of the logarithms of its smoothed frequencies in both. The
frequencies come from all learning documents, counted on the executors. A text is given the codeword that loses least
against its classifiers' margins, and is flagged where the next one is close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of n-grams, and bits of their hashes.
ORDERS, BITS = (2, 3, 4), 15
#: N-grams that a byte is part of; sums of weights are divided by it, as each byte is judged so often.
SHARE = sum(ORDERS)
#: Added to every count.
SMOOTH = 0.5
#: Entries of the counts that are added up as one row.
SLICE = 1 << 13
#: Bytes of text whose n-grams are held at once.
WINDOW = 1 << 18
#: More languages than these are refused, which bounds the model: counts of 0.8 MB a language, a codeword's bits of 0.4 MB each.
MOST_LANGUAGES = 256
#: A text whose best language gets less than this is ambiguous.
SURE = 0.9
UNKNOWN = "und"
#: ASCII letters in lower case, every other ASCII character a blank; bytes of other characters stay.
LETTERS = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normal(text: bytes) -> bytes:
    """Words in lower case (A to Z) with one blank before, between and behind them; nothing if the text has no letter."""
    words = text.translate(LETTERS).split()
    out = b" " + b" ".join(words) + b" "
    ascii_letter = any(97 <= w[0] <= 122 or 97 <= w[-1] <= 122 for w in words)
    if ascii_letter or any(c.isalpha() for c in out.decode("utf-8", "replace")):
        return out
    return b""


def ngrams(raw: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the n-grams of one order, numbered within the table of all orders."""
    n = len(raw) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    packed = np.zeros(n, np.uint32)
    for k in range(order):
        packed = packed << np.uint32(8) | raw[k : k + n]
    return (packed * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int64) + (ORDERS.index(order) << BITS)


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of stretches of texts, and which text each byte is of; a text beyond the window comes in several stretches that overlap."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts):
        if size + len(text) > WINDOW and held:
            yield np.frombuffer(b"".join(held), np.uint8), np.repeat(np.arange(first, k), [len(x) for x in held])
            held, size, first = [], 0, k
        if len(text) > WINDOW:
            raw = np.frombuffer(text, np.uint8)
            # Each stretch takes the n-grams that begin in it, so all orders overlap by what the longest one needs.
            for at in range(0, len(raw), WINDOW):
                yield raw[at : at + WINDOW + max(ORDERS) - 1], np.full(min(WINDOW, len(raw) - at), k)
            first = k + 1
        else:
            held.append(text)
            size += len(text)
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.repeat(np.arange(first, len(texts)), [len(x) for x in held])


def found(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """N-grams of texts, and which text each is of; none reaches from one text into the next."""
    for raw, owner in _pieces(texts):
        for order in ORDERS:
            grams = ngrams(raw, order)[: len(owner)]
            of = owner[: len(grams)]
            if len(raw) > len(owner):
                yield grams, of
            else:
                inside = of == owner[order - 1 :][: len(grams)]
                yield grams[inside], of[inside]


def codewords(n: int) -> np.ndarray:
    """-1 or 1 for each of ``n`` languages and each bit.

    Up to five languages get all ways to part them in two. More get columns drawn from a fixed seed, of which those are
    taken that set the closest two codewords furthest apart; no two columns are the same or opposite.
    """
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 5:
        cols = [[1] + [1 if mask >> k & 1 else -1 for k in range(n - 1)] for mask in range((1 << n - 1) - 1)]
        return np.array(cols, np.int8).T
    rng, bits = np.random.default_rng(7), max(15, int(np.ceil(10 * np.log2(n))))
    best, apart = None, -1
    for _ in range(32):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        constant = np.abs(code.sum(axis=0)) == n
        code[:, constant] = np.where(np.arange(n) % 2, -1, 1)[:, None]
        signs = np.unique(code * code[:1], axis=1).shape[1]
        near = min(int((code[a] != code[b]).sum()) for a, b in combinations(range(min(n, 64)), 2))
        if signs == bits and near > apart:
            best, apart = code, near
    return best if best is not None else code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The place of the best language of each text, and the share of all exp(-loss) that it has.

        A codeword loses log(1 + exp(-bit * margin)), summed over its bits.
        """
        sums = np.zeros((len(texts), self.weights.shape[1]))
        for grams, of in found(texts):
            if len(of):
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                sums[of[starts]] += np.add.reduceat(self.weights[grams], starts, axis=0, dtype=np.float64)
        margins = sums / SHARE
        losses = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(axis=2)
        best = losses.argmin(axis=1)
        return best, 1 / np.exp(losses.min(axis=1, keepdims=True) - losses).sum(axis=1)


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, part, counts): n-grams of all texts of each language, a slice of the table a row."""
    entries = len(ORDERS) << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                langs, texts = part.column(0).to_pylist(), [normal(t) for t in part.column(1).to_pylist()]
                for lang in set(langs):
                    own = sums.setdefault(lang, np.zeros(entries, np.int64))
                    for grams, _ in found([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                        own += np.bincount(grams, minlength=entries)
        for lang, own in sums.items():
            for k in range(0, entries, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([k // SLICE], pa.int32()), pa.array([own[k : k + SLICE].tobytes()], pa.binary())], ["lang", "part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, np.zeros(SLICE, np.int64)
        for batch in batches:
            for lang, part, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (lang, part):
                    if key is not None:
                        yield row(key, own)
                    key, own = (lang, part), np.zeros(SLICE, np.int64)
                own += np.frombuffer(counts, np.int64)
        if key is not None:
            yield row(key, own)

    def row(key: tuple[str, int], own: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["lang", "part", "counts"])

    schema = "lang string, part int, counts binary"
    return docs.mapInArrow(run, schema).repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(add, schema)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all documents with a language; equal priors, so frequent languages aren't favoured."""
    taught = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), _bytes(text_col).alias("text"))
    languages = sorted(r[0] for r in taught.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((len(languages), len(ORDERS) << BITS))
    if len(languages) > 1:
        for r in _counts(taught).toLocalIterator():
            counts[languages.index(r["lang"]), r["part"] * SLICE : (r["part"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    by_order = counts.reshape(len(languages), len(ORDERS), 1 << BITS) + SMOOTH
    share = (by_order / by_order.sum(axis=2, keepdims=True)).reshape(counts.shape)
    code = codewords(len(languages))
    weights = np.empty((counts.shape[1], code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        weights[:, bit] = np.log(share[code[:, bit] > 0].mean(axis=0)) - np.log(share[code[:, bit] < 0].mean(axis=0))
    return Model(languages, code, weights)


def _bytes(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, the columns ``extra``, lang_pred, score, ambiguous.

    ``score`` is the best language's share of exp(-loss); ``ambiguous`` tells a share below ``SURE``. A text that is null
    or has no letter, and every text where nothing was learned, is ``und`` with score 0 and ambiguous. One language
    alone takes all other texts with score 1. Null and repeated ids are passed through; other columns are ignored; an
    empty table gives no rows. A very long text is judged in stretches.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(n) for n, c in (extra or {}).items()), _bytes(text_col).alias("text"))
    kept = source.columns[:-1]
    names = [*kept, "lang_pred", "score", "ambiguous"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [normal(t) for t in batch.column(len(kept)).to_pylist()]
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                lettered = np.array([bool(t) and bool(model.languages) for t in texts], bool)
                if lettered.any():
                    best[lettered], score[lettered] = model.judge([t for t, x in zip(texts, lettered, strict=True) if x])
                said = pa.array([model.languages[k] if x else UNKNOWN for k, x in zip(best.tolist(), lettered.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], said, pa.array(score), pa.array(score < SURE)], names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]]
    return source.mapInArrow(run, ", ".join([*kinds, "lang_pred string, score double, ambiguous boolean"]))


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def cross_checked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``identify`` of all documents by a model of those that aren't held out, with the column held_out. Documents without a language teach nothing."""
    out = held_out(F.col(id_col))
    return identify(docs, fit(docs.where(~out), text_col, lang_col), id_col, text_col, {"held_out": out})
