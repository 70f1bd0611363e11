"""Token counts by rank-synchronous merging over ragged arrays."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

#: Distinct pieces whose counts a Python worker keeps, and characters of one; longer ones are counted anew.
KEPT, LONGEST = 400_000, 128
#: Symbols merged in one go.
CHUNK = 1 << 18
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Counts what the merges of a byte-pair vocabulary leave of pre-tokens (UTF-8 bytes, last one with the word-end suffix)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.size = max(vocab.values()) + 1
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + suffix] for x in letters], np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], np.arange(len(keys))[order], made
        # Open addressing: most pairs are in no merge, and one probe tells.
        self.bits = int(len(keys) * 4).bit_length()
        self.slots = np.full(1 << self.bits, -1, np.int64)
        at, left = self._slot(self.keys), np.arange(len(keys))
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            at, left = (at[lost] + 1) & ((1 << self.bits) - 1), left[lost]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.size + right
        out = np.full(len(want), NONE)
        at, todo = self._slot(want), np.arange(len(want))
        while len(todo):
            k = self.slots[at]
            hit = (k >= 0) & (self.keys[k] == want[todo])
            out[todo[hit]] = self.rank[k[hit]]
            on = (k >= 0) & ~hit
            at, todo = (at[on] + 1) & ((1 << self.bits) - 1), todo[on]
        return out

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that each pre-token ends with; an empty one has none."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out, a = np.zeros(len(words), np.int64), 0
        ends = np.cumsum(sizes)
        while a < len(words):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
            out[a:b] = self._merge(words[a:b], sizes[a:b])
            a = b
        return out

    def _merge(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(b"".join(words), np.uint8)
        if not len(raw):
            return sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        last = np.append(owner[1:] != owner[:-1], True)
        symbol = np.where(last, self.final[raw], self.inner[raw])
        left = sizes.copy()
        rank = np.append(np.where(last[:-1], NONE, self._ranks(symbol[:-1], symbol[1:])), NONE)
        while len(symbol):
            # Each sequence's lowest rank; sequences without any are done and leave the arrays.
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            span = np.diff(np.append(first, len(owner)))
            live = np.repeat(lowest != NONE, span)
            symbol, owner, rank, lowest = symbol[live], owner[live], rank[live], np.repeat(lowest, span)[live]
            if not len(symbol):
                break
            hit = rank == lowest
            # Of overlapping hits (x x x under the pair x x) the odd ones from the left merge.
            where = np.flatnonzero(hit)
            run = np.append(True, np.diff(where) > 1)
            hit[where] = (np.arange(len(where)) - np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))) % 2 == 0
            where = np.flatnonzero(hit)
            symbol[where] = self.made[rank[where]]
            np.subtract.at(left, owner[where], 1)
            keep = np.ones(len(symbol), bool)
            keep[where + 1] = False
            # Ranks change only beside what was merged.
            touched = np.zeros(len(symbol), bool)
            touched[where] = True
            before = where - 1
            before = before[before >= 0]
            touched[before] = True
            gone = before[~keep[before]]
            touched[gone - 1] = True
            symbol, owner, rank, touched = symbol[keep], owner[keep], rank[keep], np.flatnonzero(touched[keep])
            after = np.minimum(touched + 1, len(symbol) - 1)
            same = (owner[touched] == owner[after]) & (after > touched)
            rank[touched] = NONE
            rank[touched[same]] = self._ranks(symbol[touched[same]], symbol[after[same]])
        return left


class PieceCounter:
    """Token counts of texts for a vocabulary file with word ends, remembering the counts of pieces between white space.

    White space is dropped by the pre-tokenizer and no rule of the normalizer (NFC, white space, lower case) reaches
    across it, so pieces between ASCII white space count independently.
    """

    def __init__(self, path: str) -> None:
        with open(path) as file:
            told = json.load(file)
        model = told["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = MergeCounter(model["vocab"], merges, model["end_of_word_suffix"] or "")
        steps = told["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        special = [regex.escape(t["content"]) for t in told["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.marks = {t["content"][:2] for t in told["added_tokens"]}
        self.known: dict[str, int] = {}

    def _pretokens(self, piece: str) -> list[str]:
        text = piece if piece.isascii() else unicodedata.normalize("NFC", piece)
        # The library lower-cases letter by letter: no final form of sigma.
        return self.pattern.findall(text.replace("Σ", "σ").lower())

    def _learn(self, pieces: list[str]) -> None:
        new, words, owners, fixed = [p for p in dict.fromkeys(pieces) if p not in self.known], [], [], []
        for k, piece in enumerate(new):
            parts, n = [piece], 0
            if self.special and any(m in piece for m in self.marks):
                parts = self.special.split(piece)
                n = len(parts) - 1
            fixed.append(n)
            for part in parts:
                found = self._pretokens(part)
                words += found
                owners += [k] * len(found)
        counts = self.merges.count([w.encode() for w in words])
        total = np.array(fixed, np.int64) + np.bincount(np.array(owners, np.int64), counts, len(new)).astype(np.int64) if new else []
        self.known.update(zip(new, (int(n) for n in total), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > KEPT:
            self.known.clear()
        out: list[int] = []
        pieces = [_pieces(t) for t in texts]
        fresh = {p for ps in pieces for p in ps if p not in self.known}
        if fresh:
            self._learn(list(fresh))
        for ps in pieces:
            out.append(sum(map(self.known.__getitem__, ps)))
        for p in fresh:
            if len(p) > LONGEST:
                del self.known[p]
        return out


def _pieces(text: str) -> list[str]:
    # str.split() also cuts at other white space, which the pre-tokenizer drops likewise, and at U+001C to U+001F, which
    # it keeps: those texts are cut at blanks alone.
    return text.split() if not _KEPT_CONTROLS.search(text) else text.split(" ")


_KEPT_CONTROLS = regex.compile("[\x1c-\x1f]")


@lru_cache(2)
def _counter(name: str) -> PieceCounter:
    import public_tokenizers

    return PieceCounter(name if "/" in name else public_tokenizers.path(name))


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Counts are those of the tokenizers library without begin and end tokens; special strings inside a text count as one
    token each, as there. A null text counts as empty: no bytes, no tokens. Ids may be null or repeated, rows stay as
    many as they are, other columns are ignored. Texts are handled whole, a few hundred at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                size = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(counter.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    source = batched(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
