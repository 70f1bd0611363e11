"""Benchmark decontamination: pigeonhole pieces find candidates, Myers' bit-parallel distance decides."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import batched, released

#: Characters of test items that one pass over the documents looks for; more items take more passes.
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    """Lower case, white space run together."""
    return " ".join(text.lower().split())


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their offsets: ``budget`` edits leave one of them untouched."""
    n = budget + 1
    cuts = [len(text) * k // n for k in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """A string to be found within ``budget`` edits, by Myers' algorithm with one long integer for the whole string."""

    def __init__(self, text: str, offset: int = 0, budget: int = 0) -> None:
        self.text, self.offset, self.budget = text, offset, budget
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        """Least edit distance to any stretch of ``text``."""
        if self.text in text:
            return 0
        m, masks = len(self.text), self.masks
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score, best = full, 0, m, m
        for c in text:
            eq = masks.get(c, 0)
            across = (((eq & up) + up) ^ up) | eq | down
            plus, minus = down | (full & ~(across | up)), up & across
            if minus & top:
                score -= 1
                if score < best:
                    best = score
            elif plus & top:
                score += 1
            plus, minus = (plus << 1) & full, (minus << 1) & full
            level = eq | down
            up, down = minus | (full & ~(level | plus)), plus & level
        return best


def ladders(text: str, budget: int) -> list[tuple[str, int, list[Pattern]]]:
    """(piece, offset, the patterns to verify in turn) for each piece; the last pattern is the whole text.

    Runs of ``n`` pieces are halved down to single pieces. If a run is within ``n - 1`` edits of a stretch, then one of
    its halves is within its own number of pieces less one; so some piece of an item within budget is hit exactly and
    verifies on every rung, while chance hits fail on the short first ones.
    """
    parts = pieces(text, budget)
    out: list[tuple[str, int, list[Pattern]]] = []

    def climb(first: int, last: int, above: list[Pattern]) -> None:
        if last - first == 1:
            out.append((parts[first][1], parts[first][0], above))
            return
        run = Pattern("".join(p for _, p in parts[first:last]), parts[first][0], last - first - 1)
        middle = (first + last) // 2
        climb(first, middle, [run, *above])
        climb(middle, last, [run, *above])

    climb(0, len(parts), [])
    return out


class LeakFinder:
    """Looks for a block of test items in texts."""

    def __init__(self, items: tuple[tuple[object, str], ...], rate: float) -> None:
        self.ids = [k for k, _ in items]
        uses: dict[str, list[tuple[int, int, list[Pattern]]]] = defaultdict(list)
        for n, (_, text) in enumerate(items):
            for piece, at, rungs in ladders(text, int(len(text) * rate)):
                uses[piece].append((n, at, rungs))
        self.automaton = ahocorasick.Automaton()
        for piece, found in uses.items():
            self.automaton.add_word(piece, (len(piece), found))
        if uses:
            self.automaton.make_automaton()

    def find(self, text: str, first: bool = False) -> list[tuple[object, int]]:
        """(item id, distance) of every item within its budget somewhere in the text; with ``first``, one of them at most."""
        if not self.ids:
            return []
        text = normal(text)
        best: dict[int, int] = {}
        seen: set[tuple[int, int]] = set()
        for end, (size, uses) in self.automaton.iter(text):
            for n, at, rungs in uses:
                start = end + 1 - size - at
                if best.get(n) == 0 or (n, start) in seen:
                    continue
                distance = 0
                for rung in rungs:
                    a = start + rung.offset
                    distance = rung.distance(text[max(0, a - rung.budget) : a + len(rung.text) + rung.budget])
                    if distance > rung.budget:
                        break
                else:
                    seen.add((n, start))
                    best[n] = min(distance, best.get(n, distance))
                    if first:
                        return [(self.ids[n], distance)]
        return [(self.ids[n], d) for n, d in best.items()]


@lru_cache(4)
def _finder(items: tuple[tuple[object, str], ...], rate: float) -> LeakFinder:
    return LeakFinder(items, rate)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[tuple[object, str], ...]]:
    """The stated query set, brought to the driver block by block; items without a character are left out."""
    block, size = [], 0
    for k, text in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        if text := normal(text):
            if block and size + len(text) > BLOCK_CHARS:
                yield tuple(block)
                block, size = [], 0
            block.append((k, text))
            size += len(text)
    if block:
        yield tuple(block)


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance): every test item found within ``rate`` edits a character in a whole document.

    Case and white space are levelled on both sides first. An item of ``m`` characters has a budget of
    ``int(m * rate)`` insertions, deletions and replacements; every match within the budget is found. Documents and
    items that are null or blank match nothing; repeated rows, on either side, give repeated hits; ids may be null;
    other columns are ignored; without items or documents the result is empty. A very long text is searched whole, in
    time that grows with its length, by one task.
    """
    source = batched(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    kinds = source.schema["doc_id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int"
    item_type = to_arrow_type(items.schema[item_col].dataType)
    found = None
    for block in _blocks(items, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            finder = _finder(block, rate)
            for batch in batches:
                rows = [(k, *hit) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in finder.find(t)]
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                types = batch.schema.field(0).type, item_type, pa.int32()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "distance"])

        hits = source.mapInArrow(released(run), schema)
        found = hits if found is None else found.union(hits)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def drop_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.1, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text ``find_leaks`` finds no item, with all their columns; no shuffle."""
    at = batched(docs).columns.index(text_col)
    for block in _blocks(items, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            finder = _finder(block, rate)
            for batch in batches:
                yield batch.filter(pa.array([not (t and finder.find(t, first=True)) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(released(run), docs.schema)
    return docs
