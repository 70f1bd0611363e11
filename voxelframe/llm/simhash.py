"""SimHash near duplicates through a byte-position inverted index with count filtering.

Fingerprints within a few bits only reach nearly identical texts. Where a similarity of shingle sets is asked for as
well, texts also get a signature of 256 byte positions, whose shared bytes are counted in the same way. Lists of least
hashes and signatures propose pairs; whether they are linked is decided by the shingle sets themselves.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, checked_broadcast, materialize, released, text_key
from .components import connected_components

BYTES = 8
#: Rows of a posting list compared at once. Longer lists are split: by further byte positions, or into chunks of so many.
BLOCK = 1024
#: Byte positions of a signature, and its lists: keys of each, least hashes that make up a key.
POSITIONS, LISTS, LEAST = 256, 16, 3
#: A pair is a candidate at this much below the wanted similarity, nearly five standard errors of a signature.
MARGIN = 0.12
#: Keys up to this many go to every task; beyond it they are joined by a shuffle.
MOST_KEYS = 500_000
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, (2, LISTS * LEAST), np.uint64) | np.array([[1], [0]], np.uint64)


def shingle_hashes(texts: list[bytes | None], shingle: int, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """XXH64 of the shingles of each text with a word, and the number of shingles of every text."""
    digest = functools.partial(xxhash.xxh64_intdigest, seed=seed)
    hashes, sizes = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.lower().split() if text else []
        if not words:
            continue
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        sizes[k] = max(1, len(words) - shingle + 1)
        hashes.append(np.fromiter(map(digest, grams), np.uint64, sizes[k]))
    return hashes, sizes


def fingerprints_of(hashes: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """64-bit SimHash of every text: a bit is set if over half of the shingles' XXH64 have it."""
    out = np.zeros(len(sizes), np.uint64)
    for h, k in zip(hashes, np.flatnonzero(sizes), strict=True):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 15):
            ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > sizes[k], bitorder="little").view("<u8")[0]
    return out


def signature(h: np.ndarray) -> bytes:
    """256 byte positions: a hash's first byte is its position, the least hash of a position gives its byte, 0 means none.

    Of the positions that either of two texts fills, the share of equal bytes estimates the similarity (Jaccard) of
    their shingle sets, to about 0.025 for long texts and closer for short ones.
    """
    h = np.sort(h)
    place = (h >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    out = np.zeros(POSITIONS, np.uint8)
    out[place[first]] = (h[first] & np.uint64(0xFFFFFF)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def list_keys(h: np.ndarray) -> np.ndarray:
    """Keys of the lists that a text is in; texts of similarity s share one with probability 1 - (1 - s ** 3) ** 16."""
    factor, shift = _FACTORS[:, :, None]
    least = np.full(LISTS * LEAST, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1 << 12):
        least = np.minimum(least, (h[None, at : at + (1 << 12)] * factor + shift).min(axis=1))
    key = np.arange(1, LISTS + 1, dtype=np.uint64)
    for part in least.reshape(LISTS, LEAST).T:
        key = (key ^ part ^ (part >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, signed: bool = False) -> DataFrame:
    """(doc_id, text_key, fp): fp is the fingerprint as a signed long; null and wordless texts get 0.

    With ``signed`` also of (a hash of the shingle set), sig and keys (see ``signature`` and ``list_keys``), null for
    null and wordless texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                hashes, sizes = shingle_hashes(batch.column(1).cast(pa.binary()).to_pylist(), shingle, seed)
                cols = [batch.column(0), batch.column(2), pa.array(fingerprints_of(hashes, sizes).view(np.int64))]
                if signed:
                    rows = iter(hashes)
                    each = [np.unique(next(rows)) if n else None for n in sizes]
                    cols.append(pa.array([None if h is None else xxhash.xxh64_intdigest(h.tobytes()) >> 1 for h in each], pa.int64()))
                    cols.append(pa.array([None if h is None else signature(h) for h in each], pa.binary()))
                    cols.append(pa.array([None if h is None else list_keys(h) for h in each], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "text_key", "fp", *(("of", "sig", "keys") if signed else ())]
    source = batched(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(F.col(text_col)).alias("text_key"))
    more = ", of long, sig binary, keys array<long>" if signed else ""
    return source.mapInArrow(released(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_key long, fp long{more}")


def position_sets(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions; fingerprints within ``max_bits`` bits share all bytes of one of them at least.

    That many bits touch as many bytes at most, so ``same = 8 - max_bits`` positions stay whole. Up to two bits, the
    positions are taken in four pairs, of which ``4 - max_bits`` stay whole. Beyond, the positions are dealt to so many
    parts that with fewer than ``size`` whole positions in each there would be fewer than ``same``.
    """
    same = BYTES - max_bits
    if max_bits <= 2:
        return [sum(c, ()) for c in itertools.combinations([(0, 1), (2, 3), (4, 5), (6, 7)], 4 - max_bits)]
    size = 3 if max_bits == 3 else 2 if max_bits <= 5 else 1
    if size == 1:
        return [(p,) for p in range(BYTES - same + 1)]
    parts = (same - 1) // (size - 1)
    return [c for k in range(parts) for c in itertools.combinations(range(BYTES * k // parts, BYTES * (k + 1) // parts), size)]


def _mask(places: tuple[int, ...]) -> int:
    mask = sum(0xFF << 8 * p for p in places)
    return mask - (1 << 64) if mask >> 63 else mask


def postings(fps: DataFrame, max_bits: int) -> DataFrame:
    """The inverted index: (places, bytes, fp), a row for every fingerprint and set of byte positions."""
    keys = [F.struct(F.lit(n).cast("byte").alias("places"), F.col("fp").bitwiseAND(F.lit(_mask(c)).cast("long")).alias("bytes")) for n, c in enumerate(position_sets(max_bits))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.places", "k.bytes", "fp")


def _split(lists: DataFrame, max_bits: int) -> DataFrame:
    """(places, more, bytes, fp): lists split by further positions, as many as make up the guaranteed matches.

    Linked members share all of these, so no link is lost, and a part holds ``256 ** max_bits`` members at most.
    """
    sets = position_sets(max_bits)
    further = [[_mask((*c, *d)) for d in itertools.combinations([p for p in range(BYTES) if p not in c], BYTES - max_bits - len(c))] for c in sets]
    masks = F.element_at(F.array(*(F.array(*(F.lit(m).cast("long") for m in row)) for row in further)), F.col("places").cast("int") + 1)
    each = lists.select("places", "fp", F.posexplode(masks).alias("more", "mask"))
    return each.select("places", (F.col("more") + 1).cast("byte").alias("more"), F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"), "fp")


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Make ``label`` (the smallest member known to be joined to each) agree with links between ``i`` and ``j``."""
    while True:
        a, b = label[i], label[j]
        off = a != b
        if not off.any():
            return
        i, j, a, b = i[off], j[off], a[off], b[off]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (deeper := label[label])[0] != label[0] or (deeper != label).any():
            label[:] = deeper


def _linked_pairs(fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members of one list that link, block by block: shared positional bytes are tallied for each pair, pairs with the guaranteed number of matches are kept, and their bits decide."""
    raw = fps.view(np.uint8).reshape(-1, BYTES)
    for a in range(0, len(fps), BLOCK):
        for b in range(a, len(fps), BLOCK):
            one, other = raw[a : a + BLOCK], raw[b : b + BLOCK]
            tally = np.zeros((len(one), len(other)), np.uint8)
            for p in range(BYTES):
                tally += one[:, p, None] == other[None, :, p]
            i, j = np.nonzero(tally >= BYTES - max_bits)
            i, j = i + a, j + b
            good = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= max_bits)
            yield i[good], j[good]


def _forest(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Spanning edges (to the smallest member) of one list's distinct fingerprints that link at ``max_bits`` or fewer bits."""
    label = np.arange(len(fps))
    if max_bits == 2 and len(fps) > BLOCK:
        # Two values are within two bits exactly if some value is within one bit of both.
        free = int(np.bitwise_or.reduce(fps ^ fps[0]))
        near = np.concatenate([fps] + [fps ^ np.uint64(1 << b) for b in range(64) if free >> b & 1])
        who = np.tile(np.arange(len(fps)), len(near) // len(fps))
        order = np.lexsort((who, near))
        near, who = near[order], who[order]
        same = np.flatnonzero(near[1:] == near[:-1])
        _hook(label, who[same], who[same + 1])
    else:
        for i, j in _linked_pairs(fps, max_bits):
            _hook(label, i, j)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return np.stack([fps[label[moved]], fps[moved]])


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Spanning edges (a, b) of the graph that links distinct fingerprints at ``max_bits`` or fewer bits.

    Fingerprints meet in the lists of the index (see ``postings``); in each list shared positional bytes are tallied.
    Two fingerprints of one list are joined by a chain of edges if a chain of links within that list joins them, so no
    link is lost for connectivity and no list emits more edges than members. Lists of more than ``BLOCK`` members are
    counted beforehand and split by further positions, so they are dealt to many tasks.
    """

    def edges(places: np.ndarray, more: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((places[1:] != places[:-1]) | (more[1:] != more[:-1]) | (key[1:] != key[:-1])) + 1
        start, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
        two = start[stop - start == 2]
        x, y = np.sort(np.stack([fp[two], fp[two + 1]]).view(np.uint64), axis=0)
        tally = (x.view(np.uint8).reshape(-1, BYTES) == y.view(np.uint8).reshape(-1, BYTES)).sum(axis=1)
        good = (tally >= BYTES - max_bits) & (np.bitwise_count(x ^ y) <= max_bits)
        found = [np.stack([x[good], y[good]])] + [_forest(np.sort(fp[a:b].view(np.uint64)), max_bits) for a, b in zip(start.tolist(), stop.tolist(), strict=True) if b - a > 2]
        a, b = np.concatenate(found, axis=1).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # what has come of the list that isn't over yet
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            while len(cols[0]):
                last = held[-1] if held else cols
                other = np.flatnonzero(functools.reduce(np.logical_or, (c != x[-1] for c, x in zip(cols[:3], last[:3], strict=True))))
                cut = 0 if not len(other) else int(other[-1]) + 1
                if not cut or not held and cut == len(cols[0]):
                    held.append(cols)
                    break
                if held:
                    # The list goes on up to the first row of another.
                    held.append([c[: other[0]] for c in cols])
                    yield edges(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held, cols = [], [c[other[0] :] for c in cols]
                else:
                    yield edges(*(c[:cut] for c in cols))
                    cols = [c[cut:] for c in cols]
        if held:
            yield edges(*(np.concatenate(c) for c in zip(*held, strict=True)))

    lists = postings(fps, max_bits)
    hot = materialize(lists.groupBy("places", "bytes").count().where(F.col("count") > BLOCK).select("places", "bytes"), "hot")
    whole = lists.select("places", F.lit(0).cast("byte").alias("more"), "bytes", "fp")
    if not hot.isEmpty():
        key = checked_broadcast(hot, MOST_KEYS)
        whole = whole.join(key, ["places", "bytes"], "left_anti").select("places", "more", "bytes", "fp").union(_split(lists.join(key, ["places", "bytes"], "left_semi"), max_bits))
    dealt = whole.repartition("places", "more", "bytes").sortWithinPartitions("places", "more", "bytes")
    return dealt.mapInArrow(released(run), "a long, b long").distinct()


def count_shared(one: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For signatures broadcast against one another: equal bytes, and positions that either fills."""
    shared = np.count_nonzero((one == others) & (others != 0), axis=-1)
    return shared, np.count_nonzero((one | others) != 0, axis=-1)


def alike(ones: list[np.ndarray], others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether each set of ``ones`` has this Jaccard similarity with each of ``others``; sets are sorted arrays."""
    sizes, more = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ones, others))
    if len(ones) * len(others) <= 4:
        common = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in others] for x in ones], np.float64)
    else:
        # Each hash is a column. One that a single set of a side has adds 1 wherever the other side has it; only those
        # that several sets of both sides have need the product of the incidence matrices.
        _, column = np.unique(np.concatenate([*ones, *others]), return_inverse=True)
        row, size = np.concatenate([np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(more)), more)]), int(sizes.sum())
        sides = [(column[:size], row[:size]), (column[size:], row[size:])]
        n_columns = int(column.max()) + 1
        counts = [np.bincount(c, minlength=n_columns) for c, _ in sides]
        common = np.zeros((len(ones), len(others)))
        for k, other in ((0, counts[1] > 0), (1, counts[0] > 1)):
            alone = (counts[k] == 1) & other
            (c, r), (c2, r2) = sides[k], sides[1 - k]
            owner = np.zeros(n_columns, np.int64)
            owner[c[alone[c]]] = r[alone[c]]
            met = alone[c2]
            at = (owner[c2[met]], r2[met]) if k == 0 else (r2[met], owner[c2[met]])
            np.add.at(common, at, 1.0)
        several = np.flatnonzero((counts[0] > 1) & (counts[1] > 1))
        place = np.full(n_columns, -1)
        place[several] = np.arange(len(several))
        for at in range(0, len(several), 4096):
            width, parts = min(4096, len(several) - at), []
            for n, (c, r) in zip((len(ones), len(others)), sides, strict=True):
                here = place[c] - at
                inside = (here >= 0) & (here < width) & (place[c] >= 0)
                matrix = np.zeros((n, width), np.float32)
                matrix[r[inside], here[inside]] = 1
                parts.append(matrix)
            common += parts[0] @ parts[1].T
    return common / (sizes[:, None] + more[None, :] - common) >= similarity


@dataclass
class Chunk:
    """The rows of one chunk of a list that are compared with others: numbers, and what they carry."""

    numbers: list[np.ndarray] = field(default_factory=list)  # fp, of, root
    carried: list[bytes] = field(default_factory=list)
    told: np.ndarray | None = None

    def add(self, numbers: list[np.ndarray], carried: list[bytes]) -> None:
        self.numbers = [np.concatenate(x) for x in zip(self.numbers, numbers, strict=True)] if self.numbers else numbers
        self.carried = self.carried + carried


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Chunk, Chunk]]:
    """Rows (key, chunk, probe, fp, of, root, carried), sorted by the first three: every chunk with one stretch of its probes after another."""
    now, chunk = None, Chunk()
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            key, part, probe, *numbers = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1])
            carried = batch.column(batch.num_columns - 1).to_pylist()
            cut = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (probe[1:] != probe[:-1])) + 1
            for a, b in itertools.pairwise([0, *cut.tolist(), len(key)]):
                if (here := (int(key[a]), int(part[a]))) != now:
                    now, chunk = here, Chunk()
                if probe[a]:
                    yield here, chunk, Chunk([x[a:b] for x in numbers], carried[a:b])
                else:
                    chunk.add([x[a:b] for x in numbers], carried[a:b])


def shingle_sets(docs: DataFrame, wanted: DataFrame, text_col: str, shingle: int, seed: int) -> DataFrame:
    """(fp, of, hashes): the sorted shingle hashes of the texts that ``wanted`` (fp, of, text_key) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                hashes, _ = shingle_hashes(batch.column(2).cast(pa.binary()).to_pylist(), shingle, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.unique(h).tobytes() for h in hashes], pa.binary())], ["fp", "of", "hashes"])

    texts = docs.select(text_key(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text")).join(wanted, "text_key")
    return texts.groupBy("fp", "of").agg(F.first("text").alias("text")).mapInArrow(released(run), "fp long, of long, hashes binary")


def _pairs_by_lists(lists: DataFrame) -> DataFrame:
    """(fp, of, h_fp, h_of): every text beside the head of each of its lists, once.

    The head of a list is its member with the longest lists altogether: of copies of one text it is the one with the
    fewest edits, which most of them are close to.
    """
    weight = lists.groupBy("fp", "of").agg(F.sum("n").alias("weight"))
    heads = lists.join(weight, ["fp", "of"]).groupBy("key").agg(F.max(F.struct("weight", "of", "fp")).alias("head"))
    met = lists.join(heads, "key").select("fp", "of", F.col("head.fp").alias("h_fp"), F.col("head.of").alias("h_of"))
    return met.where("fp <> h_fp").distinct()


def similar_classes(docs: DataFrame, marks: DataFrame, bits: DataFrame, similarity: float, text_col: str, shingle: int, seed: int) -> DataFrame:
    """(node, root) of fingerprints joined by links by bits, or by all pairs of texts with ``similarity`` of their shingle sets.

    ``marks`` is what ``fingerprints`` gives for ``docs`` with ``signed``, ``bits`` the links by bits. Texts of one
    shingle set are one row. Lists of least hashes bring texts together. First every text is held against the head of
    each of its lists: shared bytes of the signatures are counted, and pairs that pass are verified by the shingle
    sets. Then, in lists whose members aren't all joined by that, the members outside the list's largest class are held
    against all others, chunk by chunk, in the same two steps. Long lists are dealt to as many tasks as they have
    chunks, no list emits more edges than members, and what is never compared is joined already.
    """
    texts = materialize(marks.where("sig IS NOT NULL").groupBy("fp", "of").agg(F.min("text_key").alias("text_key"), F.first("sig").alias("sig"), F.first("keys").alias("keys")), "signatures")
    posts = texts.select("fp", "of", F.explode("keys").alias("key"))
    sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = materialize(posts.join(sizes, "key").select("key", "n", "fp", "of"), "lists")
    sets = materialize(shingle_sets(docs, texts.select("fp", "of", "text_key").join(lists.select("fp", "of").distinct(), ["fp", "of"]), text_col, shingle, seed), "sets")
    least = similarity - MARGIN
    sig = texts.select("fp", "of", "sig")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, POSITIONS) for k in (4, 5))
                shared, filled = count_shared(one, other)
                yield batch.select(["fp", "of", "h_fp", "h_of"]).filter(pa.array(shared >= least * filled))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            good = [bool(alike([np.frombuffer(x, np.uint64)], [np.frombuffer(y, np.uint64)], similarity)[0, 0]) for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def unjoined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, part), chunk, probes in _meetings(batches):
            sigs, own = (np.frombuffer(b"".join(c.carried), np.uint8).reshape(-1, POSITIONS) for c in (chunk, probes))
            chunk.told = np.zeros(len(sigs), bool) if chunk.told is None else chunk.told
            near = np.zeros((len(own), len(sigs)), bool)
            for at in range(0, len(own), 64):
                shared, filled = count_shared(own[at : at + 64, None], sigs[None])
                near[at : at + 64] = shared >= least * filled
            near &= probes.numbers[2][:, None] != chunk.numbers[2][None]
            some = near.any(axis=0) & ~chunk.told
            chunk.told |= some
            for probe, c, which in ((False, chunk, some), (True, probes, near.any(axis=1))):
                if which.any():
                    fp, of, root = (x[which] for x in c.numbers)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(fp), pa.int64()), pa.array([part] * len(fp), pa.int32()), pa.array([probe] * len(fp)), pa.array(fp), pa.array(of), pa.array(root)], names)

    def joined_now(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, probes in _meetings(batches):
            ones, others = ([np.frombuffer(x, np.uint64) for x in c.carried] for c in (probes, chunk))
            roots, at = np.unique(np.concatenate([probes.numbers[2], chunk.numbers[2]]), return_inverse=True)
            label, mine, theirs = np.arange(len(roots)), at[: len(ones)], at[len(ones) :]
            for k in range(0, len(ones), 256):
                i, j = np.nonzero((mine[k : k + 256, None] != theirs[None]) & alike(ones[k : k + 256], others, similarity))
                _hook(label, mine[k + i], theirs[j])
            moved = np.flatnonzero(label != np.arange(len(roots)))
            yield pa.RecordBatch.from_arrays([pa.array(roots[label[moved]]), pa.array(roots[moved])], ["a", "b"])

    names = ["key", "part", "probe", "fp", "of", "root"]
    of_head = lambda df, c: df.select(F.col("fp").alias("h_fp"), F.col("of").alias("h_of"), F.col(c).alias(f"h_{c}"))
    met = _pairs_by_lists(lists).join(sig, ["fp", "of"]).join(of_head(sig, "sig"), ["h_fp", "h_of"]).select("fp", "of", "h_fp", "h_of", "sig", "h_sig")
    pairs = met.mapInArrow(released(close), "fp long, of long, h_fp long, h_of long")
    both = pairs.join(sets, ["fp", "of"]).join(of_head(sets, "hashes"), ["h_fp", "h_of"]).select(F.col("fp").alias("a"), F.col("h_fp").alias("b"), "hashes", "h_hashes")
    first = connected_components(bits.union(both.mapInArrow(released(verified), "a long, b long")))

    rooted = lists.join(first.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("largest"), F.count(F.lit(1)).alias("several"))
    rows = rooted.join(classes.where("several > 1"), "key").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.select("key", "parts", (F.col("root") != F.col("largest.root")).alias("outside"), "fp", "of", "root")
    rows = materialize(rows.join(sig, ["fp", "of"]), "open")
    chunks = rows.select("key", F.pmod(F.xxhash64("of", "fp"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("probe"), "fp", "of", "root", "sig")
    probes = rows.where("outside").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("probe"), "fp", "of", "root", "sig")
    dealt = lambda df: df.repartition("key", "part").sortWithinPartitions("key", "part", "probe")
    near = materialize(dealt(chunks.union(probes)).mapInArrow(released(unjoined), "key long, part int, probe boolean, fp long, of long, root long"), "unjoined")
    more = connected_components(dealt(near.join(sets, ["fp", "of"]).select(*names, "hashes")).mapInArrow(released(joined_now), "a long, b long"))
    moved = more.select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = first.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    # Fingerprints that only the second step joined.
    return old.union(more.join(first, "node", "left_anti"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Fingerprints link at ``max_bits`` (0 to 7) or fewer differing bits. Copies share a fingerprint and are one node of
    the graph. Null, empty and wordless texts all have the fingerprint zero, which links like any other; a text of
    fewer words than a shingle is one shingle. Rows with a null doc_id are returned with the component of their
    fingerprint, whose smallest id is taken over the ids that aren't null. Repeated rows stay repeated, other columns
    are ignored, an empty table gives an empty result. A very long text is fingerprinted whole by one task.
    """
    classes = _classes(docs, id_col, text_col, shingle, max_bits, seed)
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_bits: int = 3, seed: int = 42, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs``, with all columns, whose id is the smallest of their component (see ``near_duplicates``).

    With ``similarity``, texts whose shingle sets are that similar are linked too, however many bits their fingerprints
    differ in (see ``similar_classes``).
    Rows equal in id and text stay or go together; rows without an id stay only where nothing in reach has one. Texts
    without words are copies of one another; an empty table gives no rows, columns of any names are kept.
    """
    classes = _classes(docs, id_col, text_col, shingle, max_bits, seed, similarity)
    gone = materialize(classes.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__vf_id"), F.col("text_key").alias("__vf_key")), "gone")
    gone = checked_broadcast(gone, MOST_KEYS)
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("__vf_id")) & (text_key(docs[text_col]) == F.col("__vf_key")), "left_anti")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, seed: int, similarity: float | None = None) -> DataFrame:
    """(doc_id, text_key, fp, component_id), a row for each of ``docs``."""
    if not 0 <= max_bits < BYTES:
        raise ValueError("max_bits must be 0 to 7: at least one byte position must be bound to match")
    marks = materialize(fingerprints(docs, id_col, text_col, shingle, seed, similarity is not None), "fingerprints")
    distinct = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    edges = links(distinct.select("fp"), max_bits)
    found = connected_components(edges) if similarity is None else similar_classes(docs, marks, edges, similarity, text_col, shingle, seed)
    linked = found.join(distinct, found.node == distinct.fp).select("fp", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    moved = materialize(linked.join(least, "root").select("fp", "least"), "moved")
    classes = distinct.join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return marks.join(classes, "fp").select("doc_id", "text_key", "fp", "component_id")
