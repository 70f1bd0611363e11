"""Cross-entropy difference of documents under a target and a background model of words and word pairs.

Both models have one vocabulary, all words of the corpus. Nothing is cut from it, and counts never leave the executors:
documents are taken in groups, the distinct words and pairs of a group are counted and dealt to shards by hash, every
shard adds up what it gets and answers each group, and a group is judged where its answers and its texts meet again.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize
from .pieces import BASE, powers

#: Weight of word pairs against single words.
TRUST = 0.5
#: Words and pairs that a shard gets, about; documents, and bytes of their texts, that make up a group.
SHARD, GROUP, GROUP_BYTES = 1 << 21, 2048, 1 << 23
#: Target ids up to this many go to every task; beyond it they are joined by a shuffle.
MOST_TARGETS = 1_000_000
#: Bytes hashed at once.
WINDOW = 1 << 22
#: Stands behind the last word of a text.
END = np.uint64(0)
TRAINS, SCORED = 1, 2
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = powers(BASE, 1), powers(pow(BASE, -1, 1 << 64), 1)


def tokens(text: str) -> list[str]:
    """Words between ASCII white space, A to Z in lower case."""
    return [w.decode() for w in text.encode().lower().split()]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in a row, never END, and the number of words of each text."""
    global _POWERS
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    space = _SPACE[raw]
    ahead = np.append(True, space)
    start, stop = np.flatnonzero(ahead[:-1] & ~space), np.flatnonzero(~ahead & np.append(space, True))
    out, done = np.zeros(len(start), np.uint64), 0
    while done < len(start):
        last = max(done + 1, int(np.searchsorted(stop, start[done] + WINDOW, "right")))
        a, b = start[done], stop[last - 1]
        if len(_POWERS[0]) < b - a:
            _POWERS = powers(BASE, b - a), powers(pow(BASE, -1, 1 << 64), b - a)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((raw[a:b].astype(np.uint64) + np.uint64(1)) * _POWERS[0][: b - a], out=total[1:])
        out[done:last] = (total[stop[done:last] - a] - total[start[done:last] - a]) * _POWERS[1][start[done:last] - a]
        done = last
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.maximum(_mixed(out), np.uint64(1)), np.diff(np.searchsorted(start, ends), prepend=0)


def _packed(docs: DataFrame) -> DataFrame:
    """(blob, bytes): ids, texts, targets and roles of a group of rows (doc_id, text, target, role), and the bytes of its texts; a null text is empty.

    Groups are cut by rows and bytes as these come, wherever the batches end.
    """
    def packed(parts: list[pa.RecordBatch], texts: list[bytes]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        ids = io.BytesIO()
        with pa.ipc.new_stream(ids, rows.select(["doc_id"]).schema) as writer:
            writer.write_table(rows.select(["doc_id"]).combine_chunks())
        target, role = (rows[c].to_numpy().astype(np.uint8) for c in ("target", "role"))
        blob = _pack(ids=np.frombuffer(ids.getvalue(), np.uint8), text=np.frombuffer(b"".join(texts), np.uint8), size=_narrow(np.array([len(t) for t in texts])), target=target, role=role)
        return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([sum(map(len, texts))], pa.int64())], ["blob", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, size = [], [], 0
        for whole in batches:
            texts, start = [t or b"" for t in whole.column(1).cast(pa.binary()).to_pylist()], 0
            for k, text in enumerate(texts, 1):
                held.append(text)
                size += len(text)
                if len(held) == GROUP or size > GROUP_BYTES:
                    parts.append(whole.slice(start, k - start).drop_columns(["text"]))
                    yield packed(parts, held)
                    parts, held, size, start = [], [], 0, k
            if start < len(texts):
                parts.append(whole.slice(start).drop_columns(["text"]))
        if held:
            yield packed(parts, held)

    return docs.mapInArrow(run, "blob binary, bytes long")


def _unpacked(blob: bytes) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """A group, and its texts."""
    about = _unpack(blob)
    raw, ends = about["text"].tobytes(), np.cumsum(about["size"].astype(np.int64)).tolist()
    return about, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def entries(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of the distinct words (even) and pairs (odd) of texts, which of them each word is and makes with its successor, and the number of words of each text."""
    h, sizes = word_hashes(texts)
    following = np.append(h[1:], END)[: len(h)]
    following[np.cumsum(sizes)[sizes > 0] - 1] = END
    pair = _mixed(h * np.uint64(BASE) + _mixed(following ^ np.uint64(0x5851F42D4C957F2D)))
    keys, at = np.unique(np.concatenate([h & ~np.uint64(1), pair | np.uint64(1)]), return_inverse=True)
    return keys, at[: len(h)], at[len(h) :], sizes


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays by name in one compressed string: the length of a JSON line of types and sizes, that line, the arrays."""
    head = json.dumps({k: [x.dtype.str, len(x)] for k, x in arrays.items()}).encode()
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(head)) + head + b"".join([x.tobytes() for x in arrays.values()]))


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + struct.unpack_from("<I", raw)[0]
    out = {}
    for k, (kind, n) in json.loads(raw[4:at]).items():
        out[k] = np.frombuffer(raw, kind, n, at)
        at += out[k].nbytes
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """In the smallest unsigned type that holds all values."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _asked(groups: DataFrame, shards: int) -> DataFrame:
    """(shard, group, t, b, blob): the keys of each group that fall to a shard, and their counts among target and background.

    Sorted keys are written as differences, six bytes each where that does, byte by byte. ``t`` and ``b`` are the
    group's words, told once.
    """
    names = ["shard", "group", "t", "b", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array([-(-(k << 64) // shards) for k in range(shards)], np.uint64)
        for group, packed in ((g, b) for batch in batches for g, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            about, texts = _unpacked(packed)
            keys, word, pair, sizes = entries(texts)
            target, role = (np.repeat(about[k].astype(np.int64), sizes) for k in ("target", "role"))
            counts = []
            for side in (target * (role & TRAINS), (1 - target) * (role & TRAINS)):
                counts.append(np.bincount(word, side, len(keys)) + np.bincount(pair, side, len(keys)))
                counts.append(int(side.sum()))
            t, n_t, b, n_b = counts
            bounds = np.append(np.searchsorted(keys, starts), len(keys))
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                part = slice(bounds[k], bounds[k + 1])
                steps = np.diff(keys[part], prepend=starts[k])
                width = 6 if int(steps.max()) < 1 << 48 else 8
                raw = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).ravel()
                blob = _pack(steps=raw, t=_narrow(t[part]), b=_narrow(b[part]))
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((k, pa.int32()), (group, pa.int64()), (n_t, pa.int64()), (n_b, pa.int64()), (blob, pa.binary()))], names)
                n_t = n_b = 0

    return groups.select("group", "blob").mapInArrow(run, "shard int, group long, t long, b long, blob binary")


def _answered(asked: DataFrame, shards: int) -> DataFrame:
    """(group, shard, v, t, b, blob): for each group the counts of its keys in the corpus. ``v``: distinct words of the shard, told once."""
    names = ["group", "shard", "v", "t", "b", "blob"]

    def answer(shard: int, rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        found, keys = [_unpack(r[3]) for r in rows], []
        for x in found:
            n = len(x["t"])
            steps = np.zeros((n, 8), np.uint8)
            steps[:, : len(x["steps"]) // n] = x["steps"].reshape(-1, n).T
            keys.append(np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(-(-(shard << 64) // shards)))
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        t, b = (np.bincount(at, np.concatenate([x[k] for x in found]), len(known)).astype(np.int64) for k in ("t", "b"))
        seen, v, done = t + b > 0, 0, 0
        v = int(np.count_nonzero(seen & (known & np.uint64(1) == 0)))
        for (group, n_t, n_b, _), mine in zip(rows, keys, strict=True):
            own = at[done : done + len(mine)]
            done += len(mine)
            blob = _pack(t=_narrow(t[own]), b=_narrow(b[own]))
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((group, pa.int64()), (shard, pa.int32()), (v, pa.int64()), (n_t, pa.int64()), (n_b, pa.int64()), (blob, pa.binary()))], names)
            v = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now and rows:
                    yield from answer(now, rows)
                    rows = []
                now = shard
                rows.append(row)
        if rows:
            yield from answer(now, rows)

    dealt = asked.repartition("shard").sortWithinPartitions("shard", "group")
    return dealt.mapInArrow(run, "group long, shard int, v long, t long, b long, blob binary")


@dataclass
class Sums:
    """Words of the target's and the background's documents, and of the vocabulary."""

    target: int
    background: int
    vocabulary: int

    def scale(self) -> float:
        """Background counts are weighed by this, so that both models have seen as many words."""
        return self.target / self.background if self.target and self.background else 1.0


def losses(word: np.ndarray, pair: np.ndarray, sizes: np.ndarray, target: np.ndarray, role: np.ndarray, counts: tuple[np.ndarray, np.ndarray], sums: Sums) -> tuple[np.ndarray, np.ndarray]:
    """Target and background losses, summed over the words of each text.

    ``word`` and ``pair``: which entry each word is, and makes with its successor; ``counts``: of the entries in the
    corpus, among target and background. What a text counts there itself is taken off before its words are judged.
    """
    doc = np.repeat(np.arange(len(sizes)), sizes)
    own = []
    for at in (word, pair):
        _, which, n = np.unique(doc * len(counts[0]) + at, return_inverse=True, return_counts=True)
        own.append(n[which])
    out = []
    for of_model, entry, all_words, weight in ((target == 1, counts[0], sums.target, 1.0), (target == 0, counts[1], sums.background, sums.scale())):
        mine = (of_model & (role == TRAINS | SCORED))[doc]
        c_word, c_pair = (weight * (entry[at] - n * mine) for at, n in zip((word, pair), own, strict=True))
        single = (c_word + 1) / (weight * (all_words - sizes[doc] * mine) + sums.vocabulary)
        double = (c_pair + 1) / (c_word + sums.vocabulary + 1)
        out.append(np.bincount(doc, -(1 - TRUST) * np.log(single) - TRUST * np.log(double), len(sizes)))
    return out[0], out[1]


def score(docs: DataFrame, targets: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss, score.

    ``targets`` has the ids (first column) of the documents that the target model is trained on; the background model is
    trained on all others, its counts weighed so that both models have seen as many words. They are trained on
    ``corpus``, by default on ``docs`` themselves; then the counts of a document, which would foretell it, are taken
    off before it is scored.

    A word's loss is the mean, weighed by ``TRUST``, of its own negative log probability and that of what follows it (a
    word, or the end of the text); both are smoothed by adding one to the count of every word of the corpus. The orders
    aren't interpolated within the logarithm, so a shard needs no counts of second words. Losses are means per word in nats, ``score`` is target_loss - background_loss: the
    lower, the more like the targets. Words are whatever stands between ASCII white space, A to Z in lower case; they
    are told apart by 64-bit hashes.

    Documents without words (null, blank) have n_tokens 0 and null losses. Null ids are background; repeated rows count
    as often as they stand there; other columns are ignored; without targets that model is even, and an empty table
    gives no rows. A very long text is a group of its own, held whole by one task. Groups are cut and stored once, and
    what is counted and what is scored are read from there, so the order of the input doesn't matter.
    """
    marked = lambda df, role: df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(role).alias("role"))
    rows = marked(docs, TRAINS | SCORED) if corpus is None else marked(docs, SCORED).union(marked(corpus, TRAINS))
    wanted = materialize(targets.select(F.col(targets.columns[0]).alias("doc_id"), F.lit(True).alias("hit")).distinct(), "targets")
    few = checked_broadcast(wanted, MOST_TARGETS)
    rows = rows.join(few, "doc_id", "left").select("doc_id", "text", F.coalesce("hit", F.lit(False)).alias("target"), "role")
    groups = materialize(_packed(rows).withColumn("group", F.monotonically_increasing_id()), "groups")
    size = groups.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, size // (3 * SHARD))  # a word and a pair for every six bytes or so
    answers = materialize(_answered(_asked(groups, shards), shards), "answers")
    sums = Sums(*(answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("t", "b", "v"))).first()))
    names = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]

    def told(counts: list[dict[str, np.ndarray]], about: dict[str, np.ndarray], texts: list[bytes]) -> pa.RecordBatch:
        keys, word, pair, n = entries(texts)
        of = tuple(np.concatenate([x[k].astype(np.int64) for x in counts]) if counts else np.zeros(0, np.int64) for k in ("t", "b"))
        if len(of[0]) != len(keys):
            raise RuntimeError("a group got answers to other keys than it asked for")
        t, b = (x / np.maximum(n, 1) for x in losses(word, pair, n, about["target"], about["role"], of, sums))
        with pa.ipc.open_stream(about["ids"].tobytes()) as reader:
            ids = reader.read_all().column(0).combine_chunks()
        none = n == 0
        cols = [ids, pa.array(n), pa.array(t, mask=none), pa.array(b, mask=none), pa.array(t - b, mask=none)]
        return pa.RecordBatch.from_arrays(cols, names).filter(pa.array(about["role"] & SCORED > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[dict[str, np.ndarray]] = []
        for batch in batches:
            for _, shard, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard is not None:
                    counts.append(_unpack(blob))
                else:
                    yield told(counts, *_unpacked(blob))
                    counts = []

    kind = rows.schema["doc_id"].dataType.simpleString()
    both = answers.select("group", "shard", "blob").union(groups.select("group", F.lit(None).cast("int"), "blob"))
    # The answers of a group in the order of their shards, then the group itself.
    back = both.repartition("group").sortWithinPartitions("group", F.col("shard").asc_nulls_last())
    return back.mapInArrow(run, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")


def score_sql(docs: str = "documents", targets: str = "SELECT doc_id FROM labels WHERE quality = 1") -> str:
    """DuckDB SQL for ``score`` of documents that train their own models, losses rounded to 6 places."""
    upper = "".join(chr(c) for c in range(65, 91))
    side = {"t": "target", "b": "NOT target"}
    per = ", ".join(f"sum(n) FILTER ({w}) AS {k}" for k, w in side.items())
    own = {k: f"CASE WHEN {w} THEN 1 ELSE 0 END" for k, w in side.items()}
    scale = {"t": "1.0", "b": "scale"}
    loss = ", ".join(
        f"""sum(-n * ({1 - TRUST} * ln(({scale[k]} * (coalesce(w{k}, 0) - mine * {own[k]}) + 1) / ({scale[k]} * (all_{k} - n_tokens * {own[k]}) + v))
                    + {TRUST} * ln(({scale[k]} * (coalesce(p{k}, 0) - n * {own[k]}) + 1) / ({scale[k]} * (coalesce(w{k}, 0) - mine * {own[k]}) + v + 1)))) / any_value(n_tokens) AS {k}"""
        for k in side
    )
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id IN ({targets}), false) AS target,
                  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {docs}),
    words AS (SELECT r, target, len(ws) AS n_tokens, unnest(ws) AS w, unnest(list_append(ws[2:], NULL)) AS u FROM docs WHERE len(ws) > 0),
    counted AS (SELECT r, target, n_tokens, w, u, count(*) AS n FROM words GROUP BY r, target, n_tokens, w, u),
    pairs AS (SELECT *, sum(n) OVER (PARTITION BY r, w) AS mine FROM counted),
    single AS (SELECT w, {per.replace(" AS ", " AS w")} FROM pairs GROUP BY w),
    twos AS (SELECT w, u, {per.replace(" AS ", " AS p")} FROM pairs GROUP BY w, u),
    sums AS (SELECT *, CASE WHEN all_t > 0 AND all_b > 0 THEN all_t::DOUBLE / all_b ELSE 1 END AS scale
             FROM (SELECT count(*) AS v, coalesce(sum(wt), 0)::DOUBLE AS all_t, coalesce(sum(wb), 0)::DOUBLE AS all_b FROM single)),
    losses AS (SELECT r, {loss} FROM pairs JOIN single ON pairs.w = single.w JOIN twos ON pairs.w = twos.w AND pairs.u IS NOT DISTINCT FROM twos.u, sums GROUP BY r)
    SELECT doc_id, len(ws)::BIGINT AS n_tokens, round(t, 6) AS target_loss, round(b, 6) AS background_loss, round(t - b, 6) AS score FROM docs LEFT JOIN losses USING (r)"""
