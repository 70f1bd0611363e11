"""Token ids of documents, written as range asymmetric numeral system (rANS) blocks and read back.

A file set is two tables in one folder. ``model`` holds the shared frequency table. ``blocks`` holds one row per block:
``part`` (range of document ids), ``block`` (number within the part), ``before`` (ids of the part ahead of the block),
``doc_ids`` and ``lengths`` of its documents, and ``payload``. Parts, blocks and documents ascend by document id. A
payload is, little-endian:

    magic "VXA1", u32 lanes, u32 symbols, u32 steps between checkpoints, u32 checkpoints, u32 CRC-32 of the frequency
    table, u32 CRC-32 of the payload without this field, then for each checkpoint u32 first word and u64 state of each lane, then u32 words.

Symbol ``i`` belongs to lane ``i % lanes`` at step ``i // lanes``; checkpoint ``c`` stands at step ``c * steps``, so
blocks, and the stretches between checkpoints within a block, decode independently of one another.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batched, materialize, released, scratch_dir
from .pieces import PieceEncoder

MAGIC = b"VXA1"
SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 2048
#: Symbols of a block; a longer document makes a longer block of its own.
BLOCK = 1 << 20
#: Steps between checkpoints.
EVERY = 256
HEAD = np.dtype([("magic", "S4"), ("lanes", "<u4"), ("symbols", "<u4"), ("every", "<u4"), ("points", "<u4"), ("model", "<u4"), ("crc", "<u4")])


@functools.lru_cache(2)
def _encoder(name: str) -> PieceEncoder:
    import public_tokenizers

    return PieceEncoder(name if "/" in name else public_tokenizers.path(name))


def token_ids(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int | None) -> DataFrame:
    """(doc_id, ids): ids are zstd-compressed little-endian numbers of the width of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = _encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        end = b"" if end_id is None else np.array([end_id], coder.kind).tobytes()
        for batch in batches:
            ids = []
            for at in range(0, batch.num_rows, 512):
                texts = [t or "" for t in batch.column(1).slice(at, 512).to_pylist()]
                ids += [packer.compress(x + end) for x in coder.encode_all(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    source = batched(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(released(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary")


def _unpack(packed: list[bytes], kind: np.dtype) -> list[np.ndarray]:
    reader = zstandard.ZstdDecompressor()
    return [np.frombuffer(reader.decompress(p), kind) for p in packed]


def id_counts(ids: DataFrame, kind: np.dtype) -> DataFrame:
    """(id, n) over all documents, summed in each task before the shuffle; as many rows as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = _unpack(batch.column(0).slice(at, 256).to_pylist(), kind)
                n = np.bincount(np.concatenate(part)) if part else total[:0]
                total, n = (total, n) if len(total) >= len(n) else (n.astype(np.int64), total)
                total[: len(n)] += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    return ids.select("ids").mapInArrow(released(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def frequency_table(counts: dict[int, int]) -> np.ndarray:
    """Frequencies that sum to ``2 ** SCALE``, at least 1 for every id that occurs."""
    size = max(counts, default=0) + 1
    n = np.zeros(size)
    n[list(counts)] = list(counts.values())
    if not n.any():
        return n.astype(np.uint64)
    freq = np.where(n > 0, np.maximum(1, np.floor(n * (1 << SCALE) / n.sum())), 0).astype(np.int64)
    over = int(freq.sum()) - (1 << SCALE)
    for k in np.argsort(-freq, kind="stable"):
        change = min(over, int(freq[k]) // 2) if over > 0 else over
        freq[k] -= change
        over -= change
        if not over:
            return freq.astype(np.uint64)
    raise ValueError(f"more than {1 << SCALE >> 1} different ids")


def _model_crc(freq: np.ndarray) -> int:
    return zlib.crc32(freq.astype("<u4").tobytes())


def encode_block(ids: np.ndarray, freq: np.ndarray, lanes: int = LANES, every: int = EVERY) -> bytes:
    """One payload. All lanes take a step together; words follow in the order in which a decoder reads them."""
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    steps = -(-len(ids) // lanes)
    state, words, points, sizes = np.full(lanes, LOW), [], [], []
    for t in range(steps - 1, -1, -1):
        row = ids[t * lanes : (t + 1) * lanes]
        f, x = freq[row], state[: len(row)]
        full = x >= f << np.uint64(63 - SCALE)
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(row)] = (q << np.uint64(SCALE)) + (x - q * f) + start[row]
        sizes.append(len(words[-1]))
        if t % every == 0:
            points.append(state.copy())
    ahead = np.concatenate([[0], np.cumsum(sizes[::-1])]).astype("<u4")
    body = b"".join(ahead[c * every].tobytes() + s.astype("<u8").tobytes() for c, s in enumerate(reversed(points)))
    body += b"".join(w.astype("<u4").tobytes() for w in reversed(words))
    head = np.array([(MAGIC, lanes, len(ids), every, len(points), _model_crc(freq), 0)], HEAD).tobytes()[:-4]
    return head + struct.pack("<I", zlib.crc32(body, zlib.crc32(head))) + body


class Decoder:
    """Decodes payloads of one frequency table."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq, self.crc = freq.astype(np.uint64), _model_crc(freq)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def decode(self, payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of checkpoints ``first`` to ``last`` (exclusive; all by default); raises ValueError on damage."""
        if len(payload) < HEAD.itemsize:
            raise ValueError("damaged block")
        head = np.frombuffer(payload, HEAD, 1)[0]
        body = memoryview(payload)[HEAD.itemsize :]
        if head["magic"] != MAGIC or head["crc"] != zlib.crc32(body, zlib.crc32(payload[: HEAD.itemsize - 4])) or head["model"] != self.crc:
            raise ValueError("damaged block, or a block of another frequency table")
        lanes, n, every, points = (int(head[k]) for k in ("lanes", "symbols", "every", "points"))
        marks = np.frombuffer(body, np.dtype([("word", "<u4"), ("state", "<u8", (lanes,))]), points)
        words = np.frombuffer(body, "<u4", offset=marks.nbytes).astype(np.uint64)
        last = points if last is None else min(last, points)
        if first >= last:
            return np.empty(0, np.uint32)
        state, at = marks["state"][first].astype(np.uint64), int(marks["word"][first])
        stop = min(n, last * every * lanes)
        out = np.empty(stop - first * every * lanes, np.uint32)
        low = np.uint64((1 << SCALE) - 1)
        for i in range(0, len(out), lanes):
            x = state[: len(out) - i]
            slot = x & low
            s = self.symbol[slot]
            out[i : i + len(x)] = s
            x = self.freq[s] * (x >> np.uint64(SCALE)) + slot - self.start[s]
            short = np.flatnonzero(x < LOW)
            x[short] = x[short] << np.uint64(32) | words[at : at + len(short)]
            at += len(short)
            state[: len(x)] = x
        return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> None:
    """Encode every whole text, append ``end_id``, and write the file set to ``path`` in ascending order of document id.

    Null texts count as empty. Rows with a null id come first; rows that share an id stand side by side, ordered by
    their ids' bytes. Other columns are ignored, and an empty table gives a file set without blocks.
    """
    spark = docs.sparkSession
    kind = _encoder(tokenizer).kind
    ids = materialize(token_ids(docs, tokenizer, id_col, text_col, end_id), "ids")
    freq = frequency_table({r["id"]: r["n"] for r in id_counts(ids, kind).collect()})  # bounded by the vocabulary
    spark.createDataFrame([(SCALE, freq.astype("<u4").tobytes())], "scale int, freq binary").coalesce(1).write.parquet(f"{path}/model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[object, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, before, held
            symbols = np.concatenate([x for _, x in held])
            row = {"part": part, "block": block, "before": before, "doc_ids": [k for k, _ in held], "lengths": [len(x) for _, x in held], "payload": encode_block(symbols, freq)}
            block, before, held = block + 1, before + len(symbols), []
            return pa.RecordBatch.from_pylist([row], schema)

        size = 0
        for batch in batches:
            schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(batch.column(0).type)), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = _unpack([packed.as_py()], kind)[0]
                if held and size + len(x) > BLOCK:
                    yield flush()
                    size = 0
                held.append((k, x))
                size += len(x)
        if held:
            yield flush()

    name = ids.schema["doc_id"].dataType.simpleString()
    # Many rows of one id are dealt out by the beginnings of their ids, which the order within an id goes by.
    ordered = ids.withColumn("head", F.expr("substring(ids, 1, 24)")).repartitionByRange("doc_id", "head").sortWithinPartitions("doc_id", "ids").drop("head")
    ordered.mapInArrow(released(run), f"part int, block int, before long, doc_ids array<{name}>, lengths array<long>, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a file set, ids as little-endian unsigned 32-bit numbers."""
    return _read(spark, path, True)


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    blocks = spark.read.parquet(f"{path}/blocks")
    freq = np.frombuffer(spark.read.parquet(f"{path}/model").first()["freq"], "<u4").astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(freq)
        for batch in batches:
            for part, before, doc_ids, lengths, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, sizes = decoder.decode(payload).astype("<u4").tobytes(), np.array(lengths, np.int64)
                ends = np.cumsum(sizes)
                cut = [raw[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                last = pa.array(cut, pa.binary()) if with_ids else pa.array([zlib.crc32(c) for c in cut], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(cut), pa.int32()), pa.array(doc_ids, batch.column(2).type.value_type), pa.array(before + ends - sizes), pa.array(sizes), last], names)

    names = ["part", "doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"]
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    rows = blocks.select("part", "before", "doc_ids", "lengths", "payload").mapInArrow(released(run), f"part int, doc_id {id_type}, start long, n_tokens long, {names[-1]} {'binary' if with_ids else 'long'}")
    # One row per part, and there are as many parts as tasks wrote: small enough for one window and a broadcast.
    parts = blocks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    offsets = parts.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    joined = rows.join(F.broadcast(offsets), rows.part == offsets.of)
    return joined.select("doc_id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", names[-1])


def token_digest(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the file set (to the shared scratch folder unless ``path`` names one), read it back and digest each document."""
    import uuid

    path = path or f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end_id=end_id)
    return _read(docs.sparkSession, path, False)
