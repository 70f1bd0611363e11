"""Token files and token counts against the library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

from voxelframe.llm import pieces, token_files  # noqa: E402
from voxelframe.llm.token_counts import _counter, count_tokens  # noqa: E402
from voxelframe.llm.token_files import Decoder, _encoder, encode_block, frequency_table, read_token_files, token_digest, write_token_files  # noqa: E402

from .conftest import edge_rows  # noqa: E402

ALPHABET = [*"aAbestT'’ \t\n\r \n\x1c.,;!<>|#ΣσςİéÉßñ́̈中文１２½​🙂9", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "xxxx", "aaaaaaa", "...", "the ", "\n\n", " a."]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 25))) for _ in range(n)]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_pieces_give_the_librarys_ids():
    coder, whole = _encoder("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    for t in texts(6000, 1):
        assert np.frombuffer(coder.encode(t), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_long_pieces_of_many_lines():
    coder, whole = token_files.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    words = [f"{a}{b}" for a in ("river", "stone.", "x,", "Tab\tle", "7") for b in ("", "s", "ing", "\n")]
    for t in ["\n".join(f"word{k}" for k in range(5000)), " lead " + "\n".join(words * 250) + " tail", "\n".join(["QUJD" * 19] * 5000)]:
        assert np.frombuffer(coder.encode(t), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids
    kept = coder.table.size.held[: coder.table.kept]
    assert coder.table.kept == coder.table.hash.n and 0 < kept.max() <= pieces.LONGEST


def test_counts_are_the_librarys():
    counter, whole = _counter("word_bpe_49k.json"), library("word_bpe_49k.json")
    sample = texts(6000, 2)
    assert counter.count(sample) == [len(e) for e in whole.encode_batch(sample, add_special_tokens=False)]


def test_counts_keep_no_long_pieces():
    counter = _counter("word_bpe_49k.json")
    many = ["QUJD" * 5000, "文字" * 3000 + " and so on", "x" * 129 + " " + "y" * 128]
    assert counter.count(many) == [len(library("word_bpe_49k.json").encode(t, add_special_tokens=False)) for t in many]
    assert max(map(len, counter.known)) <= 128


def test_a_small_memory_forgets_nothing_it_needs(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 0)
    monkeypatch.setattr(pieces, "WINDOW", 16)
    coder, whole = token_files.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    for t in [*texts(300, 3), "some words. and, some\nmore words; again and again"]:
        assert np.frombuffer(coder.encode(t), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(pieces.PieceEncoder, "_hashes", lambda self, raw, start, size: np.zeros(len(start), np.uint64))
    coder, whole = token_files.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    many = [*texts(200, 4), "", "alpha beta, gamma\ndelta"]
    for t, ids in zip(many, coder.encode_all(many), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64, 1000])
def test_blocks_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), 500).astype(np.uint16)
    counts = {int(k): int(c) for k, c in zip(*np.unique(np.append(ids, [0, 3]), return_counts=True))}
    freq = frequency_table(counts)
    assert freq.sum() == 1 << token_files.SCALE
    raw, decoder = encode_block(ids, freq, lanes=8, every=4), Decoder(freq)
    assert (decoder.decode(raw) == ids).all()
    for k in range(-(-n // 32)):
        assert (decoder.decode(raw, k, k + 1) == ids[32 * k : 32 * (k + 1)]).all()
    assert (decoder.decode(raw, 1) == ids[32:]).all()
    for at in (0, 4, 12, 21, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            decoder.decode(bytes(bad))
    with pytest.raises(ValueError, match="damaged"):
        decoder.decode(raw[:9])
    with pytest.raises(ValueError, match="table"):
        Decoder(frequency_table({0: 1, 1: 5})).decode(raw)


def test_one_symbol_and_rare_symbols():
    freq = frequency_table({5: 10})
    assert (Decoder(freq).decode(encode_block(np.full(100, 5), freq, 4, 8)) == 5).all()
    counts = {k: 1 for k in range(50_000)} | {7: 10**9}
    freq = frequency_table(counts)
    assert freq.sum() == 1 << token_files.SCALE and freq.min() >= 1
    assert not frequency_table({}).any()


def plain(rows):
    whole, at, out = library("byte_bpe_50k.json"), 0, []
    packed = [(doc, np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for doc, t in rows]
    for doc, ids in sorted(packed, key=lambda x: (x[0] is not None, x[0] or 0)):
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_of_documents(spark, documents, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = sorted(map(tuple, token_digest(documents.repartition(5)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == plain(rows)
    path = str(tmp_path / "set")
    write_token_files(documents.repartition(3), path)
    ids = {r["doc_id"]: r["ids"] for r in read_token_files(spark, path).collect()}
    assert all(zlib.crc32(ids[d]) == crc for d, _, _, crc in got)
    blocks = spark.read.parquet(f"{path}/blocks").orderBy("part", "block").collect()
    assert [d for b in blocks for d in b["doc_ids"]] == sorted(ids)


def test_files_at_the_edges(edge, nothing):
    got = token_digest(edge).collect()
    want = plain([r[:2] for r in edge_rows()])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(d), n, c) for d, _, n, c in want)
    spans = sorted((r["start"], r["n_tokens"]) for r in got)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert token_digest(nothing).count() == 0


def test_counts_at_the_edges(edge, nothing):
    whole = library("word_bpe_49k.json")
    want = [(str(d), len((t or "").encode()), n := len(whole.encode(t or "", add_special_tokens=False)), n > 2048) for d, t, *_ in edge_rows()]
    got = [(str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(edge).collect()]
    assert sorted(got) == sorted(want)
    assert count_tokens(nothing).count() == 0
