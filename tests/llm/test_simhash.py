"""Near duplicates against all pairs, texts at the edges."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from voxelframe.llm.components import connected_components
from voxelframe.llm import simhash
from voxelframe.llm.simhash import _forest, alike, keep_first, links, near_duplicates, position_sets, signature

from .conftest import edge_rows


def fingerprint(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, k, bits):
    fps = [fingerprint(t, k) for _, t in rows]
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for (doc, _), f in zip(rows, fps):
        if doc is not None:
            least[find(f)] = min(doc, least.get(find(f), doc))
    return sorted(((doc, f"{f:016x}", least.get(find(f))) for (doc, _), f in zip(rows, fps)), key=str)


@pytest.mark.parametrize("bits", [2, 3])
def test_documents(spark, documents, bits):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = sorted(map(tuple, near_duplicates(documents, max_bits=bits).collect()), key=str)
    assert got == brute(rows, 3, bits)


def test_edges(spark, edge, nothing):
    rows = [r[:2] for r in edge_rows()]
    got = sorted(map(tuple, near_duplicates(edge).collect()), key=str)
    assert got == brute(rows, 3, 2)
    assert near_duplicates(nothing).count() == 0 and keep_first(nothing).count() == 0
    kept = keep_first(edge, shingle=3, max_bits=2)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 not in ids and 2 not in ids and 3 not in ids and -3 in ids and ids.count(15) == 2 and ids.count(16) == 2
    with pytest.raises(ValueError, match="max_bits"):
        near_duplicates(edge, max_bits=8)


def test_long_lists_lose_no_link():
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = np.array(sorted({base ^ (rng.getrandbits(16) << 8) for _ in range(3000)}), np.uint64)
    assert len(fps) > 1024
    edges = _forest(fps, 2)
    root = {int(f): int(f) for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in edges.T.tolist():
        root[find(b)] = find(a)
    for i, a in enumerate(fps.tolist()):
        near = fps[np.bitwise_count(fps ^ np.uint64(a)) <= 2]
        assert len({find(int(f)) for f in near}) == 1


@pytest.mark.parametrize("bits", range(8))
def test_some_set_of_positions_stays_whole(bits):
    for touched in itertools.combinations(range(8), bits):
        assert any(not set(c) & set(touched) for c in position_sets(bits))


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_split_lists_lose_no_link(spark, monkeypatch, bits):
    # Prints that share most bytes, so all lists are far over the limit and are split by further positions.
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(bits)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for _ in range(600)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {r["node"] % (1 << 64): r["root"] for r in connected_components(links(spark.createDataFrame(signed, "fp long"), bits)).collect()}
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= bits:
            root[find(a)] = find(b)
    want = {}
    for f in fps:
        want.setdefault(find(f), set()).add(f)
    found = {}
    for f, r in got.items():
        found.setdefault(r, set()).add(f)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_similarity_of_many_sets_at_once():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 400)).astype(np.uint64) << np.uint64(40)) for _ in range(30)]
    for some in (sets, sets[:2]):
        want = [[len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.5 for y in some] for x in some]
        assert alike(some, some, 0.5).tolist() == want


def test_long_lists_of_copies_far_from_one_another(spark, monkeypatch):
    # Copies of one text with more and more edits: pairs of copies are seldom alike enough, and chunks hold 16 rows.
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(12)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(260))
    rows = [(k, edited(base, rng.randint(1, 9), rng)) for k in range(150)] + [(500, base)]
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {d for d in sets if find(d) == d}
    assert 10 < len(want) < 120
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in keep_first(docs, shingle=5, max_bits=0, similarity=0.8).collect()} == want


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 105), (105, 100), (101, 105), (7, 7), (200, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 105: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def edited(text, k, rng):
    w = text.split()
    for i in rng.sample(range(len(w)), k):
        w[i] = "edit" + str(rng.randrange(10**6))
    return " ".join(w)


def test_similar_texts_are_one_and_others_stay(spark):
    rng = random.Random(8)
    words = ["w" + str(k) for k in range(4000)]
    rows, near = [], set()
    for g in range(60):
        base = " ".join(rng.choice(words) for _ in range(rng.choice((60, 200, 600))))
        rows.append((100 * g, base))
        n = len(base.split())
        for j in (1, 2):
            # A changed word takes five shingles of either side: a similarity of 0.86 or more.
            rows.append((100 * g + j, edited(base, max(1, n // 70), rng)))
            near.add(100 * g + j)
        rows.append((100 * g + 50, edited(base, n // 10, rng)))  # 0.4 or less
    hub = " ".join(rng.choice(words) for _ in range(300))
    rows += [(10_000 + k, edited(hub, 3, rng)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in keep_first(docs, shingle=5, max_bits=3, similarity=0.8).collect()}
    assert kept >= {d for d, _ in rows if d < 10_000} - near
    assert len(kept & near) <= 2 and {d for d in kept if d >= 10_000} == {10_000}


def test_the_shingles_themselves_decide_close_to_the_limit(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for g in range(120):
        base = [f"g{g}w{k}" for k in range(rng.choice((300, 504, 904)))]
        n = len(base) - 4
        # A new end of k words: n - k of n + k shingles are shared.
        limit = n // 9
        k = limit + (g % 2) * 2  # 0.8 or a little more, or a little less
        other = base[: len(base) - k] + [f"g{g}new{i}" for i in range(k)]
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(other))]
        alike = len(shingles(rows[-1][1]) & shingles(rows[-2][1])) / len(shingles(rows[-1][1]) | shingles(rows[-2][1]))
        assert 0.79 < alike < 0.81 and (alike >= 0.8) == (g % 2 == 0)
        want |= {10 * g} if alike >= 0.8 else {10 * g, 10 * g + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in keep_first(docs, shingle=5, max_bits=0, similarity=0.8).collect()} == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    for n in (1, 30, 300, 5000):
        for share in (0.5, 0.8, 0.95):
            common, a, b = (rng.integers(0, 1 << 63, m, np.uint64) * np.uint64(2) for m in (max(1, int(n * share)), (n - int(n * share)) // 2, (n - int(n * share)) // 2))
            x, y = (np.frombuffer(signature(np.concatenate([common, o])), np.uint8) for o in (a, b))
            real = len(common) / (len(common) + len(a) + len(b))
            filled = np.count_nonzero(x | y)
            assert abs(np.count_nonzero((x == y) & (x != 0)) / filled - real) < 0.13
