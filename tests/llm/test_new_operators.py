"""Source divergence, hard negatives and language identification: plain versions, edges, held-out accuracy."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.llm import hard_negatives, queries, source_audit
from voxelframe.llm.hard_negatives import Tops, mine, scores
from voxelframe.llm.language_id import codewords, cross_checked, fit, found, identify, normal
from voxelframe.llm.source_audit import audit

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_source_divergence_audit", "op12_slotted_hard_negatives"])
def test_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(want)
    assert sorted(got) == cols and len(got) == len(want) > 0
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert (got.to_numpy() == want.to_numpy()).all()


# -- source divergence


def plain_audit(rows, least_docs, top):
    """(lang, source, part, item, value, rank) by the rules, from (text, lang, source)."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        count[lang, source].update(words)
        count[lang, None].update(words)
        docs[lang].update(set(words))
    kept = {lang: [w for w, n in c.items() if n >= least_docs] for lang, c in docs.items()}

    def p(lang, source):
        c, ws = count[lang, source], kept[lang]
        n = sum(c[w] for w in ws)
        return {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * len(ws)) for w in ws}

    far = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for lang, source in groups:
        own = p(lang, source)
        pairs = [(sum(far(own[w], q[w]) for w in own), other) for other in {s for x, s in groups if x == lang} - {source} for q in [p(lang, other)]]
        whole = p(lang, None)
        terms = [(far(own[w], whole[w]), w) for w in own if count[lang, source][w] and own[w] > whole[w]]
        for part, found_, most in (("pair", pairs, None), ("term", terms, top)):
            ordered = sorted(found_, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, v, k) for k, (v, item) in enumerate(ordered, 1)]
    return sorted(out)


def test_audit_candidates(monkeypatch):
    """A task keeps the first ranks of each source and all ties of the last, however its cells come."""
    monkeypatch.setattr(source_audit, "CANDIDATES", 20)
    rng = np.random.default_rng(5)
    at, value, word = rng.integers(0, 4, 3000), rng.integers(0, 200, 3000), np.arange(3000)
    at[:2] = 4
    best = source_audit._Best(6, 3)
    for start in range(0, 3000, 70):
        best.add(at[start : start + 70], value[start : start + 70], word[start : start + 70])
    want = [k for s in range(5) for k in np.flatnonzero(at == s) if value[k] >= (sorted(value[at == s])[-3] if (at == s).sum() >= 3 else 0)]
    assert sorted(best.cells()[2].tolist()) == sorted(want)
    assert best.held < 200


@pytest.mark.parametrize("bits", [64, 4])
def test_audit_edges(edge, bits):
    rows = [(r["text"], r["lang"], r["source"]) for r in edge.collect()]
    got = sorted(tuple(r) for r in audit(edge, least_docs=2, top=3, bits=bits).collect())
    assert got == plain_audit(rows, 2, 3)
    assert any(r[0] == "" for r in got)


def test_audit_nothing(nothing):
    assert audit(nothing).count() == 0


def test_audit_small_tables(edge, monkeypatch):
    """Many buckets and a dense table of a few cells give the same."""
    monkeypatch.setattr("voxelframe.llm.source_audit.CELLS", 16)
    rows = [(r["text"], r["lang"], r["source"]) for r in edge.collect()]
    assert sorted(tuple(r) for r in audit(edge, least_docs=1, top=2).collect()) == plain_audit(rows, 1, 2)


# -- hard negatives


def plain_mine(rows, anchor, positives=5, negatives=5, low=80, high=100):
    part = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, lab, v in part:
        if not anchor(a):
            continue
        met = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in part if len(w) == len(v)]
        own = sorted((s, i) for s, i, other in met if other == lab and i != a)[:positives]
        for s, p in own:
            hit = sorted((n, i) for n, i, other in met if other != lab and low * -s <= 100 * -n <= high * -s)[:negatives]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(hit, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "odd", 1) for r in rows], "vec_id long, label int, embedding array<float>, slot string, score int").repartition(3)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("wave", [1 << 24, 64])
def test_mine_random(spark, monkeypatch, wave):
    monkeypatch.setattr(hard_negatives, "WAVE_BYTES", wave)
    rng = np.random.default_rng(3)
    # Few directions, so scores tie; a third of the rows are one vector.
    rows = [(k, int(rng.integers(3)), [float(x) / 8 for x in (rng.integers(-2, 6, 4) if k % 3 else [1, 2, 3, 4])]) for k in range(120)]
    rows += [(200, 1, [0.5, float("nan"), 0.0, 0.0]), (201, None, [1.0] * 4), (202, 1, None), (203, 1, [0.5, None, 0.0, 0.0]), (None, 1, [0.5] * 4), (204, 2, [float("inf")] * 4), (210, 1, [0.25] * 7), (211, 1, [0.5] * 7), (212, 2, [0.25] * 7), (220, 1, []), (221, 2, [])]
    got = as_rows(mine(vectors(spark, rows), F.col("vec_id") % 10 == 0))
    assert got == plain_mine(rows, lambda i: i % 10 == 0)


def test_mine_repeated_and_windows(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.0]), (1, 1, [0.9, 0.0]), (2, 1, [0.5, 0.0]), (3, 2, [0.85, 0.0]), (3, 2, [0.85, 0.0]), (4, 2, [0.45, 0.0]), (5, 2, [-1.0, 0.0]), (6, 1, [-0.5, 0.0])]
    for low, high in ((80, 100), (50, 95), (0, 120)):
        got = as_rows(mine(vectors(spark, rows), F.col("vec_id") == 0, low=low, high=high))
        assert got == plain_mine(rows, lambda i: i == 0, low=low, high=high)
    assert mine(vectors(spark, rows).limit(0), F.lit(True)).count() == 0
    assert mine(vectors(spark, rows), F.lit(False)).count() == 0


def test_tops_and_scores():
    rng = np.random.default_rng(0)
    tops = Tops(3, 4)
    seen = [[], [], []]
    for _ in range(20):
        g, s, i = rng.integers(0, 3, 50), rng.integers(0, 6, 50), rng.integers(0, 1000, 50)
        tops.add(g, s, i)
        for a, b, c in zip(g, s, i, strict=True):
            seen[a].append((-int(b), int(c)))
    for k in range(3):
        assert list(zip((-tops.score[k]).tolist(), tops.id[k].tolist(), strict=True)) == sorted(seen[k])[:4]
    large = np.array([[1 << 29, 3]])
    assert scores(large, large)[0, 0] == (1 << 58) + 9
    with pytest.raises(OverflowError):
        scores(large << 3, large << 3)


# -- language identification


def test_held_out_accuracy(spark, documents):
    got = cross_checked(documents).join(documents.select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert len(got) == documents.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all()
    asked = got[got.held_out & got.text.str.len().gt(40)]
    assert len(asked) > 20 and (asked.lang == asked.lang_pred).mean() >= 0.95


def test_held_out_teach_nothing(spark, documents):
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    spoilt = documents.withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang")))
    a, b = ({r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in cross_checked(d).collect()} for d in (documents, spoilt))
    assert a == b and "xx" not in {x for x, _ in a.values()}


def test_language_edges(spark, edge, nothing, documents):
    got = {}
    for r in cross_checked(edge).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for k in (5, 6, 7, 14):
        assert got[k][0]["lang_pred"] == "und" and got[k][0]["score"] == 0.0
    assert len(got[15]) == 2 and len(got[None]) == 2
    assert all(r["lang_pred"] in {"en", "de", "es", "fr"} for r in got[12] + got[13] + got[10])
    assert cross_checked(nothing).count() == 0
    none = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in cross_checked(none).collect()} == {("und", 0.0)}
    one = edge.withColumn("lang", F.lit("en"))
    assert {(r["lang_pred"], r["score"]) for r in cross_checked(one).collect()} == {("und", 0.0), ("en", 1.0)}


def test_ambiguity(spark, documents):
    """A text half in one language and half in another gets less than one of either, or is flagged, more often than whole ones."""
    model = fit(documents)
    texts = {lang: " ".join(r["text"] for r in documents.where(F.col("lang") == lang).limit(5).collect() if r["text"])[:4000] for lang in ("de", "fr")}
    words = {k: t.split() for k, t in texts.items()}
    mixed = spark.createDataFrame([(n, " ".join(words["de"][:n] + words["fr"][:n])) for n in range(1, 40)], "doc_id long, text string")
    plain = spark.createDataFrame([(n, " ".join(words["de"][: 2 * n])) for n in range(1, 40)], "doc_id long, text string")
    flagged = [sum(r["ambiguous"] for r in identify(d, model).collect()) for d in (mixed, plain)]
    assert flagged[0] > flagged[1]


def test_codewords_and_windows(monkeypatch):
    for n in (2, 3, 4, 5, 6, 9, 40):
        code = codewords(n)
        assert set(np.unique(code)) == {-1, 1} and not (np.abs(code.sum(axis=0)) == n).any()
        near = min((code[a] != code[b]).sum() for a, b in combinations(range(n), 2))
        assert near == 2 ** (n - 2) if n <= 5 else near >= 5
    texts = [normal(t.encode()) for t in ("Ab c", "", "xyz " * 50, "é è", "q", "longer text than the others " * 30)]
    whole = [Counter(zip(of.tolist(), g.tolist(), strict=True)) for of, g in [(np.concatenate([o for _, o in found(texts)]), np.concatenate([g for g, _ in found(texts)]))]]
    monkeypatch.setattr("voxelframe.llm.language_id.WINDOW", 37)
    cut = Counter((o, g) for gs, os in found(texts) for o, g in zip(os.tolist(), gs.tolist(), strict=True))
    assert cut == whole[0]
    assert normal(b"123 !") == b"" and normal("  —".encode()) == b"" and normal("文".encode()) != b""


# -- scores beside other operators


def test_scores_beside_other_operators(spark, documents):
    """Built before another operator is, collected after it, and of a table in no order: the scores are the same."""
    from voxelframe.llm.lm_scoring import score
    from voxelframe.llm.pii import find_pii

    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    want = {r["doc_id"]: r["score"] for r in score(documents, good).collect()}
    before = score(documents, good)
    other = find_pii(documents)
    got = {r["doc_id"]: r["score"] for r in before.collect()}
    assert other.count() == len(got)
    shuffled = {r["doc_id"]: r["score"] for r in score(documents.orderBy(F.rand()), good).collect()}
    for seen in (got, shuffled):
        assert seen.keys() == want.keys() and all(x == want[k] or abs(x - want[k]) < 1e-9 for k, x in seen.items())
