"""The pipeline, stage by stage, against plain versions."""

import re

import pandas as pd
import pytest

from .conftest import SF
from .test_other_operators import distance, duck_mix
from .test_quality_pii import counts
from .test_simhash import brute, shingles

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

from voxelframe.llm.common import materialize  # noqa: E402

from .test_tokens import plain as plain_tokens  # noqa: E402


def least_of(classes, pairs):
    """The least id of every document's component, given classes and further links."""
    root = dict(classes)

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


def test_stages(spark, documents):
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_files"]
    rows = lambda df: sorted((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect())
    step = lambda name, df: materialize(stages[name](spark, df, SF), name)

    good = step("quality_rules", documents)
    # So few documents that no line is above the limits: the base rule alone decides.
    want = [r for r in rows(documents) if (c := counts(r[1]))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    assert rows(good) == want and good.columns == documents.columns

    once = step("simhash_near_dedup", good)
    kept = {r["doc_id"] for r in once.collect()}
    by_bits = {d: c for d, _, c in brute([r[:2] for r in want], 5, 3)}
    sets = [(r[0], shingles(r[1])) for r in want]
    alike = [(a, b, len(x & y) / len(x | y)) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :]]
    # The shingles themselves decide: 0.8 of them, or 3 bits of the fingerprint.
    least = least_of(by_bits, [(a, b) for a, b, s in alike if s >= 0.8])
    assert kept == {d for d, c in least.items() if d == c}
    want = [r for r in want if r[0] in kept]
    assert rows(once) == want and len(want) < good.count()

    clean = step("benchmark_decontamination", once)
    level = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    items = [level(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    suspects = {r[0] for r in want if any(x[k : k + 12] in level(r[1]) for x in items for k in range(0, len(x) - 12, 4))}
    leaked = {r[0] for r in want if r[0] in suspects and any(distance(x, level(r[1])) <= len(x) // 10 for x in items if any(x[k : k + 12] in level(r[1]) for k in range(0, len(x) - 12, 4)))}
    want = [r for r in want if r[0] not in leaked]
    assert rows(clean) == want and leaked

    mixed = step("source_mixing", clean)
    taken = {}
    for line in duck_mix(pd.DataFrame([r[:4] for r in want], columns=["doc_id", "text", "lang", "source"]), 1.0):
        doc, *_, epochs, prefix, copies = line.strip("()").split(", ")
        taken[int(doc)] = int(epochs), int(prefix), int(copies)

    def copies_of(r):
        epochs, prefix, copies = taken.get(r[0], (0, 0, 0))
        text = re.match(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+){%d}" % prefix, r[1])[0]
        # The last copy of a document on an edge ends with its prefix.
        last = r if prefix == counts(r[1])[0] else (r[0], text, *r[2:4], len(text))
        return [r] * epochs + [last] * (copies - epochs)

    want = sorted(x for r in want for x in copies_of(r))
    assert rows(mixed) == want and mixed.columns == documents.columns

    final = sorted(tuple(r) for r in stages["token_files"](spark, mixed, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    # Rows of one id stand side by side in an order of their own; nothing else is open.
    assert sorted((d, n, c) for d, _, n, c in final) == sorted((d, n, c) for d, _, n, c in plain_tokens([r[:2] for r in want]))
    at = 0
    for d, start, n, _ in sorted(final, key=lambda x: (x[0], x[1])):
        assert start == at, d
        at += n
    assert sorted(tuple(r) for r in pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == final


def test_stages_at_the_edges(spark, edge, nothing):
    """Nulls, blank and long texts, repeated rows, clashing columns and empty tables pass every stage."""
    texts = [(r["doc_id"], r["text"]) for r in edge.collect()]
    for name, stage in pipeline.STAGES[:-1]:
        kept, none = stage(spark, edge, SF), stage(spark, nothing, SF)
        assert kept.columns == none.columns == edge.columns and none.count() == 0, name
        rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert rows, name
        if name != "source_mixing":
            assert all(rows.count(r) <= texts.count(r) for r in rows), name
    last = pipeline.STAGES[-1][1]
    assert last(spark, edge, SF).count() == len(texts) and last(spark, nothing, SF).count() == 0
