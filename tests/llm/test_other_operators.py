"""Mixing, secrets, sharding, model scores, decontamination."""

import collections
import math
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from voxelframe.llm.edit_matching import LeakFinder, Pattern, drop_leaks, find_leaks, normal
from voxelframe.llm import lm_scoring
from voxelframe.llm.lm_scoring import score, score_sql, tokens, word_hashes
from voxelframe.llm.mixing import EPOCHS, SEED, WEIGHTS, budgets, mix, mix_sql, standard_levels
from voxelframe.llm.secret_forest import AROUND, CANDIDATE, DICTIONARY, NAMED, candidates, common_words, features, find_secrets, fit, labelled_findings, learn_corpus
from voxelframe.llm.sharding import rendezvous, shard_documents, write_shards

from .conftest import SCHEMA, SF, edge_rows, prose

# -- mixing


def duck_mix(rows, share):
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, lang, source FROM given")
    return sorted(map(str, (tuple(None if x is None or x != x else x for x in r) for r in con.execute(f"SELECT doc_id, domain, lang, source, n_tokens, full_epochs, prefix_tokens, copies FROM ({mix_sql(share)})").fetchall())))


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0, 3.5, 9.0])
def test_mix_against_sql(documents, share):
    got = mix(documents, standard_levels(), WEIGHTS, share=share, epochs=EPOCHS, seed=SEED)
    rows = [tuple(r) for r in documents.select("doc_id", "text", "lang", "source").collect()]
    assert sorted(map(str, map(tuple, got.select("doc_id", "domain", "lang", "source", "n_tokens", "full_epochs", "prefix_tokens", "copies").collect()))) == duck_mix(rows, share)


def test_mix_edges(edge, nothing):
    got = mix(edge, standard_levels(), WEIGHTS, share=0.7, epochs=EPOCHS, seed=SEED)
    rows = pd.DataFrame([r[:4] for r in edge_rows()], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    want = duck_mix(rows, 0.7)
    assert sorted(map(str, map(tuple, got.select("doc_id", "domain", "lang", "source", "n_tokens", "full_epochs", "prefix_tokens", "copies").collect()))) == want
    whole = mix(edge, standard_levels(), WEIGHTS, share=0.7, epochs=EPOCHS, seed=SEED, keep_columns=True)
    assert whole.columns == edge.columns and whole.count() == got.agg(F.sum("copies")).first()[0]
    assert mix(nothing, standard_levels(), WEIGHTS).count() == 0 and mix(nothing, standard_levels(), WEIGHTS, keep_columns=True).count() == 0


def test_the_edge_is_cut_to_the_token(spark):
    one = {"all": F.lit("x")}
    for rows in ([(7, "a b c\td")] * 4, [(None, "a b c\td")] * 4, [(k, f" w{k} x  y\nz ") for k in range(4)]):
        docs = spark.createDataFrame([(d, t, len(t), 1, 2) for d, t in rows], "doc_id long, text string, n_chars long, place long, copies long")
        for budget in (0, 3, 16, 27):
            got = mix(docs, one, {}, budget=budget, epochs=2, seed=3).collect()
            assert sum(r["full_epochs"] * r["n_tokens"] + r["prefix_tokens"] for r in got) == budget
            texts = mix(docs, one, {}, budget=budget, epochs=2, seed=3, keep_columns=True).collect()
            assert sum(len(r["text"].split()) for r in texts) == budget and all(r["n_chars"] == len(r["text"]) for r in texts)
            assert sum(r["text"] not in {t for _, t in rows} for r in texts) == (budget % 4 > 0)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000), ("c", "q", 5), ("d", "never", 500)], "top string, sub string, tokens long")
    weights = {("a",): 2, ("b",): 1, ("c",): 1, ("d",): 0, ("a", "x"): 3, ("a", "y"): 1}
    got = {r["sub"]: r["budget"] for r in budgets(leaves, ["top", "sub"], weights, F.lit(400), 1).collect()}
    # c can't give its 100, so a and b share 395 two to one; x can't give its part of that, y makes it up.
    assert got == {"x": 10, "y": 253, "z": 132, "q": 5}
    whole = {r["sub"]: r["budget"] for r in budgets(leaves, ["top", "sub"], weights, F.lit(10**6), 2).collect()}
    assert whole == {"x": 20, "y": 2000, "z": 2000, "q": 10}


# -- secrets


def test_forest_on_held_out_findings(spark):
    model = fit(labelled_findings(spark, 3000, seed=1))
    rows, _ = features(labelled_findings(spark, 1500, seed=99))
    right = model.transform(rows).agg(F.avg((F.col("_prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.97


def test_whole_families_held_out(spark, documents):
    model = learn_corpus(documents)
    vocabulary = [*DICTIONARY, *common_words(model)]
    # Neither these kinds of secrets (base64, short prefixed keys, 64 hex digits) nor of others (checksums, paths, dotted names) are learned from.
    held = ([2, 3, 7], [2, 5, 12])
    rest = ([k for k in range(10) if k not in held[0]], [k for k in range(14) if k not in held[1]])
    forest = fit(labelled_findings(spark, 3000, seed=1, vocabulary=vocabulary, families=rest), model=model)
    rows, _ = features(labelled_findings(spark, 900, seed=5, vocabulary=vocabulary, families=held), model)
    right = forest.transform(rows).agg(F.avg((F.col("_prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.9


def plain_candidates(text):
    out, ends = [], [0]
    found = list(re.finditer(CANDIDATE, text))
    for k, m in enumerate(found):
        lead = re.match(NAMED, m[0])
        skip = len(lead[0]) if lead else 0
        gap = text[found[k - 1].end() if k else 0 : m.start()]
        ahead = (found[k - 1][0][-AROUND:] if k else "") + gap[-AROUND:] + m[0][:skip]
        rest = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
        behind = rest[:AROUND] + (found[k + 1][0][:AROUND] if k + 1 < len(found) else "")
        out.append((m.start() + skip, m[0][skip:], ahead.split("\n")[-1][-AROUND:], behind.split("\n")[0][:AROUND]))
    return out


def test_candidates_and_features_against_plain_ones(spark, documents, edge):
    texts = [
        "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY and on", 'aws_secret_access_key = "0123456789abcdef0123456789abcdef01234567"', "password: hunter2hunter2!", "Password:short", "x_api_key := 'é$%&/()=?abc', next",
        "abcdefghijklmnop123== tail", "abcdefghijklmnop123=value", "noDigitsInThisVeryLongIdentifier", "a" * 3000 + "1 b", "token=first11111111111111 second2222222222222222\nthird33333333333333333", "tokentokentoken=abcdefgh12 secret => zzzzzzzzzz",
    ]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs in (own, documents.select("doc_id", "text"), edge.where("doc_id <> 16").select("doc_id", "text")):
        rows = docs.collect()
        want = sorted((r["doc_id"], *c) for r in rows for c in plain_candidates(r["text"] or ""))
        got = sorted(tuple(r) for r in candidates(docs).select("doc_id", "start", "found", "before", "after").collect())
        assert got == want
    assert {0, 1, 2, 4, 9, 10} <= {r["doc_id"] for r in candidates(own).collect()}
    model = learn_corpus(documents)
    words = collections.Counter(w for r in documents.collect() for w in re.split("[^a-z]+", r["text"].lower() if r["text"] else "") if 1 <= len(w) <= 30)
    words = {w: n for w, n in words.items() if n >= 5}
    assert {r["word"] for r in model.words.collect()} == set(words)
    code = lambda c: ord(c) - 97 if "a" <= c <= "z" else 26
    steps = collections.Counter()
    for w, n in words.items():
        for a, b in zip(" " + w, w + " "):
            steps[code(a), code(b)] += n
    rows, _ = features(candidates(own.union(documents.select("doc_id", "text"))), model)
    for r in rows.collect():
        s = r["found"]
        low = s.lower()
        walk = [math.log((steps[code(a), code(b)] + 1) / (sum(steps[code(a), k] for k in range(27)) + 27)) for a, b in zip(low, low[1:])]
        parts = re.findall("[a-z]{3,}", re.sub("([a-z])([A-Z])", r"\1 \2", s).lower())
        letters = re.sub("[^a-z]", "", low)
        assert r["f_transitions"] == pytest.approx(sum(walk) / len(walk))
        assert r["f_coverage"] == pytest.approx(sum(len(w) for w in parts if w in words) / max(1, len(letters)))
        assert r["f_length"] == len(s) and r["f_digits"] == pytest.approx(len(re.findall("[0-9]", s)) / len(s))


def test_secrets(spark, nothing):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [
        f'words before token = "{key}" and after', f"commit {key} fixes it", "🙂 api_key: 'Zk83hGq0aPq9LmX72bTnVw41cYdR'\nsecond line", None, "", "nothing here", "x" * 5000 + " 1",
        f"{key} " * 300, f"token={key}", 'see https://example.com/docs/index-2021-04-10.html', 'api_key = "your_api_key_here_123"',
    ]
    docs = spark.createDataFrame([(k, t, "en", "src1", 0, *range(9)) for k, t in enumerate(texts)], SCHEMA)
    found = collections.defaultdict(list)
    for r in find_secrets(docs, labelled_findings(spark), path_col="source").collect():
        found[r["doc_id"]].append(r)
        text = texts[r["doc_id"]]
        import hashlib

        assert hashlib.sha256(text[r["start"] : r["stop"]].encode()).hexdigest() == r["found_sha256"]
    secret = {k for k, rs in found.items() if any(r["is_secret"] for r in rs)}
    assert {0, 2, 8} <= secret and not {1, 9, 10} & secret
    assert len(found[7]) == 300 and [r["start"] for r in sorted(found[7], key=lambda r: r["start"])] == [41 * k for k in range(300)]
    assert not {3, 4, 5} & set(found)
    assert find_secrets(nothing, labelled_findings(spark, 200)).count() == 0


# -- sharding


def plain_shard(key, weights):
    best = None
    for k, w in enumerate(weights):
        if w:
            first = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42) if key is not None else 42
            h = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), first)
            bid = (-math.log(((h >> 11) + 0.5) / (1 << 53)) / w, k)
            best = min(best, bid) if best else bid
    return best[1]


def test_shards(spark, documents, edge, nothing):
    for docs in (documents, edge):
        text = collections.defaultdict(list)
        for r in docs.collect():
            text[r["doc_id"]].append(r["text"] or "")
        got = shard_documents(docs, [1.0] * 40, [1.0] * 41).collect()
        assert len(got) == docs.count()
        slots = collections.defaultdict(list)
        for r in got:
            assert (r["shard"], r["grown_shard"]) == (plain_shard(r["doc_id"], [1.0] * 40), plain_shard(r["doc_id"], [1.0] * 41))
            assert r["grown_shard"] in (r["shard"], 40)
            assert (r["size"], r["text_crc32"]) in {(len(t.encode()) + 16, zlib.crc32(t.encode())) for t in text[r["doc_id"]]}
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(nothing, [1.0, 1.0]).count() == 0
    with pytest.raises(ValueError, match="weights"):
        shard_documents(edge, [0.0])


def test_weights_steer_and_few_records_move(spark, tmp_path):
    ids = spark.range(20000)
    share = {r["s"]: r["count"] / 20000 for r in ids.groupBy(rendezvous(F.col("id"), [1, 2, 0, 5]).alias("s")).count().collect()}
    assert 2 not in share and all(abs(share[k] - w / 8) < 0.02 for k, w in ((0, 1), (1, 2), (3, 5)))
    moved = ids.select(rendezvous(F.col("id"), [1, 2, 0, 5]).alias("a"), rendezvous(F.col("id"), [1, 3, 0, 5]).alias("b")).where("a <> b")
    assert not moved.where("b <> 1").count() and 0.05 < moved.count() / 20000 < 0.12
    docs = spark.createDataFrame([(k, "t") for k in range(50)], "doc_id long, text string")
    write_shards(docs, str(tmp_path / "s"), [1.0] * 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == {(k, plain_shard(k, [1.0] * 4)) for k in range(50)}


# -- language models


def plain_scores(rows, targets, corpus=None, trust=0.5):
    seqs = [(d, [*tokens(t or ""), None]) for d, t in rows]
    trained = seqs if corpus is None else [(d, [*tokens(t or ""), None]) for d, t in corpus]
    single, pair = ([collections.Counter(), collections.Counter()] for _ in range(2))
    for d, seq in trained:
        single[d in targets].update(seq[:-1])
        pair[d in targets].update(zip(seq, seq[1:]))
    v, sums = len(single[0] | single[1]), [sum(c.values()) for c in single]
    scale = [sums[1] / sums[0] if sums[0] and sums[1] else 1, 1]

    def loss(k, d, seq):
        own = (collections.Counter(seq[:-1]), collections.Counter(zip(seq, seq[1:]))) if corpus is None and (d in targets) == k else (collections.Counter(), collections.Counter())
        total = 0
        for a, b in zip(seq, seq[1:]):
            word, two = scale[k] * (single[k][a] - own[0][a]), scale[k] * (pair[k][a, b] - own[1][a, b])
            total -= (1 - trust) * math.log((word + 1) / (scale[k] * (sums[k] - sum(own[0].values())) + v)) + trust * math.log((two + 1) / (word + v + 1))
        return total / (len(seq) - 1) if len(seq) > 1 else None

    return [(d, len(seq) - 1, loss(1, d, seq), loss(0, d, seq)) for d, seq in seqs]


def test_hashes_of_words():
    r = random.Random(1)
    texts = ["", "a", " ", "A b\n\x0bC", "x" * 300, *("".join(r.choice("aAbBé \n\t\x1c\xa0文") for _ in range(r.randint(0, 60))) for _ in range(300))]
    h, sizes = word_hashes([t.encode() for t in texts])
    words = [tokens(t) for t in texts]
    assert sizes.tolist() == list(map(len, words))
    flat = [w for ws in words for w in ws]
    assert len({*zip(flat, h.tolist())}) == len(set(flat)) == len(set(h.tolist())) and 0 not in h.tolist()


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_scores_against_plain_models(spark, nothing, monkeypatch, shard):
    monkeypatch.setattr(lm_scoring, "SHARD", shard)
    rnd = random.Random(5)
    rows = [(k, " ".join(rnd.choice("aa bb CC dd ee ff gg hh ii jj".split()[: 4 + k % 7]) for _ in range(rnd.randint(0, 25)))) for k in range(30)] + [(None, "aa zz"), (40, None), (41, " \n"), (42, "only here"), (43, "only here")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, *range(9)) for d, t in rows], SCHEMA).repartition(3)
    targets = spark.createDataFrame([(k,) for k in range(0, 30, 3)] * 2 + [(999,)], "doc_id long")
    other = rows[:20] + rows[:3]
    for corpus in (None, other):
        want = {str(r[0]): r for r in plain_scores(rows, set(range(0, 30, 3)), corpus)}
        got = score(docs, targets, spark.createDataFrame(corpus, "doc_id long, text string") if corpus else None).collect()
        assert len(got) == len(rows)
        for r in got:
            d, n, t, b = want[str(r["doc_id"])]
            assert r["n_tokens"] == n and (r["target_loss"] is None) == (t is None)
            if n:
                assert r["target_loss"] == pytest.approx(t) and r["background_loss"] == pytest.approx(b) and r["score"] == pytest.approx(t - b)
    assert score(nothing, targets).count() == 0
    assert score(docs, targets.where("false")).count() == len(rows)


def test_scores_at_the_edges(spark, edge):
    targets = spark.createDataFrame([(1,), (12,)], "doc_id long")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in score(edge, targets).collect())
    want = sorted((str(d), n, t - b if n else None) for d, n, t, b in plain_scores([r[:2] for r in edge_rows()], {1, 12}))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == [w[2] if w[2] is None else pytest.approx(w[2]) for w in want]


def test_scores_stay_when_the_table_is_repeated(spark):
    # Words below any share of a larger table still have counts: rare words of the first rows stay apart.
    rows = [(k, f"rare{k // 2} word{k // 2} " + prose(k, 20)) for k in range(40)]
    many = rows + [(1000 + k, prose(k % 50, 60)) for k in range(4000)]
    targets = spark.createDataFrame([(k,) for k in range(10)], "doc_id long")
    want = {r[0]: r for r in plain_scores(many, set(range(10)))}
    got = {r["doc_id"]: r for r in score(spark.createDataFrame(many, "doc_id long, text string"), targets).collect()}
    assert all(got[k]["score"] == pytest.approx(want[k][2] - want[k][3]) for k in range(40))


def test_scores_against_sql(spark, documents):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = sorted(map(tuple, con.execute(score_sql()).fetchall()))
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    got = sorted(tuple(r) for r in score(documents, good).collect())
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and all(x == y if x is None else abs(x - y) < 2e-6 for x, y in zip(g[2:], w[2:]))


def test_scores_tell_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 2 = 1")
    corpus, good_ones = docs.join(held, "doc_id", "left_anti"), labels.where("quality = 1 AND doc_id % 2 = 0").select("doc_id")
    scored = score(docs.join(held, "doc_id", "left_semi"), good_ones, corpus)
    held = scored.join(held, "doc_id").where("n_tokens > 0").select("score", "quality").collect()
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert sum((g < b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.85


# -- decontamination


def distance(p, t):
    d = list(range(len(p) + 1))
    best = d[-1]
    for c in t:
        last, d[0] = d[0], 0
        for i in range(1, len(p) + 1):
            last, d[i] = d[i], min(last + (p[i - 1] != c), d[i] + 1, d[i - 1] + 1)
        best = min(best, d[-1])
    return best


def test_bit_parallel_distance():
    r = random.Random(3)
    for _ in range(1500):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 80)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 90)))
        assert Pattern(p).distance(t) == distance(p, t)


def test_no_match_is_missed():
    r = random.Random(5)
    letters = "abcdefgh the "
    items = [x for x in (normal("".join(r.choice(letters) for _ in range(r.randint(1, 60)))) for _ in range(40)) if x]
    for _ in range(60):
        q = list(r.choice(items))
        for _ in range(r.randint(0, 8)):
            i = r.randrange(len(q) + 1)
            q[i : i + r.randint(0, 1)] = [r.choice(letters)] * r.randint(0, 1)
        t = normal("".join(r.choice(letters) for _ in range(50)) + "".join(q) + "abc the")
        for rate in (0.1, 0.25):
            want = {k: d for k, x in enumerate(items) if (d := distance(x, t)) <= int(len(x) * rate)}
            finder = LeakFinder(tuple(enumerate(items)), rate)
            assert dict(finder.find(t)) == want and len(finder.find(t, first=True)) == min(1, len(want))


def test_leaks_in_documents(spark, documents, edge, nothing):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r["doc_id"]: normal(r["text"]) for r in documents.collect()}
    exact = {(d, r["item_id"]) for r in items.collect() for d, t in texts.items() if normal(r["text"]) in t}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in find_leaks(documents, items).collect()}
    assert exact and exact == {k for k, v in got.items() if v == 0}
    assert sorted(r["doc_id"] for r in drop_leaks(documents, items).collect()) == sorted(set(texts) - {d for d, _ in got})
    own = spark.createDataFrame([(1, prose(15, 70)), (2, None), (3, "  "), (3, prose(15, 70).upper())], "item_id long, text string")
    assert sorted(tuple(r) for r in find_leaks(edge, own).collect()) == [(15, 1, 0), (15, 1, 0), (15, 3, 0), (15, 3, 0)]
    kept = drop_leaks(edge, own)
    assert kept.columns == edge.columns and kept.count() == len(edge_rows()) - 2
    by_name = spark.createDataFrame([(("a", 1), prose(15, 70))], "item_id struct<n:string,k:int>, text string")
    assert [(r["doc_id"], r["item_id"]["n"], r["distance"]) for r in find_leaks(edge, by_name).collect()] == [(15, "a", 0)] * 2
    assert find_leaks(nothing, own).count() == 0 and find_leaks(edge, own.where("false")).count() == 0 and drop_leaks(edge, own.where("false")).count() == len(edge_rows())
