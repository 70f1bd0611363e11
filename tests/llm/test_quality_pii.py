"""Quality rules and personal data."""

import collections
import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest

from voxelframe.llm.line_quality import keep_good, quality_report, report_sql
from voxelframe.llm.pii import KINDS, find_pii, find_spans, luhn, plain_spans

from .conftest import SCHEMA, edge_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    seen = collections.Counter(grams)
    covered = {j for k, g in enumerate(grams) if seen[g] > 1 for j in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def report(docs, **more):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return [tuple(r[c] for c in cols) for r in quality_report(docs, **more).collect()]


def test_base_counts(documents, edge, nothing):
    for docs in (documents, edge):
        want = []
        for r in docs.collect():
            c = counts(r["text"])
            want.append((r["doc_id"], *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
        assert sorted((x[:7] for x in report(docs)), key=str) == sorted(want, key=str)
    assert report(nothing) == [] and keep_good(nothing).count() == 0


def test_lines_across_documents(spark):
    banner, rare = "Read MORE at 10 places  today or tomorrow", "only a few have this line of text"
    rows = []
    for k in range(40):
        text = f"{prose(k, 30)}\n{banner if k % 2 else banner.lower().replace('10', '77')}\n{prose(k + 1000, 40)}"
        rows.append((k, text + ("\n" + rare if k < 5 else ""), "en", "hot"))
    shell = "\n".join(prose(2000 + j, 13) for j in range(8))
    rows += [(100 + k, f"{prose(k + 500, 6)}\n{shell}", "en", "hot") for k in range(30)]
    rows += [(200 + k, f"{prose(7, 70)}\n{prose(8, 30)}", "en", "copies") for k in range(300)]
    rows += [(600 + k, f"{banner}\n{prose(k + 900, 60)}", "en", "cold") for k in range(9)]
    rows = [(*r, len(r[1]), *range(9)) for r in rows]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in quality_report(docs, least_docs=20).collect()}
    assert all(got[k]["kept"] and got[k]["removed_words"] == 8 for k in range(40))
    assert all(not got[100 + k]["kept"] and not got[100 + k]["base_failed"] for k in range(30))
    assert all(got[200 + k]["kept"] and not got[200 + k]["removed_words"] for k in range(300))
    assert all(got[600 + k]["kept"] and not got[600 + k]["removed_words"] for k in range(9))
    kept = {r["doc_id"]: r for r in keep_good(docs, least_docs=20).collect()}
    assert set(kept) == {k for k, r in got.items() if r["kept"]}
    assert kept[0].asDict().keys() == set(docs.columns)
    assert kept[1]["text"] == f"{prose(1, 30)}\n{prose(1001, 40)}\n{rare}" and kept[1]["n_chars"] == len(kept[1]["text"])
    assert kept[600]["text"] == rows[-9][1]


def test_documents_around_common_frames_are_counted_one_by_one(spark):
    # 60 documents of one host share a footer; each of three sections of 20 shares four lines of its own.
    footer = "the same footer stands below all of these pages"
    for trial in range(4):
        rows = []
        for k in range(60):
            frame = [f"section {'xyz'[k // 20]} of trial {'pqrs'[trial]} has line {'abcd'[j]} above its pages" for j in range(4)]
            rows.append((k, "\n".join([*frame, prose(k + 97 * trial, 60), footer]), "en", "h", 0, *range(9)))
        got = quality_report(spark.createDataFrame(rows, SCHEMA), least_docs=20).collect()
        assert [r["removed_words"] for r in got] == [9] * 60


def test_verdicts_go_by_host(spark):
    footer = "a footer that only one of the hosts repeats"
    rows = [(k, f"{prose(k, 60)}\n{footer}", "en", "often", 0, *range(9)) for k in range(30)]
    rows.append((3, rows[3][1], "en", "once", 0, *range(9)))
    kept = [r for r in keep_good(spark.createDataFrame(rows, SCHEMA), chars_col=None).collect() if r["doc_id"] == 3]
    assert {r["source"]: footer in r["text"] for r in kept} == {"often": False, "once": True}
    assert {r["n_chars"] for r in kept} == {0}
    bare = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "source")
    assert keep_good(bare).columns == ["doc_id", "text", "source"] and keep_good(bare).count() == 31


def test_report_against_sql(spark, documents, edge):
    for docs, limits in ((documents, {}), (documents, {"least_docs": 2, "least_share": 0.9}), (edge, {"least_docs": 1})):
        con = duckdb.connect()
        con.register("given", pd.DataFrame([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
        con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM given")
        want = con.execute(report_sql(**limits)).df()
        got = quality_report(docs, **limits).toPandas()[list(want)]
        assert sorted(map(str, got.astype({"doc_id": "Int64"}).itertuples(index=False))) == sorted(map(str, want.astype({"doc_id": "Int64"}).itertuples(index=False)))
        if docs is documents and limits:
            assert (want["removed_words"] > 0).any()


def test_edge_rows_pass_whole(edge):
    kept = keep_good(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(15) == 2 and ids.count(16) == 2 and None in ids and 5 not in ids and 6 not in ids and 11 not in ids


def plain(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_plain_spans():
    r = random.Random(2)
    parts = ["a", "b.", "@", "1", "2", "3", "9", ".", "-", " ", "+", "(", ")", "c.d", "%", "é", "12345678", "4532015112830366"]
    for _ in range(20000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        assert plain(t) == plain_spans(t), repr(t)
    for long in ("1" * 50000, "a" * 50000, "1." * 30000, "+1" + "(" * 50000, "a@" * 20000):
        plain_spans(long)


DISGUISED = [
    ("email", "john (at) example (dot) com"), ("email", "john[at]example[dot]com"), ("email", "john at example dot com"), ("email", "J.Doe AT mail.example DOT com"),
    ("email", "jоhn@exаmple.com"), ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("email", "jo​hn@example.com"), ("email", "john{at}example{dot}co{dot}uk"), ("email", "john @ example.com"), ("email", "john&#64;example.com"),
    ("ip", "one nine two dot one six eight dot one dot one"), ("ip", "１９２．１６８．０．１"), ("ip", "192 dot 168 dot 0 dot 1"), ("ip", "192[.]168[.]0[.]1"),
    ("card", "four five three two zero one five one one two eight three zero three six six"), ("card", "４５３２ ０１５１ １２８３ ０３６６"),
    ("email", "𝐣𝐨𝐡𝐧@𝗲𝘅𝗮𝗺𝗽𝗹𝗲.𝚌𝚘𝚖"), ("email", "jose\u0301.luis@example.com"), ("phone", "plus one triple five one two three four five six seven"), ("phone", "double five five one two three four double six seven"),
    ("phone", "plus one five five five one two three four five six seven"), ("phone", "five five five one two three four five six seven"), ("phone", "+１ 555 123 4567"),
]


@pytest.mark.parametrize(("kind", "text"), DISGUISED)
def test_disguises_map_back(kind, text):
    for before, after in (("", ""), ("é so: ", " and on"), ("ein Satz davor.\n", "\nder nächste")):
        base, every = find_spans(before + text + after)
        assert (kind, len(before), len(before) + len(text)) in every
        assert set(base) <= set(every)


@pytest.mark.parametrize("text", ["john@example dot com", "john dot smith at example dot com", "a dot b dot c (at) mail dot example dot com", "john dot smith @ example.com"])
def test_bare_dots_alone_in_a_text(text):
    assert ("email", 9, 9 + len(text)) in find_spans("write to " + text)[1]


def test_words_before_plain_addresses_stay():
    assert find_spans("contact point info@example.com")[1] == [("email", 14, 30)]
    for long in ("a dot " * 20000 + "at b dot c", "a dot b at c dot d " * 5000):
        find_spans(long)


def test_clean_text_stays_clean():
    for text in ("look at example.com and the dot of", "one two three four five six seven eight nine ten", "un un un un un un un un un un un un", "at a point", "meet at noon (dot) com", "price 3.50 at 12 dot", "Кафе и Москва"):
        assert find_spans(text) == ([], [])


def test_pii_rows(documents, edge, nothing):
    for docs in (documents, edge):
        for r in find_pii(docs).collect():
            assert r["n_added"] == (len(r["spans"].split(",")) if r["spans"] else 0) - sum(r[f"n_{k}"] for k in KINDS)
        text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in (None, 16)}
        for r in find_pii(docs).collect():
            if r["doc_id"] in text:
                want = sorted(plain(text[r["doc_id"]] or ""), key=lambda s: (KINDS.index(s[0]), s[1]))
                assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
                assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in want) for k in KINDS]
    assert find_pii(edge).count() == len(edge_rows()) and find_pii(nothing).count() == 0
