"""How far the sources of a language diverge from one another, and by which terms.

Terms are counted under 64-bit digests of language and term, and what is shuffled, grouped and joined holds digests and
counts alone. A first pass counts documents, which tells the digests that a language keeps; a second one counts what
passes a sieve of these, source by source. Strings stay where they were found, in a column of the stored counts that
holds each term once for every task. They are read twice: the least and the greatest string of each kept digest tell
collisions, which are counted anew and split by a second digest, and the terms of the result get their text back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize

#: Terms of a language that fewer documents hold aren't kept.
LEAST_DOCS = 10
#: Distinct terms that a task holds before it hands on its counts.
HELD = 600_000
#: Keys up to this many go to every task; beyond it they are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Bits of the sieve, as a power of two, at most.
SIEVE = 27
#: Collided digests that tasks are told; 64 bits have none before there are billions of terms.
MOST_COLLIDED = 100_000
#: Terms times sources that are held as one dense table.
CELLS = 1 << 20
#: Cells of a language that a task holds before it drops those below the first ranks.
CANDIDATES = 1 << 18
#: ASCII letters in lower case, every other ASCII character a blank; bytes of other characters stay.
LETTERS = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
WORD = ["digest", "split"]


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, A to Z in lower case."""
    return text.translate(LETTERS).split()


def _digests(lang: str, found: Iterable[bytes], n: int, keep: int) -> np.ndarray:
    """The digests of ``n`` terms of a language, with the bits of ``keep``."""
    start, digest = lang.encode("utf-8", "surrogatepass") + b"\0", xxhash.xxh3_64_intdigest
    return (np.fromiter((digest(start + t) for t in found), np.uint64, n) & np.uint64(keep)).view(np.int64)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _seen(docs: DataFrame, bits: int) -> DataFrame:
    """(digest, docs): of how many documents of its language a task has met each term in."""
    keep = (1 << bits) - 1

    def flushed(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            digests = _digests(lang, counts, len(counts), keep)
            batch = pa.RecordBatch.from_arrays([pa.array(digests), pa.array(np.fromiter(counts.values(), np.int32, len(counts)))], ["digest", "docs"])
            for at in range(0, len(counts), 1 << 15):
                yield batch.slice(at, 1 << 15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.select([0, 2]).columns), strict=True):
                held.setdefault(lang, Counter()).update(set(terms(text)))
                if sum(map(len, held.values())) >= HELD:
                    yield from flushed(held)
                    held = {}
        yield from flushed(held)

    return docs.mapInArrow(run, "digest long, docs int")


def _sieve(seen: DataFrame, least_docs: int) -> np.ndarray:
    """A bit for every remainder that the digest of a kept term leaves; others may leave the same.

    At most 2 ** SIEVE bits, so it may go through the driver to every task. Terms that pass it in vain are dropped later.
    """
    kept = materialize(seen.groupBy("digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("digest"), "kept")
    size = 1 << min(SIEVE, max(10, (16 * kept.count()).bit_length()))
    place = F.col("digest").bitwiseAND(size - 1)
    words = kept.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


class _Language:
    """What a task knows of a language: its terms that pass the sieve, numbered, and their counts by source."""

    def __init__(self) -> None:
        #: Number of each term that was met, -1 for those that don't pass.
        self.numbers: dict[bytes, int] = {}
        self.terms: list[bytes] = []
        self.digests: list[int] = []
        self.sources: dict[str, int] = {}
        #: Sorted keys (source and term), occurrences and documents of each.
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def learn(self, lang: str, new: list[bytes], keep: int, sieve: np.ndarray) -> None:
        digests = _digests(lang, new, len(new), keep)
        place = digests & (len(sieve) * 64 - 1)
        passes = sieve[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)
        for term, digest, hit in zip(new, digests.tolist(), passes.tolist(), strict=True):
            if hit:
                self.numbers[term] = len(self.terms)
                self.terms.append(term)
                self.digests.append(digest)
            else:
                self.numbers[term] = -1

    def count(self, source: list[str], texts: list[list[bytes]]) -> None:
        at = np.array([self.sources.setdefault(s, len(self.sources)) for s in source], np.int64)
        sizes = [len(t) for t in texts]
        number = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(texts)), np.int64, sum(sizes))
        passes = number >= 0
        pair, occ = np.unique(np.repeat(np.arange(len(texts)), sizes)[passes] << 32 | number[passes], return_counts=True)
        self.parts.append(_added([(at[pair >> 32] << 32 | pair & 0xFFFFFFFF, occ, np.ones(len(pair), np.int64))]))
        if len(self.parts) > 32:
            self.parts = [_added(self.parts)]

    def forget(self) -> None:
        """Terms that don't pass may be asked for again."""
        self.numbers = {t: k for k, t in enumerate(self.terms)}


def _added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal keys added up."""
    key, *counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in counts)


def _counted(docs: DataFrame, bits: int, sieve: np.ndarray, collided: frozenset[int] = frozenset()) -> DataFrame:
    """(lang, source, digest, split, occ, docs, term): counts of the terms of each group that pass the sieve, added up within a task.

    ``split`` is a second digest, never 0, of terms whose digests are ``collided``, and 0 for all others. ``term`` is
    given with the first row of a term that a task hands on.
    """
    names = ["lang", "source", "digest", "split", "occ", "docs", "term"]
    keep = (1 << bits) - 1
    held = docs.sparkSession.sparkContext.broadcast(sieve)

    def handed(lang: str, about: _Language) -> Iterator[pa.RecordBatch]:
        if not about.parts:
            return
        key, occ, docs_ = _added(about.parts)
        digests, number = np.array(about.digests, np.int64), key & 0xFFFFFFFF
        splits = np.zeros(len(digests), np.int64)
        for k in np.flatnonzero(np.isin(digests, list(collided))).tolist() if collided else []:
            splits[k] = _signed(xxhash.xxh64_intdigest(about.terms[k], 1) | 1)
        first = np.zeros(len(key), bool)
        first[np.unique(number, return_index=True)[1]] = True
        known, sources = pa.array(about.terms, pa.binary()), pa.array(list(about.sources), pa.string())
        for start in range(0, len(key), 1 << 14):
            part = slice(start, start + (1 << 14))
            said = known.take(pa.array(number[part], mask=~first[part]))
            cols = [pa.array([lang]).take(pa.array(np.zeros(len(said), np.int32))), sources.take(pa.array(key[part] >> 32)), *(pa.array(x) for x in (digests[number[part]], splits[number[part]], occ[part], docs_[part])), said]
            yield pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, _Language] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                by_lang: dict[str, tuple[list[str], list[list[bytes]]]] = {}
                for lang, source, text in zip(*(c.to_pylist() for c in whole.slice(start, 256).columns), strict=True):
                    sources, texts = by_lang.setdefault(lang, ([], []))
                    sources.append(source)
                    texts.append(terms(text))
                for lang, (sources, texts) in by_lang.items():
                    about = seen.setdefault(lang, _Language())
                    about.learn(lang, list(set(chain.from_iterable(texts)) - about.numbers.keys()), keep, held.value)
                    about.count(sources, texts)
                if sum(len(x.numbers) for x in seen.values()) > HELD:
                    for about in seen.values():
                        about.forget()
                    if 2 * sum(len(x.numbers) for x in seen.values()) > HELD:
                        for lang, about in seen.items():
                            yield from handed(lang, about)
                        seen = {}
        for lang, about in seen.items():
            yield from handed(lang, about)

    return docs.mapInArrow(run, "lang string, source string, digest long, split long, occ long, docs long, term binary")


def proportions(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * kept)), by long division in two steps, as the product may pass 64 bits; of a table of counts with a column for each total, or of counts with their totals."""
    below = totals + 2 * kept
    first, rest = np.divmod((counts + 2) * 100_000, below)
    return 1 + first * 10_000 + rest * 10_000 // below


def _pairs(cells: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, a, b, value): the divergence of each two sources, a < b; a row of ``cells`` is a whole term, so tasks add up what they read."""
    # A row for each language.
    rows = cells.join(checked_broadcast(langs.where("kept > 0 AND size(totals) > 1"), MOST_BROADCAST), "lang").select("lang", "totals", "kept", "ats", "ns")

    def added(sums: np.ndarray, totals: np.ndarray, kept: int, part: pa.RecordBatch) -> None:
        ats, ns = part.column("ats"), part.column("ns")
        term = np.repeat(np.arange(part.num_rows), ats.value_lengths().to_numpy(zero_copy_only=False))
        at, n = (c.flatten().to_numpy(zero_copy_only=False) for c in (ats, ns))
        step = max(1, CELLS // len(totals))
        for start in range(0, part.num_rows, step):
            a, b = np.searchsorted(term, [start, start + step])
            table = np.zeros((min(step, part.num_rows - start), len(totals)), np.int64)
            table[term[a:b] - start, at[a:b]] = n[a:b]
            p = np.ascontiguousarray(proportions(table, totals, kept).T)
            for k in range(len(totals) - 1):
                away = p[k + 1 :] - p[k]
                sums[k, k + 1 :] += (away * away // (p[k + 1 :] + p[k])).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs_ = batch.column("lang").to_numpy(zero_copy_only=False)
            for start, stop in zip(edges := [0, *(np.flatnonzero(langs_[1:] != langs_[:-1]) + 1).tolist()], [*edges[1:], len(langs_)], strict=True):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                totals = np.array(part.column("totals")[0].as_py(), np.int64)
                own = sums.setdefault(langs_[start], np.zeros((len(totals), len(totals)), np.int64))
                added(own, totals, part.column("kept")[0].as_py(), part)
        for lang, own in sums.items():
            for k in range(len(own) - 1):
                m = len(own) - 1 - k
                cols = [pa.array([lang] * m), pa.array(np.full(m, k, np.int32)), pa.array(np.arange(k + 1, k + 1 + m, dtype=np.int32)), pa.array(own[k, k + 1 :])]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "a", "b", "value"])

    return rows.mapInArrow(run, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


class _Best:
    """The cells of a language with the first ``top`` values of each source, and all that equal the last of them."""

    def __init__(self, sources: int, top: int) -> None:
        self.top, self.bars, self.parts, self.held, self.most = top, np.full(sources, -1, np.int64), [], 0, CANDIDATES

    def add(self, at: np.ndarray, value: np.ndarray, *words: np.ndarray) -> None:
        passes = value >= self.bars[at]
        self.parts.append([c[passes] for c in (at, value, *words)])
        self.held += len(self.parts[-1][0])
        if self.held > self.most:
            self.cells()
            self.most = max(CANDIDATES, 2 * self.held)

    def cells(self) -> list[np.ndarray]:
        at, value, *words = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((-value, at))
        of, ordered = at[order], value[order]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        full = first[np.diff(np.append(first, len(of))) >= self.top]
        self.bars[of[full]] = ordered[full + self.top - 1]
        passes = value >= self.bars[at]
        self.parts = [[c[passes] for c in (at, value, *words)]]
        self.held = len(self.parts[0][0])
        return self.parts[0]


def _overused(cells: DataFrame, langs: DataFrame, top: int) -> DataFrame:
    """(lang, at, digest, split, value): terms that a source uses more than its language, of what each task read those with its ``top`` values and their ties."""
    # A row for each language.
    rows = cells.join(checked_broadcast(langs, MOST_BROADCAST), "lang").select("lang", *WORD, "n_lang", "ats", "ns", "totals", "all_n", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, _Best] = {}
        for batch in batches:
            langs_ = batch.column("lang").to_numpy(zero_copy_only=False)
            for start, stop in zip(edges := [0, *(np.flatnonzero(langs_[1:] != langs_[:-1]) + 1).tolist()], [*edges[1:], len(langs_)], strict=True):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                totals, all_n, kept = (part.column(c)[0].as_py() for c in ("totals", "all_n", "kept"))
                totals = np.array(totals, np.int64)
                term = np.repeat(np.arange(part.num_rows), part.column("ats").value_lengths().to_numpy(zero_copy_only=False))
                at, n = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ats", "ns"))
                digest, split, n_lang = (part.column(c).to_numpy(zero_copy_only=False) for c in (*WORD, "n_lang"))
                p, q = proportions(n, totals[at], kept), proportions(n_lang, all_n, kept)[term]
                over = np.flatnonzero(p > q)
                away, both = (p - q)[over], (p + q)[over]
                seen.setdefault(langs_[start], _Best(len(totals), top)).add(at[over], away * away // both, digest[term[over]], split[term[over]])
        for lang, best in seen.items():
            at, value, digest, split = best.cells()
            for start in range(0, len(at), 1 << 15):
                cut = slice(start, start + (1 << 15))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at[cut]), pa.string()), pa.array(at[cut], pa.int32()), *(pa.array(c[cut], pa.int64()) for c in (digest, split, value))], ["lang", "at", *WORD, "value"])

    return rows.mapInArrow(run, "lang string, at int, digest long, split long, value long")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = 10, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence of each source of a language from its others, and its most overused terms.

    A null text, language or source is the empty one. Terms are runs of ASCII letters and of characters beyond ASCII,
    A to Z in lower case. A language keeps the V terms found in ``least_docs`` or more of its documents. A group (a
    source of a language, or a language) gives a kept term found ``count`` times
    p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)), with N its occurrences of all kept terms. The divergence of p from
    q is floor((p - q)^2 / (p + q)). All numbers are whole and exact.

    Part ``pair`` has a row for each other source of the language, its divergence summed over all kept terms (0 where
    none is kept). Part ``term`` has the first ``top`` kept terms that the group uses more than its language, by their
    divergence from it. Ranks count from 1 by value, descending, then by the item's UTF-8 bytes.

    Digests have ``bits`` bits; fewer than 64 are for tests. Collisions are split, so they don't change the result;
    terms that share both digests raise an error. Repeated rows are documents of their own, other columns are ignored,
    an empty table gives no rows. A very long text is counted whole by one task.
    """
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source")))
    rows = docs.select(lang, source, F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    groups = docs.select(lang, source).distinct()
    # A row for each group; sources of a language are numbered.
    groups = materialize(groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "groups")
    numbers = checked_broadcast(groups, MOST_BROADCAST)
    sieve = _sieve(_seen(rows, bits), least_docs)

    def counted(collided: frozenset[int]) -> tuple[DataFrame, DataFrame]:
        """(digest, split, term) as tasks told them, and (lang, digest, split, ats, ns, n_lang) of the kept terms, a row a term."""
        found = materialize(_counted(rows, bits, sieve, collided), "terms")
        numbered = found.join(numbers, ["lang", "source"]).select("lang", *WORD, "at", "occ", "docs")
        of_source = numbered.repartition("lang", *WORD).groupBy("lang", *WORD, "at").agg(F.sum("occ").alias("n"), F.sum("docs").alias("docs"))
        whole = of_source.groupBy("lang", *WORD).agg(F.collect_list(F.struct("at", "n")).alias("cells"), F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"))
        kept = whole.where(F.col("docs") >= least_docs).select("lang", *WORD, F.col("cells.at").alias("ats"), F.col("cells.n").alias("ns"), "n_lang")
        return found.where(F.col("term").isNotNull()).select(*WORD, F.col("term").cast("string").alias("term")), materialize(kept, "cells")

    said, cells = counted(frozenset())

    def named(keys: DataFrame) -> DataFrame:
        """(digest, split, term) of the asked terms, once for every task that met them."""
        return said.join(checked_broadcast(keys, MOST_BROADCAST), WORD)

    def shared() -> list[int]:
        """Digests under which two terms or more were counted as one."""
        both = named(cells.select(*WORD).distinct()).groupBy(*WORD).agg(F.min("term").alias("least"), F.max("term").alias("most"))
        return [r["digest"] for r in both.where("least <> most").select("digest").distinct().limit(MOST_COLLIDED + 1).collect()]

    if collided := shared():
        if len(collided) > MOST_COLLIDED:
            raise ValueError(f"more than {MOST_COLLIDED} digests of {bits} bits are shared by terms")
        said, cells = counted(frozenset(collided))
        if shared():
            raise RuntimeError("two terms share both digests")

    each = cells.select("lang", *WORD, "n_lang", F.explode(F.arrays_zip("ats", "ns")).alias("cell")).select("lang", *WORD, "n_lang", F.col("cell.ats").alias("at"), F.col("cell.ns").alias("n"))
    totals = each.groupBy("lang", "at").agg(F.sum("n").alias("n"))
    of_lang = cells.groupBy("lang").agg(F.sum("n_lang").alias("all_n"), F.count(F.lit(1)).alias("kept"))
    sizes = groups.join(totals, ["lang", "at"], "left").join(of_lang, "lang", "left")
    sizes = materialize(sizes.select("lang", "source", "at", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "all_n", "kept"))), "sizes")
    langs = materialize(sizes.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("totals"), F.max("kept").alias("kept"), F.max("all_n").alias("all_n")), "langs")

    b = sizes.select("lang", F.col("source").alias("item"), F.col("at").alias("to"))
    # Every pair is a row of the result.
    every = sizes.select("lang", "source", "at").join(b, "lang").where(F.col("at") != F.col("to")).withColumns({"a": F.least("at", "to"), "b": F.greatest("at", "to")})
    pairs = every.join(_pairs(cells, langs), ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    in_group = Window.partitionBy("lang", "source")
    pairs = pairs.withColumn("rank", F.row_number().over(in_group.orderBy(F.col("value").desc(), "item")))

    names_of = checked_broadcast(sizes.select("lang", "at", "source"), MOST_BROADCAST)
    over = materialize(_overused(cells, langs, top), "over").join(names_of, ["lang", "at"]).select("lang", "source", *WORD, "value")
    # The value of the last rank; tasks have kept the first ranks of what they read. All ties of it get their text.
    by_value = over.select("lang", "source", "value").withColumn("rank", F.row_number().over(in_group.orderBy(F.col("value").desc()))).where(F.col("rank") <= top)
    bars = checked_broadcast(materialize(by_value.groupBy("lang", "source").agg(F.min("value").alias("bar")), "bars"), MOST_BROADCAST)
    best = materialize(over.join(bars, ["lang", "source"]).where(F.col("value") >= F.col("bar")).drop("bar"), "best")
    texts = named(materialize(best.select(*WORD).distinct(), "asked")).distinct()
    found = best.join(texts, WORD).select("lang", "source", F.col("term").alias("item"), "value")
    found = found.withColumn("rank", F.row_number().over(in_group.orderBy(F.col("value").desc(), "item"))).where(F.col("rank") <= top)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(names).union(found.withColumn("part", F.lit("term")).select(names))


def audit_sql(docs: str = "documents", least_docs: int = LEAST_DOCS, top: int = 10) -> str:
    """DuckDB SQL for ``audit``."""
    upper = "".join(chr(c) for c in range(65, 91))

    def p(count: str, total: str) -> str:
        return f"(1 + (1000000000::HUGEINT * ({count} + 2)) // ({total} + 2 * v))"

    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM {docs}),
    words AS (SELECT r, lang, source, unnest(ws) AS w FROM docs),
    kept AS (SELECT lang, w, count(*) AS c FROM words GROUP BY lang, w HAVING count(DISTINCT r) >= {least_docs}),
    sums AS (SELECT lang, sum(c)::BIGINT AS all_n, count(*) AS v FROM kept GROUP BY lang),
    cells AS (SELECT lang, source, w, count(*) AS c FROM words JOIN kept USING (lang, w) GROUP BY lang, source, w),
    sizes AS (SELECT g.lang, g.source, coalesce(n, 0)::BIGINT AS n, coalesce(all_n, 0) AS all_n, coalesce(v, 0) AS v
              FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN (SELECT lang, source, sum(c) AS n FROM cells GROUP BY ALL) t USING (lang, source) LEFT JOIN sums USING (lang)),
    dense AS (SELECT s.lang, s.source, k.w, coalesce(x.c, 0) AS c, {p("coalesce(x.c, 0)", "n")} AS p, {p("k.c", "all_n")} AS q
              FROM sizes s JOIN kept k ON k.lang = s.lang LEFT JOIN cells x ON x.lang = s.lang AND x.source = s.source AND x.w = k.w),
    added AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
              FROM dense a JOIN dense b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
              FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN added d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
    every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', w, (((p - q) * (p - q)) // (p + q))::BIGINT FROM dense WHERE c > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
    SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
