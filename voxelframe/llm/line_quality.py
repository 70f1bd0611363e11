"""Quality rules: counts of a text by itself, and the frequency of its lines across the documents of its host."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, checked_broadcast, materialize, released, text_key

SYMBOLS = "#*$%&|<>"
#: Frequent lines up to this many go to every task; beyond it they are joined by a shuffle.
MOST_BROADCAST = 200_000
DIGITS = bytes.maketrans(b"123456789", b"000000000")


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    found = Counter(grams)
    if len(found) == len(grams):
        return 0
    at = np.array([k for k, g in enumerate(grams) if found[g] > 1])
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[at + i] = True
    return int(covered.sum())


def line_key(host: bytes, line: bytes) -> int:
    """Signed 64-bit hash of a host and a line: lower case (A to Z), white space run together, digits all alike."""
    return _signed(host + b"\0" + _normal(line))


def _normal(line: bytes) -> bytes:
    return b" ".join(line.lower().translate(DIGITS).split())


def _signed(value: bytes) -> int:
    h = xxhash.xxh64_intdigest(value)
    return h - (1 << 64) if h >> 63 else h


def profile(text: str, host: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and of each line with a word: key, words) of one text."""
    raw, at = text.encode(), (host or "").encode()
    words = raw.split()
    blanks = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [(line, n) for line in raw.split(b"\n") if (n := len(line.split()))]
    normal = {line: _normal(line) for line, _ in lines}
    keys = {line: _signed(at + b"\0" + x) for line, x in normal.items()}
    return (
        len(words),
        len(text) - blanks,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(normal),
        repeated_words(words),
        [keys[line] for line, _ in lines],
        [n for _, n in lines],
    )


def _profiles(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = [profile(t or "", h) for t, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                cols = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *cols], names)

    names = ["doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "keys", "sizes"]
    source = batched(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"), text_key(F.col(text_col)).alias("text_key"))
    kinds = [source.schema["doc_id"].dataType.simpleString(), "string"] + ["long"] * 6 + ["array<long>"] * 2
    return source.mapInArrow(released(run), ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def quality_report(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    least_docs: int = 20,
    share: float = 0.002,
    least_left: int = 20,
    least_share: float = 0.3,
) -> DataFrame:
    """One row per document: its counts, base_failed, the lines to remove, and whether it is kept.

    Base rule: a text of fewer than 50 words fails, and one of which more than half of the words lie in repeated windows
    of three words. Cross-document rule: a normalised line found in more than max(``least_docs``, ``share`` * documents
    of the host) documents of a host is removed from all of that host's documents (``removed`` holds the keys
    of such lines, ``removed_words`` their words, repeats included); a document left with fewer than ``least_left``
    words, or less than ``least_share`` of its words, is depleted and rejected. Equal texts of a host are one document,
    in the count of a line and of a host alike, so a text isn't taken for boilerplate because it was copied.

    A null text has no words and fails; a null host is a host of its own, shared with the empty name. Null and repeated
    ids are passed through, each row judged by itself; other columns are ignored; an empty table gives no rows. A very
    long text is read whole by one task.
    """
    rows = materialize(_profiles(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()), "profiles")
    at = F.coalesce("host", F.lit("")).alias("at")
    hosts = rows.groupBy(at, "text_key").agg(F.lit(1).alias("one")).groupBy("at").agg(F.greatest(F.lit(float(least_docs)), F.count(F.lit(1)) * share).alias("most"))
    each = F.explode(F.arrays_zip("keys", "sizes")).alias("line")
    lines = rows.select("row", at, "text_key", each).select("row", "at", "text_key", F.col("line.keys").alias("key"), F.col("line.sizes").alias("size"))
    spread = lines.groupBy("at", "key", "text_key").agg(F.lit(1).alias("one")).groupBy("at", "key").agg(F.count(F.lit(1)).alias("n_docs"))
    frequent = materialize(spread.where(F.col("n_docs") > least_docs).join(hosts, "at").where(F.col("n_docs") > F.col("most")).select("key"), "frequent")
    lost = lines.join(checked_broadcast(frequent, MOST_BROADCAST), "key").groupBy("row").agg(F.sum("size").alias("lost"), F.collect_set("key").alias("removed"))
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        rows.drop("keys", "sizes")
        .join(lost, "row", "left")
        .withColumn("removed_words", F.coalesce("lost", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= least_left) & (left >= least_share * F.col("n_words")))
        .select("doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "removed", "base_failed", "kept")
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str | None = "n_chars", **limits: float) -> DataFrame:
    """The documents that ``quality_report`` keeps, with all their columns, without the lines above the limits.

    Rows are matched to their verdicts by id, host and text, so rows equal in these stay or go together. ``chars_col``,
    if ``docs`` has it, is set to the new length of texts that lost lines. Only what is rejected or changed is joined
    to the texts.
    """
    report = quality_report(docs, id_col, text_col, host_col, **limits)
    told = report.where(~F.col("kept") | F.col("removed").isNotNull()).select(
        F.col("doc_id").alias("__vf_id"), F.coalesce("host", F.lit("")).alias("__vf_host"), F.col("text_key").alias("__vf_key"), F.col("kept").alias("__vf_kept"), F.when(F.col("kept"), F.col("removed")).alias("__vf_removed")
    )
    told = checked_broadcast(materialize(told.dropDuplicates(["__vf_id", "__vf_host", "__vf_key"]), "verdicts"), MOST_BROADCAST)
    same = docs[id_col].eqNullSafe(F.col("__vf_id")) & (F.coalesce(docs[host_col].cast("string"), F.lit("")) == F.col("__vf_host")) & (text_key(docs[text_col]) == F.col("__vf_key"))
    matched = docs.join(told, same, "left").where(F.coalesce("__vf_kept", F.lit(True)))
    text_at, host_at = docs.columns.index(text_col), docs.columns.index(host_col)
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(batch.num_columns - 1)
            cols = batch.columns[:-1]
            if gone.null_count < batch.num_rows:
                texts, sizes = cols[text_at].to_pylist(), cols[chars_at].to_pylist() if chars_at is not None else None
                for k, (keys, host) in enumerate(zip(gone.to_pylist(), cols[host_at].to_pylist(), strict=True)):
                    if keys:
                        drop, at = set(keys), str("" if host is None else host).encode()
                        texts[k] = "\n".join(x for x in texts[k].split("\n") if line_key(at, x.encode()) not in drop)
                        if sizes is not None:
                            sizes[k] = len(texts[k])
                cols[text_at] = pa.array(texts, cols[text_at].type)
                if sizes is not None:
                    cols[chars_at] = pa.array(sizes, cols[chars_at].type)
            yield pa.RecordBatch.from_arrays(cols, docs_names)

    docs_names = docs.columns
    return matched.select(*[F.col(f"`{c}`") for c in docs_names], "__vf_removed").mapInArrow(released(run), docs.schema)


def report_sql(docs: str = "documents", least_docs: int = 20, share: float = 0.002, least_left: int = 20, least_share: float = 0.3) -> str:
    """DuckDB SQL for the counts and verdicts of ``quality_report``."""
    word, blank = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
    upper = "".join(chr(c) for c in range(65, 91))
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM {docs}),
    words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT r, regexp_extract_all(text, '{word}') AS ws FROM docs)),
    grams AS (SELECT r, k, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS g FROM words WINDOW p AS (PARTITION BY r ORDER BY k)),
    twice AS (SELECT r, k, (g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1)::INT AS t FROM grams),
    counted AS (SELECT r, count(*) AS n_words, sum(hit) AS n_repeat_words FROM (SELECT r, max(t) OVER (PARTITION BY r ORDER BY k ROWS 2 PRECEDING) AS hit FROM twice) GROUP BY r),
    lines AS (SELECT *, len(regexp_extract_all(line, '{word}')) AS size,
              trim(regexp_replace(translate(line, '{upper}123456789', '{upper.lower()}000000000'), '{blank}+', ' ', 'g')) AS normal
              FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{word}')),
    per AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
    limits AS (SELECT host, greatest({least_docs}, count(DISTINCT text) * {share}) AS most FROM docs GROUP BY host),
    frequent AS (SELECT host, normal FROM (SELECT host, normal, count(DISTINCT text) AS n FROM lines GROUP BY ALL) JOIN limits USING (host) WHERE n > most),
    lost AS (SELECT r, sum(size)::BIGINT AS removed_words FROM lines JOIN frequent USING (host, normal) GROUP BY r),
    found AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, length(regexp_replace(text, '{blank}', '', 'g'))::BIGINT AS word_chars,
              length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
              coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
              FROM docs LEFT JOIN counted USING (r) LEFT JOIN per USING (r) LEFT JOIN lost USING (r)),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM found)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND n_words - removed_words >= {least_left} AND n_words - removed_words >= {least_share} * n_words AS kept, removed_words
    FROM judged"""
