"""Hard negatives: for an anchor and each of its positives, the best rows of other labels in a window below the positive's score.

All anchors meet all rows, anchors in waves of bounded size that every task holds and rows streaming by. A task keeps
only the best few rows of each anchor (and slot), which is what is shuffled.

An anchor's windows overlap, one for each positive. Their distinct upper limits, from the highest down, cut the scores
into slots that don't overlap: a row falls into the slot of the least limit that isn't below it, and the best ``k`` rows
of a slot are all that any window can want from it. A window's rows are then the first ``k`` of its own slot and those
below, which follow one another in descending order, down to the window's lower limit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_dir

#: Bytes of the anchors that every task holds at once.
WAVE_BYTES = 1 << 24
#: Rows and anchors whose scores are held at once.
ROWS, ANCHORS = 1024, 1024
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Tops:
    """The best ``k`` (score, id) of each of ``n`` groups: higher scores first, then smaller ids. Empty places have the score LEAST."""

    def __init__(self, n: int, k: int) -> None:
        self.score = np.full((n, k), LEAST)
        self.id = np.full((n, k), MOST)

    def add(self, group: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        last = self.score[group, -1]
        enters = (score > last) | ((score == last) & (id_ < self.id[group, -1]))
        group, score, id_ = group[enters], score[enters], id_[enters]
        if not len(group):
            return
        touched, at = np.unique(group, return_inverse=True)
        k = self.score.shape[1]
        at = np.concatenate([np.repeat(np.arange(len(touched)), k), at])
        score = np.concatenate([self.score[touched].ravel(), score])
        id_ = np.concatenate([self.id[touched].ravel(), id_])
        order = np.lexsort((id_, ~score, at))
        first = np.searchsorted(at[order], np.arange(len(touched)))
        best = order[first[:, None] + np.arange(k)]
        self.score[touched], self.id[touched] = score[best], id_[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, id and score of what is held."""
        group, place = np.nonzero(self.score != LEAST)
        return group, self.id[group, place], self.score[group, place]


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers, anchors by rows."""
    reach = float(np.abs(anchors.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0)) * anchors.shape[1]
    if reach < 1 << 53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if reach < 1 << 62:
        return anchors @ rows.T
    raise OverflowError("scores don't fit 64 bits")


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of each length of vectors, and their vectors."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[starts[at][:, None] + np.arange(size)]


class Wave:
    """Anchors of one wave: their numbers, ids, labels and vectors by length, and of each its limits from the highest down and its least score."""

    def __init__(self, rows: pa.Table) -> None:
        self.anchor, self.id, self.label = (rows[c].to_numpy() for c in ("anchor", "id", "label"))
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        for at, vectors in _vectors(rows["q"].combine_chunks()):
            self.blocks += [(at[k : k + ANCHORS], vectors[k : k + ANCHORS]) for k in range(0, len(at), ANCHORS)]
        self.limits = np.zeros((len(self.anchor), 0), np.int64)
        self.least = np.zeros(len(self.anchor), np.int64)

    def bound(self, windows: pa.Table, k: int) -> Wave:
        """The wave with the limits of its anchors: rows (anchor, slot, hi, lo) of their windows; anchors without any want nothing."""
        self.limits, self.least = np.full((len(self.anchor), k), LEAST), np.full(len(self.anchor), MOST)
        order = np.argsort(self.anchor)
        at = order[np.searchsorted(self.anchor[order], windows["anchor"].to_numpy())]
        self.limits[at, windows["slot"].to_numpy()] = windows["hi"].to_numpy()
        np.minimum.at(self.least, at, windows["lo"].to_numpy())
        return self


def _meet(rows: DataFrame, wave: Wave, k: int, negatives: bool) -> DataFrame:
    """(anchor, slot, id, score): the best ``k`` rows of each anchor that a task has seen, of its own label, or of other labels and by slot."""
    held = rows.sparkSession.sparkContext.broadcast(wave)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave = held.value
        slots = wave.limits.shape[1] if negatives else 1
        tops = Tops(len(wave.anchor) * slots, k)
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for places, vectors in _vectors(batch.column(2)):
                for start in range(0, len(places), ROWS):
                    at, part = places[start : start + ROWS], vectors[start : start + ROWS]
                    for who, anchors in wave.blocks:
                        if anchors.shape[1] != part.shape[1]:
                            continue
                        score = scores(anchors, part)
                        alike = wave.label[who][:, None] == labels[at]
                        if negatives:
                            wanted = ~alike & (score <= wave.limits[who, :1]) & (score >= wave.least[who][:, None])
                        else:
                            wanted = alike & (score >= tops.score[who, -1:]) & (wave.id[who][:, None] != ids[at])
                        a, r = np.nonzero(wanted)
                        found, group = score[a, r], who[a]
                        if negatives:
                            group = group * slots + (wave.limits[group] >= found[:, None]).sum(axis=1) - 1
                        tops.add(group, found, ids[at[r]])
        group, id_, score = tops.rows()
        for start in range(0, len(group), 1 << 16):
            part = slice(start, start + (1 << 16))
            cols = wave.anchor[group[part] // slots], (group[part] % slots).astype(np.int32), id_[part], score[part]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "slot", "id", "score"])

    return rows.mapInArrow(run, "anchor long, slot int, id long, score long")


def _first(df: DataFrame, k: int, *group: str) -> DataFrame:
    """The best ``k`` rows of each group, numbered from 1; Spark keeps ``k`` a group before it shuffles."""
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), "id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _floor_div(x: str, y: int) -> Column:
    """x / y rounded down, in whole numbers."""
    return F.expr(f"(({x}) - pmod({x}, {y})) div {y}")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the negatives of each anchor and positive, best first.

    Rows where ``anchors`` holds are anchors. Components become floor(``scale`` * x), a score is an exact integer inner
    product; higher scores come first, equal ones by the smaller id. An anchor's positives are its first ``positives``
    other rows of its label; a positive's negatives are the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    A row without an id, a label or a vector, or with a null or infinite component or one that is no number, takes no
    part. Rows of an anchor's own id are never its positives; otherwise a repeated row stands for itself, and a repeated
    anchor is answered each time. Vectors of different lengths aren't compared; empty ones have the score 0. An anchor
    without positives, or a positive without negatives, gives no row. Scores beyond 62 bits raise OverflowError. Other
    columns are ignored, an empty table gives no rows.
    """
    spark = rows.sparkSession
    vector = F.col(vector_col)
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    taking_part = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vector.isNotNull() & fine
    chosen = rows.where(taking_part).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("q"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    stored = materialize(chosen, "vectors")
    asking = materialize(stored.where("asks").select("id", "label", "q").withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    told = asking.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    a_wave = max(1, WAVE_BYTES // (8 * max(1, told[1] or 0) + 24))
    waves = max(1, -(-told[0] // a_wave))
    # Anchors dealt evenly, as their numbers start anew in every partition.
    dealt = F.pmod(F.xxhash64("anchor"), F.lit(waves))
    seen = stored.select("id", "label", "q").coalesce(4 * spark.sparkContext.defaultParallelism)
    path = f"{scratch_dir(spark)}/negatives-{uuid.uuid4().hex}"
    for number in range(waves):
        mine_ = asking.where(dealt == number)
        wave = Wave(mine_.select("anchor", "id", "label", "q").toArrow())
        best = materialize(_first(_meet(seen, wave, positives, False), positives, "anchor").select("anchor", "id", "score"), "positives")
        limits = best.withColumn("lo", -_floor_div(f"-score * {low}", 100)).withColumn("hi", _floor_div(f"score * {high}", 100)).where("lo <= hi")
        windows = materialize(limits.withColumn("slot", F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.col("hi").desc())) - 1), "windows")
        # At most ``positives`` rows for each anchor of the wave.
        wave = wave.bound(windows.select("anchor", "slot", "hi", "lo").toArrow(), positives)
        found = _first(_meet(seen, wave, negatives, True), negatives, "anchor", "slot")
        # Slots are disjoint and descend, so one list by slot, then score, holds every window as a stretch of itself.
        lists = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "id"))).alias("list"))
        before = F.size(F.filter("list", lambda x: x["slot"] < F.col("slot")))
        stretch = F.filter(F.slice("list", before + 1, negatives), lambda x: -x["down"] >= F.col("lo"))
        out = windows.join(lists, "anchor").select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(stretch).alias("place", "hit"))
        out = out.join(mine_.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
            "anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("negative_id"), "positive_score", (-F.col("hit.down")).alias("negative_score")
        )
        out.write.mode("append").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def mine_sql(positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> str:
    """DuckDB SQL for ``mine`` over ``embeddings``, with the changed labels and the anchors of the query."""
    return f"""
    WITH rows AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                         [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
                  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    met AS (SELECT a.id AS anchor, b.id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM rows a JOIN rows b ON a.id <> b.id WHERE a.id % 100 = 0),
    best AS (SELECT anchor, id, score FROM met WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= {positives}),
    found AS (SELECT p.anchor, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                     row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS rank
              FROM best p JOIN met n ON n.anchor = p.anchor AND NOT n.alike AND {low} * p.score <= 100 * n.score AND 100 * n.score <= {high} * p.score)
    SELECT anchor AS anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= {negatives}"""
