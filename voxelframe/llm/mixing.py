"""Mixing sources to target weights: budgets flow down a tree of domains, languages and sources.

Only DataFrame and SQL functions are used here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checked_broadcast, materialize

NONE = "(none)"
BIG = "decimal(38,0)"
#: Bits of a document's 60-bit place in an epoch by which tokens are summed before any sorting.
COARSE = 12
MOST_LEAVES = 20_000


def words(text: Column) -> Column:
    """Tokens of a text, counted as words between ASCII white space; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(seed: int, epoch: Column, key: Column, digest: Column) -> Column:
    """A document's place in the order of one epoch: 60 bits of a hash of seed, epoch, id and text (by its MD5)."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")), digest)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    # A piece is white space and a word; only the last one may be without a word, and no count reaches it.
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")


def divide(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Divide each parent's ``given`` among its children by ``weight``, none above its ``capacity``.

    Whole tokens; what a full child can't take goes to its siblings in proportion to their weights. ``given`` must not
    exceed the sum of the capacities. Adds ``share`` and drops ``given``.
    """
    siblings = Window.partitionBy(*parent)
    by_fill = siblings.orderBy(F.col("capacity").cast("double") / F.col("weight"), name)
    ahead = by_fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    big = lambda c: F.col(c).cast(BIG)
    found = (
        nodes.withColumn("filled", F.sum("capacity").over(ahead) - F.col("capacity"))
        .withColumn("rest", F.sum("weight").over(behind))
        .withColumn("full", big("capacity") * big("rest") <= big("weight") * (big("given") - big("filled")))
        .withColumn("left", F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(siblings), F.lit(0)))
        .withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(siblings))
        .withColumn("part", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr(f"cast(weight as {BIG}) * cast(left as {BIG}) div open")))
        .withColumn("odd", F.when(~F.col("full"), F.expr(f"cast(weight as {BIG}) * cast(left as {BIG}) % open")))
        .withColumn("spare", F.col("given") - F.sum("part").over(siblings))
    )
    turn = F.row_number().over(siblings.orderBy(F.col("odd").desc_nulls_last(), name))
    return found.withColumn("share", F.col("part") + F.when(~F.col("full") & (turn <= F.col("spare")), 1).otherwise(0)).drop("filled", "rest", "full", "left", "open", "part", "odd", "spare", "given")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], int], budget: Column, epochs: int) -> DataFrame:
    """Budget of each leaf (columns of ``levels``, ``tokens``) in tokens.

    ``weights`` maps paths from the root, such as ("web",) or ("web", "en", "src1"), to whole weights; 1 where none is
    given, and 0 shuts a branch. A leaf can give ``epochs`` times its tokens, a branch what its leaves can. Going down
    from the root, each branch's budget is divided among its children by weight, so a shortage is made up by the
    nearest siblings and passes to the branch's own siblings only when those are exhausted too.
    """
    spark, n = leaves.sparkSession, len(levels)
    rows = [(*path, *[None] * (n - len(path)), len(path), int(w)) for path, w in weights.items()]
    told = spark.createDataFrame(rows, ", ".join(f"_{c} string" for c in levels) + ", depth int, w long")
    nodes = leaves.withColumn("capacity", (F.col("tokens") * epochs).cast("long"))
    for depth in range(1, n + 1):
        here = told.where(F.col("depth") == depth).select(*(f"_{c}" for c in levels[:depth]), F.col("w").alias(f"w{depth}"))
        on = [F.col(c) == F.col(f"_{c}") for c in levels[:depth]]
        nodes = nodes.join(F.broadcast(here), on, "left").drop(*(f"_{c}" for c in levels)).withColumn(f"w{depth}", F.coalesce(f"w{depth}", F.lit(1)))
    nodes = nodes.where(" AND ".join(f"w{d} > 0" for d in range(1, n + 1))).withColumn("_root", F.lit(0))
    whole = nodes.agg(F.coalesce(F.sum("capacity"), F.lit(0)).alias("all"), F.first(budget).alias("wanted"))
    given = whole.select(F.lit(0).alias("_root"), F.least("all", F.coalesce("wanted", F.lit(0))).cast("long").alias("given"))
    above: list[str] = ["_root"]
    for depth in range(1, n + 1):
        own = [*above, levels[depth - 1]]
        level = nodes.groupBy(*own).agg(F.sum("capacity").cast("long").alias("capacity"), F.first(f"w{depth}").alias("weight"))
        shares = divide(level.join(given, above), above, levels[depth - 1])
        given, above = shares.select(*own, F.col("share").cast("long").alias("given")), own
    return given.join(leaves.withColumn("_root", F.lit(0)), above).select(*levels, "tokens", F.col("given").alias("budget"))


def plan(rows: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], int], budget: int | None, share: float, epochs: int, seed: int) -> DataFrame:
    """One row per leaf: tokens, budget, full_epochs, rest, and where the last epoch's prefix ends (cut, cut_before).

    ``rows`` has the columns of ``levels``, doc_id, digest and n_tokens, and is read three times: materialise it.
    """
    leaves = materialize(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    wanted = F.lit(budget).cast("long") if budget is not None else F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * F.lit(share)).cast("long")
    given = budgets(leaves.withColumn("_wanted", wanted), levels, weights, F.col("_wanted"), epochs)
    some = F.col("tokens") > 0
    given = given.select(*levels, "tokens", "budget", F.when(some, F.expr("budget div tokens")).otherwise(0).alias("full_epochs"), F.when(some, F.expr("budget % tokens")).otherwise(0).alias("rest"))
    given = materialize(given, "budgets")
    coming = rows.join(checked_broadcast(given.where("rest > 0"), MOST_LEAVES), list(levels))
    placed = coming.withColumn("place", place(seed, F.col("full_epochs") + 1, F.col("doc_id"), F.col("digest"))).withColumn("coarse", F.shiftright("place", 60 - COARSE))
    sums = placed.groupBy(*levels, "coarse").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    before = F.sum("n").over(Window.partitionBy(*levels).orderBy("coarse")) - F.col("n")
    edge = sums.withColumn("ahead", before).where("ahead < rest AND rest <= ahead + n").select(*levels, "coarse", "ahead")
    inside = placed.join(edge, [*levels, "coarse"]).groupBy(*levels, "place").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.first("ahead").alias("ahead"))
    within = F.col("ahead") + F.sum("n").over(Window.partitionBy(*levels).orderBy("place")) - F.col("n")
    cuts = inside.withColumn("start", within).where("start < rest").groupBy(*levels).agg(F.max("place").alias("cut"), F.max("start").alias("cut_before"))
    return given.join(cuts, list(levels), "left").select(*levels, "tokens", "budget", "full_epochs", "rest", F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("cut_before", F.lit(0)).alias("cut_before"))


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[tuple[str, ...], int],
    budget: int | None = None,
    share: float = 1.0,
    epochs: int = 4,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_columns: bool = False,
    chars_col: str = "n_chars",
) -> DataFrame:
    """The documents that a mix takes, each leaf a prefix of seeded epochs as long as its budget.

    ``levels`` names the tree's levels from the root and gives a column for each; nulls there are "(none)". The budget
    is ``budget`` tokens, or else ``share`` of all tokens; where all branches together can't give it, all they can give
    is taken. A leaf whose budget is ``e`` times its tokens plus a rest takes every document ``e`` times, then, in the
    order of epoch ``e + 1``, documents until the rest is spent; the document on the edge is taken with its first
    ``prefix_tokens`` tokens. Rows equal in id and text stand at one place of an epoch, one behind the other. Null texts
    have no tokens; a leaf without tokens gives nothing. Ids may be null, an empty table gives no rows, a very long text
    is one row like any other.

    Returns one row per document taken: doc_id, the levels, n_tokens, full_epochs, prefix_tokens (of the last epoch),
    copies. With ``keep_columns`` it returns the rows of ``docs`` instead, once for each copy: whole, but for the last
    copy of the documents on the edges, whose texts end with their prefixes (and ``chars_col``, if there, tells the new
    length).
    """
    named = {c: F.coalesce(e.cast("string"), F.lit(NONE)) for c, e in levels.items()}
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), words(F.col(text_col)).alias("n_tokens"), *(e.alias(c) for c, e in named.items())), "rows")
    leaves = materialize(plan(rows, list(levels), weights, budget, share, epochs, seed), "plan")
    told = checked_broadcast(leaves.select(F.struct(*levels).alias("__vf_leaf"), F.struct("full_epochs", "rest", "cut", "cut_before").alias("__vf_plan")), MOST_LEAVES)
    plan_of = lambda c: F.col(f"__vf_plan.{c}")
    if keep_columns:
        source, key, tokens = docs.withColumn("__vf_at", F.struct(*(e.alias(c) for c, e in named.items()))).withColumn("__vf_digest", digest), F.col(id_col), words(F.col(text_col))
    else:
        source, key, tokens = rows.withColumn("__vf_at", F.struct(*levels)).withColumn("__vf_digest", F.col("digest")), F.col("doc_id"), F.col("n_tokens")
    met = source.join(told, F.col("__vf_at") == F.col("__vf_leaf")).withColumn("__vf_place", place(seed, plan_of("full_epochs") + 1, key, F.col("__vf_digest")))
    within = F.col("__vf_place") < plan_of("cut")
    # Rows at a leaf's edge are alike in id and text: one of them mostly, and never sorted with others.
    turn = F.row_number().over(Window.partitionBy("__vf_leaf", "__vf_place").orderBy(F.lit(0)))
    edge = met.where(F.col("__vf_place") == plan_of("cut")).withColumn("__vf_tokens", tokens)
    left = plan_of("rest") - plan_of("cut_before") - (turn - 1) * F.col("__vf_tokens")
    edge = edge.withColumn("__vf_taken", F.least("__vf_tokens", left)).withColumn("__vf_copies", plan_of("full_epochs") + F.when(left > 0, 1).otherwise(0))
    others = met.where(F.col("__vf_place") != plan_of("cut")).withColumn("__vf_copies", plan_of("full_epochs") + F.when(within, 1).otherwise(0))
    if keep_columns:
        columns = [F.col(f"`{c}`") for c in docs.columns]
        copies = lambda df, upto: df.where(f"{upto} > 0").withColumn("__vf_copy", F.explode(F.sequence(F.lit(1), F.col(upto).cast("int"))))
        cut = copies(edge, "__vf_copies")
        part = (F.col("__vf_copy") > plan_of("full_epochs")) & (F.col("__vf_taken") < F.col("__vf_tokens"))
        cut = cut.withColumn("__vf_text", F.when(part, first_words(F.col(text_col).cast("string"), F.col("__vf_taken"))).otherwise(F.col(text_col)))
        changed = {text_col: F.col("__vf_text").cast(docs.schema[text_col].dataType)}
        if chars_col in docs.columns:
            changed[chars_col] = F.when(part, F.length("__vf_text")).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType)
        cut = cut.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
        return copies(others, "__vf_copies").select(*columns).union(cut)
    taken = F.when(within, F.col("n_tokens")).otherwise(0)
    both = others.withColumn("__vf_taken", taken).unionByName(edge.withColumn("__vf_taken", F.greatest("__vf_taken", F.lit(0))), allowMissingColumns=True)
    return both.where("__vf_copies > 0").select("doc_id", *levels, "n_tokens", plan_of("full_epochs").alias("full_epochs"), F.col("__vf_taken").cast("long").alias("prefix_tokens"), F.col("__vf_copies").cast("long").alias("copies"))


#: The production tree: domains by number of source.
LEVELS = ("domain", "lang", "source")
WEIGHTS: dict[tuple[str, ...], int] = {
    ("web",): 5, ("books",): 3, ("reference",): 2,
    **{(d, lang): w for d in ("web", "books", "reference") for lang, w in (("en", 6), ("de", 2), ("fr", 2), ("es", 1))},
    ("web", "en", "src1"): 3, ("books", "en", "src10"): 2, ("reference", "de", "src15"): 4,
}
SEED, EPOCHS = 20, 4


def standard_levels() -> dict[str, Column]:
    number = F.expr("try_cast(substring(source, 4) as int)")
    domain = F.when(number < 8, "web").when(number < 14, "books").when(number < 20, "reference").otherwise("other")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mix_sql(share: float, docs: str = "documents") -> str:
    """DuckDB SQL for ``mix`` of the production tree."""
    told = ", ".join("(" + ", ".join(f"'{p}'" for p in (*path, *[""] * (3 - len(path)))) + f", {len(path)}, {w})" for path, w in WEIGHTS.items())

    def level(k: int) -> str:
        up, own = ["'x' AS root", *LEVELS[: k - 1]], LEVELS[k - 1]
        keys, parent = ", ".join(LEVELS[:k]), ", ".join(["root", *LEVELS[: k - 1]])
        given = "SELECT 'x' AS root, least(sum(capacity), (SELECT floor(sum(tokens) * {s})::BIGINT FROM leaves)) AS given FROM nodes".format(s=repr(float(share))) if k == 1 else f"SELECT {parent}, share AS given FROM l{k - 1}"
        same = " AND ".join(["a.root = b.root", *(f"a.{c} = b.{c}" for c in LEVELS[: k - 1])])
        return f"""g{k} AS ({given}),
        a{k} AS (SELECT {", ".join(up)}, {own}, sum(capacity)::HUGEINT AS capacity, any_value(w{k})::HUGEINT AS weight FROM nodes GROUP BY {keys}),
        b{k} AS (SELECT a.*, b.given::HUGEINT AS given FROM a{k} a JOIN g{k} b ON {same}),
        c{k} AS (SELECT *, sum(capacity) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - capacity AS filled,
                 sum(weight) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM b{k}
                 WINDOW p AS (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight, {own})),
        d{k} AS (SELECT *, capacity * rest <= weight * (given - filled) AS is_full FROM c{k}),
        e{k} AS (SELECT *, given - coalesce(sum(capacity) FILTER (is_full) OVER (PARTITION BY {parent}), 0) AS remaining,
                 sum(weight) FILTER (NOT is_full) OVER (PARTITION BY {parent}) AS open FROM d{k}),
        f{k} AS (SELECT *, CASE WHEN is_full THEN capacity ELSE (weight * remaining)::HUGEINT // open::HUGEINT END AS part,
                 CASE WHEN NOT is_full THEN (weight * remaining)::HUGEINT % open::HUGEINT END AS odd FROM e{k}),
        l{k} AS (SELECT *, part + CASE WHEN NOT is_full AND row_number() OVER (PARTITION BY {parent} ORDER BY odd DESC NULLS LAST, {own})
                 <= given - sum(part) OVER (PARTITION BY {parent}) THEN 1 ELSE 0 END AS share FROM f{k})"""

    return f"""
    WITH told(p1, p2, p3, depth, w) AS (VALUES {told}),
    docs AS (SELECT doc_id, coalesce(CASE WHEN n < 8 THEN 'web' WHEN n < 14 THEN 'books' WHEN n < 20 THEN 'reference' ELSE 'other' END, '{NONE}') AS domain,
             coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
             md5(coalesce(text, '')) AS digest, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens
             FROM (SELECT *, try_cast(substr(source, 4) AS INTEGER) AS n FROM {docs})),
    leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
    nodes AS (SELECT * FROM (SELECT v.*, (tokens * {EPOCHS})::HUGEINT AS capacity, coalesce(t1.w, 1) AS w1, coalesce(t2.w, 1) AS w2, coalesce(t3.w, 1) AS w3
              FROM leaves v LEFT JOIN told t1 ON t1.depth = 1 AND t1.p1 = domain LEFT JOIN told t2 ON t2.depth = 2 AND t2.p1 = domain AND t2.p2 = lang
              LEFT JOIN told t3 ON t3.depth = 3 AND t3.p1 = domain AND t3.p2 = lang AND t3.p3 = source) WHERE w1 > 0 AND w2 > 0 AND w3 > 0),
    {level(1)}, {level(2)}, {level(3)},
    leaf AS (SELECT domain, lang, source, tokens, CASE WHEN tokens > 0 THEN (share::HUGEINT // tokens)::BIGINT ELSE 0 END AS full_epochs,
             CASE WHEN tokens > 0 THEN (share::HUGEINT % tokens)::BIGINT ELSE 0 END AS rest FROM l3 JOIN leaves USING (domain, lang, source)),
    placed AS (SELECT *, ('0x' || substr(md5('{SEED}:' || (full_epochs + 1) || ':' || coalesce(doc_id::VARCHAR, '') || ':' || digest), 1, 15))::BIGINT AS place
               FROM docs JOIN leaf USING (domain, lang, source)),
    turns AS (SELECT *, row_number() OVER (PARTITION BY domain, lang, source, place) AS turn FROM placed),
    started AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, turn ROWS UNBOUNDED PRECEDING) - n_tokens AS start FROM turns),
    taken AS (SELECT *, full_epochs + CASE WHEN start < rest THEN 1 ELSE 0 END AS copies FROM started)
    SELECT doc_id, domain, lang, source, n_tokens, full_epochs, CASE WHEN start < rest THEN least(n_tokens, rest - start) ELSE 0 END::BIGINT AS prefix_tokens, copies::BIGINT AS copies
    FROM taken WHERE copies > 0"""
