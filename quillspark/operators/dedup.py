"""Duplicate groups, clusters, components, conflicts and folds.

Rows with a null id are the caller's to drop; null texts form one group of their own; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import near_dup_key, stable_rank
from quillspark.operators import ordering
from quillspark.operators.spans import realigned
from quillspark.sources.staging import stage


def exact_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, group_size, first_key, train_weight): groups of equal texts, met by digest, named by their first key."""
    rows = df.select(key, F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("")), 256).alias("digest"))
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(key).alias("first_key"))
    return rows.join(sizes, "digest").select(key, "group_size", "first_key", (1.0 / F.col("group_size")).alias("train_weight"))


def identical_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, first_key, place, size): the members of groups of two and more equal texts, numbered from 0 in order of their keys.

    A row per member: a group may hold a third of all rows, so it is never brought into one row or window.
    """
    g = exact_groups(df, key, text).where("group_size > 1")
    d = ordering.positioned(g, "first_key", [key], "place", "size")
    return d.select(key, "first_key", (F.col("place") - 1).alias("place"), "size")


def second_side(df: DataFrame, key: str, text: str, start: DataFrame) -> DataFrame:
    """Duplicate columns of a second side (a leaderboard): (key, dup_group_id, is_representative, cv_component, fold).

    Group ids go on behind those of the first side, ``start``: one row with its greatest id; the first key of an exact group
    stands for it; components and folds are -1, as these rows are in none.
    """
    e = exact_groups(df, key, text)
    groups = ordering.numbered(e.select("first_key").distinct(), ["first_key"], "_n")
    top = start.select(F.coalesce(F.col(start.columns[0]), F.lit(-1)).alias("_top"))
    j = e.join(groups, "first_key").crossJoin(F.broadcast(top))  # one row
    return j.select(key, (F.col("_n") + F.col("_top") + 1).alias("dup_group_id"), (F.col(key) == F.col("first_key")).alias("is_representative"), F.lit(-1).alias("cv_component"), F.lit(-1).alias("fold"))


def clusters(df: DataFrame, key: str, text: str, merges: DataFrame | None = None) -> DataFrame:
    """``df`` with cluster: the least key among rows of the same near-duplicate key.

    ``merges``: (merge_set, key) pinned sets of keys that belong together whatever their texts; clusters that share a set are
    one.  Keys that are not in ``df`` are left out.
    """
    d = df.withColumn("_k", F.sha2(F.coalesce(near_dup_key(F.col(text)), F.concat(F.lit("null"), F.col(key))), 256))
    first = d.groupBy("_k").agg(F.min(key).alias("cluster"))
    d = d.join(first, "_k").drop("_k")
    if merges is None:
        return d
    tied = merges.join(d.select(key, "cluster"), key).select(F.concat(F.lit("s:"), "merge_set").alias("a"), F.concat(F.lit("c:"), "cluster").alias("b"))
    roots = connected(tied).where(F.startswith("node", F.lit("c:"))).withColumn("_root", F.col("component"))
    # A component is named by the least cluster in it: cluster names sort before names of sets.
    return d.withColumn("node", F.concat(F.lit("c:"), "cluster")).join(roots.select("node", "_root"), "node", "left").withColumn("cluster", F.coalesce(F.substring("_root", 3, 1 << 20), "cluster")).drop("node", "_root")


def resolve_conflicts(df: DataFrame, key: str, cluster: str, label_ord: str) -> DataFrame:
    """(cluster, size, label_ord, representative, is_label_conflict).

    Majority label, a tie goes to the higher one; the representative is the least key with it, or the least key at all
    where no row has a label.
    """
    per = df.groupBy(cluster, label_ord).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    known = F.col(label_ord).isNotNull()
    best = F.max(F.when(known, F.struct("n", label_ord, "first")))
    return per.groupBy(cluster).agg(F.sum("n").alias("size"), best.alias("b"), F.min("first").alias("any"), F.count(F.when(known, 1)).alias("labels")).select(
        cluster, "size", F.col(f"b.{label_ord}").alias("label_ord"), F.coalesce("b.first", "any").alias("representative"), (F.col("labels") > 1).alias("is_label_conflict")
    )


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): least node that is reachable over edges (a, b).

    Large- and small-star rounds over the edges go on until no edge changes: their number is logarithmic, and no round holds
    a component in one task.
    """
    e = stage(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        step = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        e = stage(large.join(down, "a").select(step.alias("e")).select("e.*").where("a <> b").distinct(), "edges")
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
        before = mark


def author_components(df: DataFrame, key: str, author: str, cluster: str) -> DataFrame:
    """(key, component): rows of one author or one cluster hang together; named by the least node of the component.

    A cluster of rows without an author is a component of its own.
    """
    ties = df.select(F.concat(F.lit("u:"), author).alias("a"), F.concat(F.lit("c:"), cluster).alias("b")).distinct()
    named = connected(ties)
    return df.select(key, F.concat(F.lit("c:"), cluster).alias("node")).join(named, "node", "left").select(key, F.coalesce("component", "node").alias("component"))


def dense_ids(df: DataFrame, key: str, group: str) -> DataFrame:
    """``df`` with dense_id: groups numbered from 0 by the least key they hold."""
    first = df.groupBy(group).agg(F.min(key).alias("_first"))
    ids = ordering.numbered(first, ["_first"], "dense_id").select(F.col(group).alias("_g"), "dense_id")
    return df.join(ids, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def stratified_group_folds(profiles: list[tuple[tuple[int, ...], int]], k: int = 5, least: int = 0, rare: int = -1) -> list[tuple[tuple[int, ...], int, int]]:
    """(profile, fold, number): how many components of each class profile go to each fold.

    ``profiles``: (class counts of a component, number of such components).  Components are placed by falling spread of their
    counts, each in the fold that keeps the shares of the classes most even; ties to the fold with fewer rows, then the
    smaller number.  Components of one profile are interchangeable, so only profiles are held here.  With ``least``, raises
    where a fold has fewer rows of the class ``rare``.
    """
    def spread(xs: list[float]) -> float:
        m = sum(xs) / len(xs)
        return (sum((x - m) ** 2 for x in xs) / len(xs)) ** 0.5

    width = len(profiles[0][0]) if profiles else 0
    totals = [max(1, sum(c[j] * n for c, n in profiles)) for j in range(width)]
    held = [[0] * width for _ in range(k)]
    out: dict[tuple[tuple[int, ...], int], int] = {}
    for c, n in sorted(profiles, key=lambda x: (-spread(list(x[0])), x[0])):
        # Whole rounds of k equal components change no balance between the folds.
        for f in range(k):
            held[f] = [x + y * (n // k) for x, y in zip(held[f], c, strict=True)]
            if n // k:
                out[c, f] = n // k
        for _ in range(n % k):
            def cost(f: int, c: tuple[int, ...] = c) -> float:
                return sum(spread([(held[g][j] + (c[j] if g == f else 0)) / totals[j] for g in range(k)]) for j in range(width))

            best = min(range(k), key=lambda f: (round(cost(f), 12), sum(held[f]), f))
            held[best] = [x + y for x, y in zip(held[best], c, strict=True)]
            out[c, best] = out.get((c, best), 0) + 1
    if least and profiles and min(h[rare] for h in held) < least:
        raise ValueError(f"a fold has fewer than {least} rows of the rarest class: {[h[rare] for h in held]}")
    return [(c, f, n) for (c, f), n in out.items()]


def component_folds(df: DataFrame, component: str, label_ord: str, classes: int = 4, k: int = 5, least: int = 0) -> DataFrame:
    """(component, fold) by :func:`stratified_group_folds` over the class counts of each component.

    Only the distinct class profiles come to the driver, not the components; which components of a profile go to which fold
    follows from their number within it, in stable order.
    """
    names = [f"n{i}" for i in range(classes)]
    c = stage(df.groupBy(component).agg(*[F.count(F.when(F.col(label_ord) == i, 1)).alias(f"n{i}") for i in range(classes)]), "profiles")
    plan = stratified_group_folds([(tuple(r[:-1]), r[-1]) for r in c.groupBy(*names).agg(F.count("*").alias("n")).toLocalIterator()], k, least)
    rows, at = [], {}
    for profile, fold, n in plan:
        low = at.get(profile, 0)
        rows.append((*profile, fold, low, low + n))
        at[profile] = low + n
    spark = df.sparkSession
    ranges = spark.createDataFrame(rows, ", ".join(f"{x} long" for x in names) + ", fold int, low long, high long")
    code = F.concat_ws(",", *names)
    placed = ordering.positioned(c.withColumn("_profile", code).withColumn("_rank", stable_rank(F.lit("fold"), F.col(component))), "_profile", ["_rank", component], "_k", "_n")
    return placed.join(ranges.withColumn("_profile", code).select("_profile", "fold", "low", "high"), "_profile").where("_k - 1 >= low and _k - 1 < high").select(component, "fold")


def propagate(preds: DataFrame, members: DataFrame, key: str, cluster: str) -> DataFrame:
    """``members`` (key, cluster) with pred and source: own prediction, else that of the cluster's least predicted key, else none."""
    own = members.join(preds.select(key, F.col("pred").alias("_own")), key, "left")
    rep = own.where("_own is not null").groupBy(cluster).agg(F.min(F.struct(key, "_own")).alias("_rep"))
    j = own.join(rep, cluster, "left")
    source = F.when(F.col("_own").isNotNull(), "own").when(F.col("_rep").isNotNull(), "representative").otherwise("default")
    return j.select(key, cluster, F.coalesce("_own", "_rep._own").alias("pred"), source.alias("source"))


def propagate_spans(preds: DataFrame, members: DataFrame, key: str, cluster: str, text: str) -> DataFrame:
    """(key, spans, source): as :func:`propagate` for span lists; a representative's spans are aligned anew on the duplicate's
    own text, and those that are not in it are dropped."""
    d = propagate(preds.select(key, F.col("spans").alias("pred")), members, key, cluster).join(members.select(key, text), key)
    copied = F.col("source") == "representative"
    moved = d.where(copied).withColumn("spans", realigned(F.col("pred"), F.col(text)))
    return d.where(~copied).withColumn("spans", F.coalesce("pred", F.array().cast("array<string>"))).unionByName(moved).select(key, "spans", "source")
