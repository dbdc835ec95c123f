"""Entity resolution: exact, normalized, fuzzy, new entity - with the result of a sequential pass.

The sequential rule looks order-bound: a name that matches nothing becomes an entity
that later names can match.  Only such *leaders* extend the index, so the leaders are
the lexicographically first maximal independent set of the "similar enough" graph over
names that no seed matches.  That set is computed in few rounds (Blelloch, Fineman and
Shun, SPAA 2012), on growing slices of the arrival order, so a mass of near copies is
absorbed by its leader before its own pairs would ever be formed.

Work is done on distinct keys.  Occurrences are touched twice: to find the distinct
names (partial aggregation) and to look their resolution up (one equi-join).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import exact_key, normalized_key, token_sorted
from ..functions.patterns import is_blank, strip
from ..session import Workspace
from .components import components
from .similarity import CHECKS_PER_TASK, CellGuard, Shortened, expected_pairs, frequent_grams, hot_cells, signature, similar_pairs

DEFAULT_THRESHOLD = 90.0
EXACT, NORMALIZED, FUZZY, NEW_ENTITY, SKIPPED = "exact", "normalized", "fuzzy", "new_entity", "skipped_empty"
NORMALIZED_CONFIDENCE = 0.97


@dataclass(frozen=True)
class ElectionLimits:
    """Sizes that steer the slices of the leader election; they never change its result.

    The first slice is small: its leaders absorb the bulk of near copies.  What is left
    has few similar pairs per slice even when slices grow fourfold, so there are
    logarithmically many of them.  The guards cover input that arrives sorted by likeness.
    """

    first_slice: int = 5_000
    growth: int = 4
    smallest_slice: int = 1_000
    first_pairs_per_key: int = 2_000
    pairs_per_core: int = 2_000_000
    parallel_rounds: int = 4
    edges_per_task: int = 500_000
    checks_per_task: int = CHECKS_PER_TASK


def seed_index(seeds: DataFrame) -> DataFrame:
    """Index rows of a seed table ``(position, canonical, alias)``.

    ``position`` is the order of insertion; every canonical name is its own first alias.
    """
    return seeds.select(
        F.col("position").cast("bigint").alias("position"),
        "canonical",
        exact_key(F.col("alias")).alias("exact_key"),
        normalized_key(F.col("alias")).alias("norm_key"),
    )


def exact_index(seeds: DataFrame) -> DataFrame:
    """Canonical name per exact key; the last writer wins."""
    return seed_index(seeds).groupBy("exact_key").agg(F.max_by("canonical", "position").alias("seed_exact"))


def normalized_index(seeds: DataFrame) -> DataFrame:
    """Canonical name per normalized key (last writer) and the key's place (first writer)."""
    return (
        seed_index(seeds)
        .groupBy("norm_key")
        .agg(F.max_by("canonical", "position").alias("seed_norm"), F.min("position").alias("position"))
    )


def _distinct_names(occurrences: DataFrame) -> DataFrame:
    names = (
        occurrences.filter(F.col("_key").isNotNull())
        .groupBy(F.col("_key").alias("exact_key"))
        .agg(
            F.min("_ord").alias("first_ord"),
            F.max("_ord").alias("last_ord"),
            F.min_by("_name", "_ord").alias("first_name"),
        )
        .withColumn("norm_key", normalized_key(F.col("exact_key")))
    )
    return names.withColumn("ts", token_sorted(F.col("norm_key")))


def _seed_keys(norm_index: DataFrame) -> DataFrame:
    """Seeds by token-sorted key; of keys that sort alike the earliest one counts."""
    return (
        norm_index.withColumn("ts", token_sorted(F.col("norm_key")))
        .groupBy("ts")
        .agg(F.min("position").alias("ord"), F.min_by("seed_norm", "position").alias("canonical"))
    )


def _finish_component(edges: pd.DataFrame) -> pd.DataFrame:
    """The sequential rule on few edges: a key loses if an earlier neighbour did not."""
    lost: set[int] = set()
    for later, earlier in edges.sort_values("b").groupby("b", sort=True)["a"]:
        if any(a not in lost for a in earlier):
            lost.add(int(later))
    return pd.DataFrame({"b": sorted(lost)}, dtype="int64")


def _independent_set_losers(edges: DataFrame, work: Workspace, limits: ElectionLimits) -> DataFrame | None:
    """Ordinals ``b`` of keys similar to an earlier leader, given edges earlier ``a`` - later ``b``.

    A few rounds settle all but long chains, which names that arrive sorted can form.  What is left then falls
    apart into connected components, and these are settled side by side, each in order.  Of a component with more
    than edges_per_task edges only the earliest of about that many are settled at a time: they depend on no later one.
    """
    losers: list[DataFrame] = []
    done = 0
    while not edges.isEmpty():
        if done < limits.parallel_rounds:
            later = edges.select(F.col("b").alias("a")).distinct()
            roots = edges.select("a").distinct().join(later, "a", "left_anti")
            lost = work.materialize(edges.join(roots, "a", "left_semi").select("b").distinct(), "lost")
            losers.append(lost)
            edges = work.materialize(_still_open(edges, lost), "edges")
            done += 1
            continue
        owned = work.materialize(edges.join(components(edges, work).withColumnRenamed("node", "a"), "a"), "owned-edges")
        sizes = owned.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        large = work.materialize(sizes.filter(F.col("n") > limits.edges_per_task), "large-components")
        if large.isEmpty():
            losers.append(work.materialize(owned.groupBy("component").applyInPandas(_finish_component, "b bigint"), "lost"))
            break
        cuts = work.materialize(_cuts(owned, large, limits), "cuts")
        cut = owned.join(cuts, "component", "left").withColumn("settled", F.coalesce(F.col("b") <= F.col("cut"), F.lit(True)))
        cut = work.materialize(cut, "cut-edges")
        head = cut.filter("settled").select("a", "b", "component")
        lost = work.materialize(head.groupBy("component").applyInPandas(_finish_component, "b bigint"), "lost")
        # Of the others, those next to a key that is settled and did not lose are lost as well.
        rest = cut.filter("NOT settled").join(lost.select(F.col("b").alias("a")), "a", "left_anti")
        more = work.materialize(rest.filter("a <= cut").select("b").distinct(), "lost")
        losers += [lost, more]
        edges = work.materialize(_still_open(rest.select("a", "b"), more), "edges")
    return reduce(DataFrame.unionByName, losers) if losers else None


def _still_open(edges: DataFrame, lost: DataFrame) -> DataFrame:
    return edges.join(lost, "b", "left_anti").join(lost.select(F.col("b").alias("a")), "a", "left_anti")


def _cuts(owned: DataFrame, large: DataFrame, limits: ElectionLimits) -> DataFrame:
    """The ordinal up to which about edges_per_task edges of each large component are."""
    counts = owned.join(large.select("component", "n"), "component")
    # The share of a component differs from others', so it is found among a thousand quantiles.
    quantiles = [i / 1000 for i in range(1, 1001)]
    found = counts.groupBy("component").agg(F.percentile_approx("b", quantiles, F.lit(10_000)).alias("at"), F.first("n").alias("n"))
    place = F.greatest(F.lit(1), F.floor(F.lit(1000 * limits.edges_per_task) / F.col("n"))).cast("int")
    return found.select("component", F.element_at("at", place).alias("cut"))


def _slice_end(
    remaining: DataFrame, rows: int, wanted: int, budget: float, limits: ElectionLimits, plan: Shortened | None
) -> int | None:
    """Last ordinal of the next slice, None for all that remains."""
    while True:
        end = None
        if wanted < rows:
            end = remaining.select(F.percentile_approx("ord", F.lit(wanted / rows), F.lit(10_000))).first()[0]
        taken = remaining if end is None else remaining.filter(F.col("ord") <= end)
        size = min(wanted, rows)
        if size <= limits.smallest_slice:
            return end
        pairs = expected_pairs(taken, plan)
        if pairs <= budget:
            return end
        wanted = max(limits.smallest_slice, int(size * min((budget / pairs) ** 0.5, 0.5)))


def elect_leaders(
    candidates: DataFrame, threshold: float, work: Workspace, limits: ElectionLimits, cells: CellGuard
) -> DataFrame:
    """Keys ``(ts, ord, sig, ...)`` that a sequential pass would register as new entities."""
    remaining, wanted, leaders = candidates, limits.first_slice, []
    cores = work.spark.sparkContext.defaultParallelism
    budget = float(limits.first_pairs_per_key * limits.first_slice)
    plan = (cells.plans(candidates, candidates) or (None,))[0]
    while True:
        rows = remaining.count()
        if rows == 0:
            break
        end = _slice_end(remaining, rows, wanted, budget, limits, plan)
        taken = remaining if end is None else remaining.filter(F.col("ord") <= end)
        pairs = similar_pairs(taken, taken.select("ts", "ord", "sig"), threshold, ordered=True, **cells.between(taken, taken))
        edges = work.materialize(pairs.select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b")), "edges")
        losers = _independent_set_losers(edges, work, limits)
        if losers is not None:
            taken = taken.join(losers.select(F.col("b").alias("ord")), "ord", "left_anti").select(*candidates.columns)
        chosen = work.materialize(taken, "leaders")
        leaders.append(chosen)
        if end is None:
            break
        rest = remaining.filter(F.col("ord") > end)
        absorbed = similar_pairs(rest, chosen.select("ts", "ord", "sig"), threshold, **cells.between(rest, chosen)).select(F.col("a").alias("ts")).distinct()
        remaining = work.materialize(rest.join(absorbed, "ts", "left_anti"), "remaining")
        wanted *= limits.growth
        budget = float(limits.pairs_per_core * cores)
    return reduce(DataFrame.unionByName, leaders) if leaders else candidates.limit(0)


def _earliest(matches: DataFrame) -> DataFrame:
    """Of a key's matches with one score and tier the entry with the first place."""
    return matches.groupBy("ts", "score", "tier").agg(
        F.min("place").alias("place"), F.min_by("canonical", "place").alias("canonical")
    )


def _rivals(seed_matches: DataFrame, leader_matches: DataFrame) -> DataFrame:
    """Fuzzy matches of a key as one short array.

    Of equal scores only the earliest index entry can win.  Scores of one key are
    fractions of few length sums, so their number, and the array, is bounded by the
    square of the key length, however many matches there are.
    """
    entry = F.struct("tier", "place")
    return (
        seed_matches.unionByName(leader_matches)
        .groupBy("ts", "score")
        .agg(F.min(entry).alias("entry"), F.min_by("canonical", entry).alias("canonical"))
        .groupBy("ts")
        .agg(F.collect_list(F.struct("score", "entry", "canonical")).alias("rivals"))
    )


def _best_rival(rivals: Column, ordinal: Column) -> Column:
    """Best match among seeds (tier 0) and leaders registered before ``ordinal``."""
    known = F.filter(rivals, lambda r: (r["entry"]["tier"] == 0) | (r["entry"]["place"] < ordinal))
    ranked = F.transform(
        known,
        lambda r: F.struct(
            r["score"].alias("score"), (-r["entry"]["tier"]).alias("tier"),
            (-r["entry"]["place"]).alias("place"), r["canonical"].alias("canonical"),
        ),
    )
    return F.array_max(ranked)


def resolve(
    df: DataFrame,
    name_col: str,
    order_col: str,
    seeds: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    limits: ElectionLimits = ElectionLimits(),
) -> DataFrame:
    """Add ``canonical_name``, ``method`` and ``confidence`` to every row.

    ``order_col`` is a unique, non-negative integral arrival order.  ``seeds`` holds
    ``(position, canonical, alias)``, see ``sources.seeds``.
    """
    work = Workspace(df.sparkSession)
    name = F.col(name_col)
    occurrences = df.select(
        F.col(order_col).cast("bigint").alias("_ord"),
        strip(name).alias("_name"),
        F.when(~is_blank(name), exact_key(name)).alias("_key"),
    )
    norm_index = work.materialize(normalized_index(seeds), "seed-norm")
    names = work.materialize(
        _distinct_names(occurrences)
        .join(exact_index(seeds), "exact_key", "left")
        .join(norm_index.select("norm_key", "seed_norm"), "norm_key", "left"),
        "names",
    )

    # Distinct sorted keys that no seed equals; similarity depends on these alone.
    open_names = names.filter(F.col("seed_norm").isNull())
    keys = open_names.groupBy("ts").agg(
        F.min("first_ord").alias("ord"),
        F.max("last_ord").alias("last_ord"),
        F.min_by(F.struct("norm_key", "exact_key", F.col("first_name").alias("canonical")), "first_ord").alias("head"),
    )
    seed_keys = _seed_keys(norm_index)
    frequent = frequent_grams(keys.select("ts").unionByName(seed_keys.select("ts")), "ts", threshold)
    sign = signature(F.col("ts"), threshold, frequent)
    keys = work.materialize(keys.withColumn("sig", sign), "keys")
    seed_keys = work.materialize(seed_keys.withColumn("sig", sign), "seed-keys")

    seed_places = seed_keys.select("ts", F.col("ord").alias("place"), "canonical")
    equal = keys.select("ts").join(seed_places, "ts").withColumn("score", F.lit(100.0))
    signed = keys.select("ts", "ord", "sig").unionByName(seed_keys.select("ts", "ord", "sig"))
    cells = CellGuard(signed, threshold, work, limits.checks_per_task)
    similar = similar_pairs(keys, seed_keys, threshold, **cells.between(keys, seed_keys))
    similar = similar.select(F.col("a").alias("ts"), F.col("b_ord").alias("place"), F.col("b_canonical").alias("canonical"), "score")
    # One row per key and score: near copies among the seeds do not multiply.
    seed_matches = work.materialize(_earliest(equal.unionByName(similar).withColumn("tier", F.lit(0))), "seed-matches")

    candidates = work.materialize(keys.join(seed_matches.select("ts").distinct(), "ts", "left_anti"), "candidates")
    leaders = work.materialize(elect_leaders(candidates, threshold, work, limits, cells), "all-leaders")

    followers = keys.join(leaders.select("ts"), "ts", "left_anti")
    heads = leaders.select("ts", "ord", "sig", "head.canonical")
    leader_matches = similar_pairs(followers, heads, threshold, **cells.between(followers, heads)).select(
        F.col("a").alias("ts"), "score", F.lit(1).alias("tier"), F.col("b_ord").alias("place"), F.col("b_canonical").alias("canonical")
    )
    rivals = _rivals(seed_matches, leader_matches)

    resolved = names.join(rivals, "ts", "left").join(
        leaders.select(
            "ts", F.col("ord").alias("leader_ord"), F.col("head.norm_key").alias("leader_norm"),
            F.col("head.exact_key").alias("leader_exact"), F.col("head.canonical").alias("leader_name"),
        ),
        "ts", "left",
    )
    resolved = work.materialize(resolved.drop("first_ord", "last_ord", "first_name", "ts"), "resolved")
    return _look_up(df, name, F.col(order_col).cast("bigint"), resolved)


def _look_up(df: DataFrame, name: Column, ordinal: Column, resolved: DataFrame) -> DataFrame:
    blank = is_blank(name)
    # Blank names get keys of their own, so that they do not pile up in one task.
    key = F.when(blank, F.concat(F.lit("\u0000"), ordinal)).otherwise(exact_key(name))
    joined = df.withColumn("_key", key).join(resolved, F.col("_key") == resolved["exact_key"], "left")

    is_leader = F.col("leader_norm") == F.col("norm_key")
    own_first = F.col("leader_ord") == ordinal
    rival = _best_rival(F.col("rivals"), ordinal)
    # A key that sorts like a leader's but is written differently scores 100 against it.
    sorts_alike = F.col("leader_name").isNotNull()

    def pick(canonical: Column, method: str, confidence: Column) -> Column:
        return F.struct(canonical.alias("canonical_name"), F.lit(method).alias("method"), confidence.alias("confidence"))

    one = F.lit(1.0)
    outcome = (
        F.when(blank, pick(name, SKIPPED, F.lit(0.0)))
        .when(F.col("seed_exact").isNotNull(), pick(F.col("seed_exact"), EXACT, one))
        .when(F.col("seed_norm").isNotNull(), pick(F.col("seed_norm"), NORMALIZED, F.lit(NORMALIZED_CONFIDENCE)))
        .when(is_leader & own_first, pick(F.col("leader_name"), NEW_ENTITY, one))
        .when(is_leader & (F.col("leader_exact") == F.col("exact_key")), pick(F.col("leader_name"), EXACT, one))
        .when(is_leader, pick(F.col("leader_name"), NORMALIZED, F.lit(NORMALIZED_CONFIDENCE)))
        .when(sorts_alike, pick(F.col("leader_name"), FUZZY, one))
        .otherwise(pick(rival["canonical"], FUZZY, rival["score"] / 100.0))
    )
    return joined.withColumn("_outcome", outcome).select(*[F.col(f"`{c}`") for c in df.columns], "_outcome.*")


def mapping_log(resolved: DataFrame, name_col: str) -> DataFrame:
    """The audit log: confidence rounded half-even to three places."""
    return resolved.select(
        F.col(name_col).alias("raw_name"), "canonical_name", "method", F.bround("confidence", 3).alias("confidence")
    )


def log_by_method(log: DataFrame) -> DataFrame:
    return log.groupBy("method").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))


def match_exact(df: DataFrame, name_col: str, seeds: DataFrame) -> DataFrame:
    """First tier alone: ``seed_exact``, null on a miss."""
    keyed = df.withColumn("_key", exact_key(F.col(name_col)))
    index = exact_index(seeds).withColumnRenamed("exact_key", "_key")
    return keyed.join(index, "_key", "left").drop("_key")


def match_normalized(df: DataFrame, name_col: str, seeds: DataFrame) -> DataFrame:
    """Second tier alone: ``seed_norm``, null on a miss."""
    keyed = df.withColumn("_key", normalized_key(F.col(name_col)))
    index = normalized_index(seeds).select(F.col("norm_key").alias("_key"), "seed_norm")
    return keyed.join(index, "_key", "left").drop("_key")


def match_fuzzy(names: DataFrame, name_col: str, seeds: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Third tier alone: ``(norm_key, canonical, score)`` of the best seed per distinct normalized key.

    Equal scores go to the earlier seed; keys without a seed in reach have no row.
    """
    keys = names.select(normalized_key(F.col(name_col)).alias("norm_key")).filter("norm_key IS NOT NULL").distinct()
    keys = keys.withColumn("ts", token_sorted(F.col("norm_key")))
    left = keys.select("ts").distinct()
    right = _seed_keys(normalized_index(seeds))
    frequent = frequent_grams(left.unionByName(right.select("ts")), "ts", threshold)
    sign = signature(F.col("ts"), threshold, frequent)
    work = Workspace(names.sparkSession)
    left = work.materialize(left.withColumn("ord", F.lit(0).cast("bigint")).withColumn("sig", sign), "keys")
    right = work.materialize(right.withColumn("sig", sign), "seed-keys")
    hot = hot_cells(left, right, threshold, work)
    similar = similar_pairs(left, right, threshold, hot=hot)
    similar = similar.select(F.col("a").alias("ts"), F.col("b_ord").alias("ord"), F.col("b_canonical").alias("canonical"), "score")
    equal = left.select("ts").join(right.select("ts", "ord", "canonical"), "ts").withColumn("score", F.lit(100.0))
    best = F.struct(-F.col("score"), F.col("ord"))
    top = (
        similar.unionByName(equal)
        .groupBy("ts")
        .agg(F.min_by("canonical", best).alias("canonical"), F.max("score").alias("score"))
    )
    return keys.join(top, "ts").select("norm_key", "canonical", "score")
