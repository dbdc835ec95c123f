"""Token-sort similarity and the exact similarity join behind fuzzy matching.

``score(a, b) = 100 * (1 - d / (len(a) + len(b)))`` where ``d`` counts insertions and
deletions only and both keys are token-sorted.  Pairs reaching a threshold are found
without comparing everything with everything: a pair of that score must share a
q-gram among the rarest few of either side, at nearly the same position (the prefix
filter of set-similarity joins).  So the join is an equi-join on single q-grams, and
the filters below lose no pair.

Where very many keys share their rare q-grams too (names that differ in a number only), short keys meet by what is
left of them without a few characters instead (`Shortened`); that loses no pair either.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..session import Workspace

# The order of q-grams is "known frequent ones last".  Any order is correct, so the
# list of frequent ones can be cut at a fixed size and shipped with the task.
FREQUENT_GRAMS = 4096
# Characters of a key whose grams share a join cell.
POSITION_BUCKET = 16
# Candidate checks that one task may do for one gram: some seconds of work.
CHECKS_PER_TASK = 4_000_000
# Shortened forms that a key may have for one number of left-out characters.
MOST_FORMS = 256
GRAM = T.StructType([T.StructField("gram", T.StringType()), T.StructField("pos", T.IntegerType())])
SIGNATURE = T.StructType([T.StructField("bag", T.LongType()), T.StructField("grams", T.ArrayType(GRAM))])
_BAG_BITS = 63


def allowed_edits(total: int, threshold: float) -> int:
    """Most insertions and deletions at which two keys of summed length ``total`` still pass."""
    return int((100.0 - threshold) / 100.0 * total + 1e-9)


@lru_cache(maxsize=None)
def _lost_grams(length: int, threshold: float, q: int) -> int | None:
    """Most q-grams of a key of ``length`` that a passing partner may lack.

    Deleting a character breaks at most ``q`` grams, inserting one at most ``q - 1``.
    None means that no unequal partner can pass.
    """
    rate = (100.0 - threshold) / 100.0
    if rate >= 1.0:
        raise ValueError("the threshold must be above 0")
    lowest, highest = int(length * (1 - rate) / (1 + rate)), int(length * (1 + rate) / (1 - rate)) + 1
    worst = None
    for partner in range(max(1, lowest), highest + 1):
        edits = allowed_edits(length + partner, threshold)
        edits -= (edits - length - partner) % 2
        if edits < abs(length - partner) or edits == 0:
            continue
        deleted, inserted = (edits + length - partner) // 2, (edits - length + partner) // 2
        lost = q * deleted + (q - 1) * inserted
        worst = lost if worst is None else max(worst, lost)
    return worst


@lru_cache(maxsize=None)
def gram_size(threshold: float) -> int:
    """Longest q for which every passing pair of any length still shares a gram."""
    for q in (3, 2):
        lengths = ((n, _lost_grams(n, threshold, q)) for n in range(1, 257))
        if all(lost is None or n - q + 1 > lost for n, lost in lengths):
            return q
    return 1


def _grams(text: str, q: int) -> list[str]:
    return [text[i : i + q] for i in range(len(text) - q + 1)]


def frequent_grams(keys: DataFrame, key: str, threshold: float) -> list[str]:
    """The most frequent q-grams, rarest first; a bounded list for the driver."""
    q = gram_size(threshold)
    starts = F.expr(f"sequence(1, length({key}) - {q - 1})")
    grams = keys.filter(F.length(key) >= q).select(
        F.explode(F.transform(starts, lambda i: F.substring(F.col(key), i, F.lit(q)))).alias("gram")
    )
    rows = grams.groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(FREQUENT_GRAMS).collect()
    return [row["gram"] for row in reversed(rows)]


def _bag(text: str) -> int:
    """Bit set of the counted characters: one insertion or deletion flips at most one bit."""
    counts: dict[str, int] = {}
    bits = 0
    for char in text:
        counts[char] = counts.get(char, 0) + 1
        bits |= 1 << ((ord(char) * 31 + counts[char] * 17) % _BAG_BITS)
    return bits


def signature(key: Column, threshold: float, frequent: list[str]) -> Column:
    """The rarest q-grams of a key with their positions: enough to meet any passing partner."""
    q = gram_size(threshold)
    rank = {gram: place for place, gram in enumerate(frequent, start=1)}

    @F.pandas_udf(SIGNATURE)
    def rarest(keys: pd.Series) -> pd.DataFrame:
        bags, chosen = [], []
        for text in keys:
            lost = _lost_grams(len(text), threshold, q)
            ordered = []
            if lost is not None:
                ordered = sorted((rank.get(g, 0), g, i) for i, g in enumerate(_grams(text, q)))[: lost + 1]
            bags.append(_bag(text))
            chosen.append([{"gram": g, "pos": i} for _, g, i in ordered])
        return pd.DataFrame({"bag": bags, "grams": chosen})

    return rarest(key)


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word step per character."""
    rows: dict[str, int] = {}
    for i, char in enumerate(a):
        rows[char] = rows.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for char in b:
        hit = free & rows.get(char, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def _scores(a: pd.Series, b: pd.Series) -> pd.Series:
    def score(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        total = len(x) + len(y)
        if total == 0:
            return 100.0
        return (1.0 - (total - 2 * _common_subsequence(x, y)) / total) * 100.0

    return pd.Series([score(x, y) for x, y in zip(a, b)], dtype="float64")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity (0 to 100) of two token-sorted keys."""
    return F.pandas_udf(_scores, T.DoubleType())(a, b)


def _spans(threshold: float) -> tuple[float, int]:
    """Width factor of length bands, and characters that a position bucket holds."""
    rate = (100.0 - threshold) / 100.0
    return (1 + rate) / (1 - rate) * (1 + 1e-6), POSITION_BUCKET


@dataclass(frozen=True)
class Shortened:
    """How keys of one side meet by shortened forms, for each key length.

    ``left_out`` has the numbers of characters to leave out, ``alone`` the lengths that need no grams.
    """

    left_out: dict[int, tuple[int, ...]]
    alone: frozenset[int]


def shortened(left: dict[int, int], right: dict[int, int], threshold: float, limit: int) -> tuple[Shortened, Shortened] | None:
    """Plans of both sides from the number of keys of each length; None where it doesn't pay.

    Keys of lengths m and n pass if they have a common subsequence of (m + n - edits) / 2 characters or more, that is
    if they agree once each has lost the rest.  A key has one form for each way to lose characters, so the work
    is linear in the keys, whatever they share.  It pays where keys of two lengths make more than ``limit`` pairs.
    """
    ways: dict[tuple[int, int], tuple[int, int]] = {}
    for m in left:
        for n in right:
            edits = allowed_edits(m + n, threshold)
            if (lost := (edits + m - n) // 2) >= 0 and (other := (edits + n - m) // 2) >= 0 and (lost or other):
                ways[m, n] = (lost, other)
    can = {p for p, (lost, other) in ways.items() if math.comb(p[0], lost) <= MOST_FORMS and math.comb(p[1], other) <= MOST_FORMS}
    if not any(left[m] * right[n] > limit for m, n in can):
        return None
    alone = [frozenset(x for x in side if all(p in can for p in ways if p[k] == x)) for k, side in enumerate((left, right))]
    used = [p for p in can if p[0] in alone[0] or p[1] in alone[1]]
    return tuple(
        Shortened({x: tuple(sorted({ways[p][k] for p in used if p[k] == x})) for x in side}, alone[k])
        for k, side in enumerate((left, right))
    )


def _forms(plan: Shortened):
    """Shortened forms of keys, each once."""
    left_out = plan.left_out

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def forms(keys: pd.Series) -> pd.Series:
        out = []
        for text in keys:
            found: set[str] = set()
            now, lost = {text}, 0
            for wanted in left_out.get(len(text), ()):
                for _ in range(wanted - lost):
                    now = {t[:i] + t[i + 1 :] for t in now for i in range(len(t))}
                lost = wanted
                found |= now
            out.append(sorted(found))
        return pd.Series(out, dtype="object")

    return forms


def length_counts(keys: DataFrame) -> dict[int, int]:
    """Keys of each length: a row a length for the driver."""
    return {r["n"]: r["count"] for r in keys.groupBy(F.length("ts").alias("n")).count().collect()}


def _routes(side: DataFrame, key: str, threshold: float, reach: bool, plan: Shortened | None = None) -> DataFrame:
    """Grams of one side with their join cell: (gram, length band, position bucket).

    A passing pair's lengths differ by one band at most and its gram positions by no more than the edits
    that its lengths allow, so the reaching side is copied to the neighbouring cells and no pair is lost.
    With a plan, shortened forms are routes as well, marked so that none is taken for a gram.
    """
    if plan is not None:
        by_gram = _routes(side.filter(~F.length("ts").isin(*plan.alone)) if plan.alone else side, key, threshold, reach)
        rows = side.withColumn("_form", F.explode(_forms(plan)(F.col("ts"))))
        zero = F.lit(0).cast("bigint")
        rows = rows.withColumns({"gram": F.concat(F.lit("\u0000"), "_form"), "band": zero, "cell": zero, "pos": F.lit(0), "_len": F.length("ts")})
        return by_gram.unionByName(_named(rows, side, key))
    factor, bucket = _spans(threshold)
    rate = (100.0 - threshold) / 100.0
    length = F.length("ts")
    band = F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / F.lit(math.log(factor)))
    rows = side.select("*", length.alias("_len"), band.alias("_band"), F.explode("sig.grams").alias("_s"))
    rows = rows.withColumns({"gram": F.col("_s.gram"), "pos": F.col("_s.pos")})
    place = F.floor(F.col("pos") / bucket)
    if reach:
        # The longest partner is factor times as long.
        edits = F.floor((F.col("_len") * (1 + factor) + 1) * rate) + 1
        rows = rows.withColumn("band", F.explode(F.sequence(F.col("_band") - 1, F.col("_band") + 1)))
        low = F.floor(F.greatest(F.col("pos") - edits, F.lit(0)) / bucket)
        rows = rows.withColumn("cell", F.explode(F.sequence(low, F.floor((F.col("pos") + edits) / bucket))))
    else:
        rows = rows.withColumns({"band": F.col("_band"), "cell": place})
    return _named(rows, side, key)


def _named(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    return rows.select("gram", "band", "cell", *[F.col(c).alias(f"{key}_{c}") for c in ("ts", "ord", "pos", *_payload(side))], F.col("_len").alias(f"{key}_len"), F.col("sig.bag").alias(f"{key}_bag"))


def _payload(side: DataFrame) -> list[str]:
    return [c for c in side.columns if c not in ("ts", "ord", "sig")]


_CELL = ("gram", "band", "cell")


def hot_cells(
    left: DataFrame, right: DataFrame, threshold: float, work: Workspace, limit: int = CHECKS_PER_TASK,
    plans: tuple[Shortened, Shortened] | None = None,
) -> DataFrame | None:
    """``(gram, band, cell, rows, cols)`` of join cells with more than ``limit`` candidate checks.

    Such a cell becomes a grid: each side is dealt to blocks of about the root of the limit and copied along
    the other side's blocks only.  It can be small in bytes, so the engine's own skew handling would miss it.
    None when there is no such cell.
    """
    own, other = plans or (None, None)
    n_left = _routes(left, "a", threshold, reach=False, plan=own).groupBy(*_CELL).agg(F.count("*").alias("n_left"))
    n_right = _routes(right, "b", threshold, reach=True, plan=other).groupBy(*_CELL).agg(F.count("*").alias("n_right"))
    counts = n_left.join(n_right, list(_CELL)).filter(F.col("n_left").cast("double") * F.col("n_right") > limit)
    hot = work.materialize(counts.select(*_CELL, *grid(limit)), "hot-cells")
    return None if hot.isEmpty() else hot


class CellGuard:
    """Looks for hot cells only where the whole set of keys has any: parts of it have no more in a cell."""

    def __init__(self, keys: DataFrame, threshold: float, work: Workspace, limit: int = CHECKS_PER_TASK):
        self.threshold, self.work, self.limit = threshold, work, limit
        self.any = hot_cells(keys, keys, threshold, work, limit) is not None

    def plans(self, left: DataFrame, right: DataFrame) -> tuple[Shortened, Shortened] | None:
        return shortened(length_counts(left), length_counts(right), self.threshold, self.limit) if self.any else None

    def between(self, left: DataFrame, right: DataFrame) -> dict:
        """How two sides meet: arguments of `similar_pairs`."""
        plans = self.plans(left, right)
        hot = hot_cells(left, right, self.threshold, self.work, self.limit, plans) if self.any else None
        return {"hot": hot, "plans": plans}


def expected_pairs(keys: DataFrame, plan: Shortened | None) -> float:
    """Pairs that meet on a route, counted once a route."""
    grams = keys.filter(~F.length("ts").isin(*plan.alone)) if plan and plan.alone else keys
    routes = grams.select(F.explode("sig.grams.gram").alias("gram"))
    if plan:
        routes = routes.unionByName(keys.select(F.explode(_forms(plan)(F.col("ts"))).alias("gram")).select(F.concat(F.lit("\u0000"), "gram").alias("gram")))
    n = F.col("count").cast("double")
    return routes.groupBy("gram").count().agg(F.sum(n * (n - 1) / 2)).first()[0] or 0.0


def grid(limit: int) -> tuple[Column, Column]:
    """Blocks of either side for counts ``n_left`` and ``n_right``: copies stay near the larger side's size."""
    side = float(limit) ** 0.5
    short = F.least(F.col("n_left"), F.col("n_right")).cast("double")
    # A short side is one block, and the other side's blocks take what it leaves of the limit.
    rows = F.when(F.col("n_left") <= side, 1.0).otherwise(F.col("n_left") / F.when(short <= side, limit / short).otherwise(side))
    cols = F.when(F.col("n_right") <= side, 1.0).otherwise(F.col("n_right") / F.when(short <= side, limit / short).otherwise(side))
    return F.ceil(rows).cast("int").alias("rows"), F.ceil(cols).cast("int").alias("cols")


def _dealt(side: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Adds the block numbers of the grid; rows of a cell that is not hot have (0, 0)."""
    rows = side.join(hot, list(_CELL), "left")
    n_rows, n_cols = F.coalesce("rows", F.lit(1)), F.coalesce("cols", F.lit(1))
    own = F.xxhash64(f"{key}_ts")
    if key == "a":
        rows = rows.withColumns({"row": F.pmod(own, n_rows).cast("int"), "col": F.explode(F.sequence(F.lit(0), n_cols - 1))})
    else:
        rows = rows.withColumns({"col": F.pmod(own, n_cols).cast("int"), "row": F.explode(F.sequence(F.lit(0), n_rows - 1))})
    return rows.drop("rows", "cols")


def similar_pairs(
    left: DataFrame, right: DataFrame, threshold: float, ordered: bool = False, hot: DataFrame | None = None,
    plans: tuple[Shortened, Shortened] | None = None,
) -> DataFrame:
    """Unequal pairs ``(a, b, a_ord, b_ord, score)`` with a score of at least ``threshold``.

    Both sides bring distinct keys ``(ts, ord, sig)``; the right side's further columns are carried along as
    ``b_<name>``.  ``ordered`` keeps pairs whose left ordinal is the smaller one (self-join).  The join key is
    (gram, length band, position bucket); candidates are checked for position and characters inside
    the join and for edit distance once a pair.  Cells in ``hot`` are dealt to a grid of tasks; with ``plans`` some keys
    meet by shortened forms.  Whether a
    side is broadcast is left to the engine, which knows the sizes.
    """
    own, other = plans or (None, None)
    one = _routes(left.select("ts", "ord", "sig"), "a", threshold, reach=False, plan=own)
    two = _routes(right, "b", threshold, reach=True, plan=other)
    keys = list(_CELL)
    if hot is not None:
        one, two = _dealt(one, "a", hot), _dealt(two, "b", hot)
        keys += ["row", "col"]
    one, two = one.withColumnRenamed("a_ts", "a"), two.withColumnRenamed("b_ts", "b")

    rate = (100.0 - threshold) / 100.0
    total = F.col("a_len") + F.col("b_len")
    edits = F.floor(total * F.lit(rate) + F.lit(1e-9)).cast("int")
    shift = F.col("b_pos") - F.col("a_pos")
    near = F.abs(shift) + F.abs(F.col("b_len") - F.col("a_len") - shift) <= edits
    alike = F.bit_count(F.col("a_bag").bitwiseXOR(F.col("b_bag"))) <= edits
    condition = near & alike & (F.col("a") != F.col("b"))
    carried = ["a", "b", "a_ord", "b_ord", *[f"b_{c}" for c in _payload(right)]]
    for key in keys:
        condition = condition & (F.col(f"x.{key}") == F.col(f"y.{key}"))
    if ordered:
        condition = condition & (F.col("a_ord") < F.col("b_ord"))
    # A pair comes up once for each gram it shares.  The edit distance is asked once a pair: its limit is an
    # aggregate, so the test stays above the grouping.
    met = one.alias("x").join(two.alias("y"), condition).groupBy(*carried).agg(F.max(edits).alias("_edits"))
    # Substitutions count once there and twice here: a lossless lower bound.
    candidates = met.filter(F.expr("levenshtein(a, b, _edits) >= 0")).drop("_edits")
    # Marked as such, the score is computed once per pair: its filter would else be pushed
    # below the distinct, where pairs still repeat, and the score computed again above.
    once = F.pandas_udf(_scores, T.DoubleType()).asNondeterministic()
    scored = candidates.withColumn("score", once("a", "b"))
    return scored.filter(F.col("score") >= threshold)
