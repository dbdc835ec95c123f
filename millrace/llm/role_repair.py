"""Chat formatting: the cheapest repair of a conversation into a legal sequence of turns, then its rendering.

Legal is: at most one system turn, at the head, then user and assistant in alternation from user to
assistant.  Each given turn is kept or relabelled as a turn of its own, with one empty turn inserted
before it where the automaton needs that, or merged into the turn before it.  A dynamic program over the
automaton's four states finds the least cost; among equals the first in the order of CHOICES, turn by turn.

A conversation may hold most rows, so none is ever gathered.  Turns are put in order by ranges of
(conversation, turn) and cut into segments of SEGMENT rows.  A segment's effect is a 4 x 4 matrix of least
costs; the matrices of a conversation that spans segments fold backwards to the costs-to-go behind each
segment, these give each segment's exit state for any entry state, and those fold forwards to the entry
states.  With entry state and costs-to-go a segment is repaired by itself, exactly as in the whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import small
from ..session import Workspace
from .common import col

SEGMENT = 10_000
MERGE, RELABEL, INSERT = 1, 4, 2
# Role names and their spellings.
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "ai": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
INFINITE = 1 << 40
# What a finished sequence still needs, by state.
ENDINGS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
END_COSTS = [len(ENDINGS[s]) * INSERT for s in range(4)]
OUT = (
    "place long, turn long, role string, new_role string, action string, inserted_before array<string>, "
    "inserted_after array<string>, cost long, rendered string"
)

# (state before, state after, merged, inserted state or None), in order of preference.
CHOICES = [(s, t, False, None) for s in range(4) for t in NEXT[s]]
CHOICES += [(s, s, True, None) for s in (SYSTEM, USER, ASSISTANT)]
CHOICES += [(s, t, False, x) for s in range(4) for x in NEXT[s] for t in NEXT[x]]
BY_STATE = {s: [c[1:] for c in CHOICES if c[0] == s] for s in range(4)}


def role_state(role: str | None) -> int:
    """The state a role leads to; START for an unknown role, which has to be relabelled."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else START


def step_cost(given: int, after: int, merged: bool, inserted: int | None) -> int:
    return (MERGE if merged else 0) + (RELABEL if given != after else 0) + (INSERT if inserted is not None else 0)


def costs_before(given: int, costs: list[int]) -> list[int]:
    """Costs-to-go before a turn, by state, from those behind it."""
    return [min((step_cost(given, *c) + costs[c[0]] for c in BY_STATE[s]), default=INFINITE) for s in range(4)]


def segment_matrix(givens: list[int]) -> list[list[int]]:
    """Least cost from each state before the segment (row) to each state behind it (column)."""
    columns = []
    for end in range(4):
        costs = [0 if s == end else INFINITE for s in range(4)]
        for given in reversed(givens):
            costs = [min(c, INFINITE) for c in costs_before(given, costs)]
        columns.append(costs)
    return [[columns[t][s] for t in range(4)] for s in range(4)]


def repair(givens: list[int], entry: int, costs: list[int]) -> list[tuple[int, bool, int | None]]:
    """The choice for each turn of a segment, given the state before it and the costs-to-go behind it."""
    behind = [costs]
    for given in reversed(givens):
        behind.append(costs_before(given, behind[-1]))
    behind.reverse()
    chosen, state = [], entry
    for i, given in enumerate(givens):
        best = min(BY_STATE[state], key=lambda c: step_cost(given, *c) + behind[i + 1][c[0]])
        chosen.append(best)
        state = best[0]
    return chosen


def fragment(state: int, after: int, merged: bool, inserted: int | None, text: str, endings: tuple[int, ...]) -> str:
    """What a turn adds to the transcript; the fragments of a conversation in order are its rendering."""
    close = "<|end|>\n"
    out = ""
    if merged:
        out += "\n" + text
    else:
        for turn in [x for x in (inserted, after) if x is not None]:
            out += (close if state != START else "") + f"<|{ROLES[turn - 1]}|>\n"
            state = turn
        out += text
    for turn in endings:
        out += f"{close}<|{ROLES[turn - 1]}|>\n"
    return out


def repaired_rows(turns: list[dict], entry: int, costs: list[int], ends: bool) -> list[tuple]:
    """Output columns of a segment's turns."""
    givens = [role_state(t["role"]) for t in turns]
    rows, state = [], entry
    for i, (after, merged, inserted) in enumerate(repair(givens, entry, costs)):
        endings = ENDINGS[after] if ends and i == len(turns) - 1 else ()
        relabelled = givens[i] != after
        action = "_".join([x for x, on in (("merge", merged), ("relabel", relabelled)) if on]) or "keep"
        text = fragment(state, after, merged, inserted, turns[i]["text"] or "", endings)
        rows.append(
            (
                turns[i]["place"], turns[i]["turn"], turns[i]["role"], ROLES[after - 1], action,
                [ROLES[inserted - 1]] if inserted is not None else [], [ROLES[t - 1] for t in endings],
                step_cost(givens[i], after, merged, inserted) + INSERT * len(endings), text,
            )
        )
        state = after
    return rows


def _segments(df: DataFrame, function: Callable[[dict, list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Applies a function to each (conv, seg) in order: (its first row, its rows) to output rows."""
    dealt = df.repartition("conv", "seg").sortWithinPartitions("conv", "seg", "place")
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch.to_pylist())
        out: list[tuple] = []
        for _, group in groupby(rows, key=lambda r: (r["conv"], r["seg"])):
            turns = list(group)
            out += function(turns[0], turns)
            if len(out) >= 2000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    kinds = _arrow_schema(df, schema)

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in stream(batches):
            yield from pa.Table.from_pandas(frame, schema=kinds, preserve_index=False).to_batches()

    return dealt.mapInArrow(arrow, schema)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def _fold_back(group: pd.DataFrame) -> pd.DataFrame:
    """Costs-to-go behind each segment of a conversation."""
    group = group.sort_values("seg", ascending=False)
    costs, out = END_COSTS, []
    for matrix in group["matrix"]:
        out.append(list(costs))
        costs = [min(matrix[4 * s + t] + costs[t] for t in range(4)) for s in range(4)]
    return pd.DataFrame({"conv": group["conv"], "seg": group["seg"], "costs": out})


def _fold_on(group: pd.DataFrame) -> pd.DataFrame:
    """Entry state of each segment of a conversation, and whether it is the last."""
    group = group.sort_values("seg")
    state, out = START, []
    for exits in group["exits"]:
        out.append(state)
        state = int(exits[state])
    return pd.DataFrame({"conv": group["conv"], "seg": group["seg"], "costs": group["costs"], "entry": out, "ends": [False] * (len(out) - 1) + [True]})


def repair_roles(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, place, turn, role, new_role, action, inserted_before, inserted_after, cost, rendered: one row per input row.

    Place rises along each conversation (its numbers depend on how the rows were dealt).
    Turns come by number (null first), then role and text.  Unknown and null roles fit no state and are relabelled;
    null text is empty.  Rows without a conversation are returned with null new_role, action and rendered, and cost 0.
    Repeated rows are turns of their own.  An empty table gives no rows.  Other columns are not read.  A conversation's costs
    add up to the least cost; its rendered fragments in order are the repaired transcript up to a last end mark.
    """
    space = Workspace(turns.sparkSession)
    conv_type = dict(turns.dtypes)[conv_col]
    own = turns.select(
        col(conv_col).alias("conv"), col(turn_col).cast("long").alias("turn"), col(role_col).cast("string").alias("role"),
        col(text_col).cast("string").alias("text"),
    )
    given = own.filter("conv IS NOT NULL").withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.xxhash64("text"), F.col("tie")]
    dealt = given.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    place = F.monotonically_increasing_id()  # the partition, then the row in it
    seg = F.spark_partition_id().cast("long") * (1 << 32) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / SEGMENT)
    ordered = space.materialize(dealt.withColumns({"place": place, "seg": seg}), "turns")

    spans = ordered.groupBy("conv").agg(F.min("seg").alias("first"), F.max("seg").alias("final")).filter("first < final")
    spans = space.materialize(spans.select("conv"), "spanning")
    split = ordered.join(small(spans), "conv", "left_semi")
    matrices = _segments(
        split,
        lambda head, rows: [(head["conv"], head["seg"], [c for line in segment_matrix([role_state(r["role"]) for r in rows]) for c in line])],
        f"conv {conv_type}, seg long, matrix array<long>",
    )
    behind = matrices.groupBy("conv").applyInPandas(_fold_back, f"conv {conv_type}, seg long, costs array<long>")
    behind = space.materialize(behind, "costs-to-go")

    def exits(head: dict, rows: list[dict]) -> list[tuple]:
        givens, costs = [role_state(r["role"]) for r in rows], list(head["costs"])
        return [(head["conv"], head["seg"], costs, [repair(givens, s, costs)[-1][0] for s in range(4)])]

    ways = _segments(split.join(small(behind), ["conv", "seg"]), exits, f"conv {conv_type}, seg long, costs array<long>, exits array<long>")
    entries = ways.groupBy("conv").applyInPandas(_fold_on, f"conv {conv_type}, seg long, costs array<long>, entry long, ends boolean")
    entries = space.materialize(entries, "entries")

    def emit(head: dict, rows: list[dict]) -> list[tuple]:
        entry = START if head["entry"] is None else head["entry"]
        costs = END_COSTS if head["costs"] is None else list(head["costs"])
        done = repaired_rows(rows, entry, costs, head["ends"] is not False)
        return [(head["conv"], *row) for row in done]

    known = ordered.join(small(entries), ["conv", "seg"], "left")
    out = _segments(known, emit, f"conv {conv_type}, {OUT}").withColumnRenamed("conv", "conv_id")
    nothing = own.filter("conv IS NULL").select(
        F.col("conv").alias("conv_id"), F.lit(None).cast("long").alias("place"), "turn", "role", F.lit(None).cast("string").alias("new_role"),
        F.lit(None).cast("string").alias("action"), F.array().cast("array<string>").alias("inserted_before"),
        F.array().cast("array<string>").alias("inserted_after"), F.lit(0).cast("long").alias("cost"),
        F.lit(None).cast("string").alias("rendered"),
    )
    return out.unionByName(nothing)
