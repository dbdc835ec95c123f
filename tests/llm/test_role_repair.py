"""Least-cost role repair against all sequences of choices, whole and in segments."""

import random
from itertools import product

import pytest

from millrace.llm import role_repair as R
from millrace.llm.common import prepare
from millrace.llm.role_repair import repair_roles

SCHEMA = "conv_id long, turn long, role string, text string, place string"


def least_cost(roles):
    best = None
    for choices in product(R.CHOICES, repeat=len(roles)):
        state, cost = R.START, 0
        for role, (before, after, merged, inserted) in zip(roles, choices):
            if before != state:
                break
            cost += R.step_cost(R.role_state(role), after, merged, inserted)
            state = after
        else:
            cost += R.END_COSTS[state]
            best = cost if best is None else min(best, cost)
    return best


def legal(transcript):
    roles = [line[2:-2] for line in transcript.split("\n") if line in ("<|system|>", "<|user|>", "<|assistant|>")]
    body = roles[1:] if roles[0] == "system" else roles
    return body == ["user", "assistant"] * (len(body) // 2) and len(body) > 0


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 4)):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "User ", "bot", "tool", None]), f"t{turn}", "x"))
    rows += [(99, t, rng.choice(["user", "assistant", "system"]), f"t{t}", "x") for t in range(40)]
    return rows


def run(spark, rows):
    prepare(spark)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in repair_roles(df).collect()), key=repr)


def test_least_cost_and_legal(spark):
    rows = conversations(1)
    got = run(spark, rows)
    assert len(got) == len(rows)
    for conv in range(12):
        own = sorted((r for r in got if r[0] == conv), key=lambda r: r[1])
        roles = [r[2] for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert sum(r[8] for r in own) == least_cost(roles)
        assert legal("".join(r[9] for r in own))


@pytest.mark.parametrize("segment", [1, 3])
def test_segments_change_nothing(spark, monkeypatch, segment):
    rows = conversations(2)
    whole = [r[:1] + r[2:] for r in run(spark, rows)]
    monkeypatch.setattr(R, "SEGMENT", segment)
    assert sorted((r[:1] + r[2:] for r in run(spark, rows)), key=repr) == sorted(whole, key=repr)


def test_edges_of_the_input(spark):
    rows = [(None, 1, "user", "a", "x"), (1, None, "system", None, "x"), (1, 2, "user", "q", "x"), (1, 2, "user", "q", "x"), (2, 0, "user", "", "x")]
    got = run(spark, rows)
    assert len(got) == 5 and [r[8] for r in got if r[0] is None] == [0]
    assert "".join(r[9] for r in sorted((r for r in got if r[0] == 1), key=lambda r: r[1])) == "<|system|>\n<|end|>\n<|user|>\nq\nq<|end|>\n<|assistant|>\n"
    prepare(spark)
    assert repair_roles(spark.createDataFrame([], SCHEMA)).count() == 0
