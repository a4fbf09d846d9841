"""The fused healer against a row-by-row simulation of sequential healing."""

import random

import pytest

from dataward.operators.heal import heal

BOUNDS = {"a": (0, 6), "b": (-2, 5)}


def simulate(rows, plan):
    """Sequential semantics on a list of dict rows: clean, rejected, per-action results."""
    clean, rejected, stats = [dict(r) for r in rows], [], []
    for act in plan:
        c, kind = act["column"], act["action_type"]
        hit = []
        if kind == "fix_value" and act["operation"] == "abs":
            hit = [r for r in clean if r[c] is not None and r[c] < 0]
            for r in hit:
                r[c] = abs(r[c])
        elif kind == "fix_value":
            hit = [r for r in clean if r[c] is not None and r[c] not in act["valid_values"]]
            for r in hit:
                r[c] = act["default_value"]
        elif kind == "deduplicate" or act.get("condition") == "is_duplicate":
            seen = set()
            for r in clean:
                if r[c] in seen:
                    hit.append(r)
                seen.add(r[c])
        elif act["condition"] == "is_null":
            hit = [r for r in clean if r[c] is None]
        else:
            low, high = BOUNDS[c]
            hit = [r for r in clean if r[c] is not None and not low <= r[c] <= high]
        if kind == "quarantine":
            if len(hit) > len(clean) * 0.5:
                hit = []
            rejected += [r | {"reject_reason": act["reason"]} for r in hit]
        if kind != "fix_value":
            gone = {id(r) for r in hit}
            clean = [r for r in clean if id(r) not in gone]
        stats.append((len(hit), len(clean)))
    return clean, rejected, stats


def random_plan(rng):
    menu = []
    for c in "ab":
        low, high = BOUNDS[c]
        menu += [
            {"action_type": "fix_value", "column": c, "operation": "abs"},
            {"action_type": "quarantine", "column": c, "condition": "is_null",
             "reason": f"{c} null"},
            {"action_type": "quarantine", "column": c, "condition": "out_of_bounds",
             "min_bound": low, "max_bound": high, "reason": f"{c} range"},
            {"action_type": "quarantine", "column": c, "condition": "is_duplicate",
             "reason": f"{c} repeated"},
            {"action_type": "deduplicate", "column": c}]
    menu.append({"action_type": "fix_value", "column": "s", "default_value": "x",
                 "operation": "replace_invalid_categorical", "valid_values": ["x", "y"]})
    return [rng.choice(menu) for _ in range(rng.randint(1, 6))]


@pytest.mark.parametrize("seed", range(8))
def test_same_as_one_action_after_another(spark, seed):
    rng = random.Random(seed)
    wide = rng.choice([4, 30])
    rows = [{"k": i, "a": rng.choice([None, *range(-wide, wide)]),
             "b": rng.choice([None, 1, 2, -1, 9]), "s": rng.choice(["x", "y", "z", None])}
            for i in range(rng.choice([10, 60]))]
    plan = random_plan(rng)
    df = spark.createDataFrame([(r["k"], r["a"], r["b"], r["s"]) for r in rows],
                               "k bigint, a bigint, b bigint, s string")
    clean, rejected, stats = simulate(rows, plan)
    done = heal(df, plan, "k")
    assert [(s["rows_affected"], s["remaining_rows"]) for s in done.stats] == stats, plan

    def key(r):
        return r["k"]
    assert sorted((r.asDict() for r in done.clean.collect()), key=key) == sorted(clean, key=key)
    got = [] if done.quarantined is None else [r.asDict() for r in done.quarantined.collect()]
    assert sorted(got, key=key) == sorted(rejected, key=key)


def test_too_many_combinations_halves_the_run(spark, monkeypatch):
    import dataward.operators.heal as module
    monkeypatch.setattr(module, "COMBINATION_LIMIT", 2)
    df = spark.createDataFrame([(i, i % 3 - 1, i % 5) for i in range(30)],
                               "k bigint, a bigint, b bigint")
    plan = [{"action_type": "fix_value", "column": "a", "operation": "abs"},
            {"action_type": "quarantine", "column": "b", "condition": "out_of_bounds",
             "max_bound": 3, "reason": "r"},
            {"action_type": "quarantine", "column": "a", "condition": "out_of_bounds",
             "min_bound": 1, "reason": "q"}]
    assert [s["rows_affected"] for s in heal(df, plan, "k").stats] == [10, 6, 8]


def test_unknown_column_action_and_condition(spark):
    df = spark.createDataFrame([(1, "x")], "k bigint, s string")
    done = heal(df, [
        {"action_type": "fix_value", "column": "zz", "operation": "abs"},
        {"action_type": "explode", "column": "s"},
        {"action_type": "quarantine", "column": "s", "condition": "odd"},
        {"action_type": "quarantine", "column": "s", "condition": "fails_regex", "regex": "("},
        {"action_type": "deduplicate", "column": "zz"}], "k")
    assert [s["success"] for s in done.stats] == [False, True, True, True, False]
    assert all(s["rows_affected"] == 0 and s["remaining_rows"] == 1 for s in done.stats)
    assert done.quarantined is None and done.clean.count() == 1


def test_text_numbers_and_not_a_number(spark):
    df = spark.createDataFrame([(1, "-5"), (2, "x"), (3, None), (4, "7"), (5, "8")],
                               "k bigint, v string")
    done = heal(df, [{"action_type": "fix_value", "column": "v", "operation": "abs"},
                     {"action_type": "quarantine", "column": "v", "condition": "out_of_bounds",
                      "reason": "text"}], "k")
    assert {r.k: r.v for r in done.clean.collect()} == {1: "5.0", 3: None, 4: "7", 5: "8"}
    assert [r.reject_reason for r in done.quarantined.collect()] == ["text"]


def test_key_is_checked(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "k int, a int")
    plan = [{"action_type": "deduplicate", "column": "a"}]
    with pytest.raises(ValueError, match="no key"):
        heal(df, plan, "k")
    with pytest.raises(ValueError, match="no key"):
        heal(df.selectExpr("CASE WHEN a = 6 THEN k END AS k", "a"), plan, "k")
