"""Table-driven scoring rules (FIXTURES §5: R13/R14, R15, J1) and a monotonicity property."""

import datetime as dt
import random

import pytest

from riskloom.operators import score as S

EV_SCHEMA = ("evidence_id long, vendor string, condition string, level int, outlet string, tier int, "
             "in_scope boolean, new_models_only boolean, is_breach boolean, is_going_concern boolean, "
             "is_resolution boolean, published_at timestamp_ntz")
T0 = dt.datetime(2024, 1, 10)


def ev(i, cond, level, outlet="press1", tier=3, in_scope=True, nmo=False, breach=False, gc=False,
       resolution=False, day=0, vendor="V"):
    return (i, vendor, cond, level, outlet, tier, in_scope, nmo, breach, gc, resolution, T0 + dt.timedelta(days=day))


def score(spark, rows):
    book = spark.createDataFrame([(1, "V")], "book_row_id long, vendor string")
    evidence = spark.createDataFrame(rows, EV_SCHEMA)
    r = S.risk_reason(S.risk_score(book, S.adjusted_evidence(evidence))).first()
    return r.risk_level, r.risk_reason


CASES = [
    ("one press outlet at 5 caps at 3", [ev(1, "c5", 5)], 3),
    ("two press outlets at 5 stay 5", [ev(1, "c5", 5, "p1"), ev(2, "c5", 5, "p2")], 5),
    ("one primary at 4 stays 4", [ev(1, "c4", 4, "ir", tier=1)], 4),
    ("two level-3 conditions give 4", [ev(1, "a3", 3), ev(2, "b3", 3)], 4),
    ("two level-4 conditions give 5", [ev(1, "a4", 4, tier=1), ev(2, "b4", 4, tier=1)], 5),
    ("3+3+4 gives 4, no cascade", [ev(1, "a3", 3), ev(2, "b3", 3), ev(3, "c4", 4, tier=1)], 4),
    ("capped + one 3 stays 3", [ev(1, "c5", 5), ev(2, "a3", 3)], 3),
    ("all out of scope gives 1", [ev(1, "port", 4, in_scope=False)], 1),
    ("in-scope level 0 floors at 1", [ev(1, "routine", 0)], 1),
    ("none gives 0", [], 0),
    ("new models only: 5 -> 4", [ev(1, "ban", 5, tier=1, nmo=True)], 4),
    ("breach then resolution is lowered", [ev(1, "breach", 4, tier=1, breach=True, day=0),
                                           ev(2, "refi", 1, tier=1, resolution=True, day=5)], 1),
    ("resolution with going concern is not lowered", [
        ev(1, "breach", 4, tier=1, breach=True, day=0), ev(2, "refi", 1, tier=1, resolution=True, day=5),
        ev(3, "gc", 4, tier=1, breach=True, gc=True, day=6)], 5),
]


@pytest.mark.parametrize("name,rows,level", CASES, ids=[c[0] for c in CASES])
def test_rules(spark, name, rows, level):
    got, reason = score(spark, rows)
    assert got == level, reason
    assert reason.endswith(".")


def test_reason_names_driver_and_exclusions(spark):
    _, reason = score(spark, [ev(1, "c4", 4, tier=1), ev(2, "port", 2, in_scope=False)])
    assert "driven by c4" in reason and "excluded as out of scope: port" in reason


def traced(spark, rows):
    book = spark.createDataFrame([(1, "V")], "book_row_id long, vendor string")
    evidence = spark.createDataFrame(rows, EV_SCHEMA)
    return S.risk_reason(S.risk_score(book, S.adjusted_evidence(evidence), S.rule_trace(evidence))).first().risk_reason


def test_reason_names_the_carve_outs(spark):
    assert traced(spark, [ev(1, "trade_ban", 5, tier=1, nmo=True)]) == (
        "Level 4 driven by trade_ban; carve-outs: trade_ban covers new models only, capped at 4.")
    refinanced = [ev(1, "covenant_breach", 4, tier=1, breach=True, day=0), ev(2, "refinancing", 1, tier=1, resolution=True, day=5)]
    assert traced(spark, refinanced) == "Level 1 driven by refinancing; carve-outs: covenant_breach resolved by a later refinancing."
    warned = traced(spark, [*refinanced, ev(3, "going_concern", 4, tier=1, breach=True, gc=True, day=6)])
    assert "carve-outs: covenant_breach not cleared by refinancing, a going-concern warning stands" in warned
    both = traced(spark, [ev(1, "b", 5, tier=1, nmo=True), ev(2, "a", 5, tier=1, nmo=True), ev(3, "a", 5, tier=2, nmo=True), ev(4, "port", 0, in_scope=False)])
    assert "carve-outs: a covers new models only, capped at 4, b covers new models only, capped at 4; excluded as out of scope: port." in both
    assert "carve-outs" not in traced(spark, [ev(1, "c4", 4, tier=1, nmo=True)])  # at its cap already


def test_decision_validation(spark):
    df = spark.createDataFrame([(1, "V", -1, "r"), (2, "V", 0, "r"), (3, "V", 5, "r"), (4, "V", 6, "r"),
                                (5, "V", None, "r"), (6, "V", 3, " ")],
                               "decision_id long, vendor string, risk_level int, risk_reason string")
    got = {r.decision_id: (r.is_valid, r.quarantine_reason, r.is_risk) for r in S.validate_decisions(df).collect()}
    assert got == {1: (False, "level out of range", None), 2: (True, None, False), 3: (True, None, True),
                   4: (False, "level out of range", None), 5: (False, "missing level", None),
                   6: (False, "missing reason", None)}


def test_score_is_monotone_in_added_in_scope_evidence(spark):
    rnd = random.Random(3)
    for trial in range(4):
        rows = [ev(i, f"c{rnd.randrange(6)}", rnd.randrange(6), f"o{rnd.randrange(3)}", rnd.randrange(1, 4))
                for i in range(rnd.randrange(1, 6))]
        extra = ev(99, f"c{rnd.randrange(6)}", rnd.randrange(6), f"o{rnd.randrange(3)}", rnd.randrange(1, 4))
        # a condition fixes its level (X1): keep the extra row consistent with the others
        same = [r for r in rows if r[2] == extra[2]]
        if same:
            extra = extra[:3] + (same[0][3],) + extra[4:]
        before, _ = score(spark, rows)
        after, _ = score(spark, rows + [extra])
        assert after >= before, (rows, extra)
