"""Scenario tables: evaluation scenarios and per-dataset injection specs.

"MAR3" = mechanism MAR at level 3 (rate index 2) of every MAR spec row of the
dataset; "MCAR1 & MAR1 & MNAR1" chains three scenarios.
"""

from __future__ import annotations

from ..operators.inject import Step

# Experiment seeds and the evaluation scenarios
# (train injection scenario, ordered test injection scenarios).
EXPERIMENT_RUN_SEEDS = [100, 200, 300, 400, 500, 600, 700, 800, 900, 1000]
_ALL15 = ["MCAR1", "MAR1", "MNAR1", "MCAR2", "MAR2", "MNAR2", "MCAR3", "MAR3", "MNAR3",
          "MCAR4", "MAR4", "MNAR4", "MCAR5", "MAR5", "MNAR5"]
_THREE = ["MCAR3", "MAR3", "MNAR3"]
EVALUATION_SCENARIOS = {
    "mixed_exp": ("MCAR1 & MAR1 & MNAR1", ["MCAR1 & MAR1 & MNAR1"]),
    "exp1_mcar3": ("MCAR3", _THREE),
    "exp1_mar3": ("MAR3", _THREE),
    "exp1_mnar3": ("MNAR3", _THREE),
    "exp2_3_mcar1": ("MCAR1", _THREE),
    "exp2_3_mcar5": ("MCAR5", _THREE),
    "exp2_3_mar1": ("MAR1", _THREE),
    "exp2_3_mar5": ("MAR5", _THREE),
    "exp2_3_mnar1": ("MNAR1", _THREE),
    "exp2_3_mnar5": ("MNAR5", _THREE),
    "exp2_3_mcar3": ("MCAR3", _ALL15),
    "exp2_3_mar3": ("MAR3", _ALL15),
    "exp2_3_mnar3": ("MNAR3", _ALL15),
}


def _levels(top: float) -> list[float]:
    """The five rates of a spec row: equal steps up to ``top``."""
    return [round(top * level / 5, 4) for level in range(1, 6)]


# Injection specs of the stand-in datasets, chosen from their own columns: MCAR nulls up to
# half of any feature; under MAR and MNAR the named rows lose up to HIGH of their cells and
# their counterpart up to LOW.  Orders: two of five equal market segments, the lower two of
# five regions, prices from 200,000 (about a third), customers in debt, urgent orders.
# Lineitem: the open half of the lines, the top fifth of quantities, middling discounts.
HIGH, LOW = 0.40, 0.15
INJECTION_SPECS = {
    "orders": {
        "MCAR": [(("o_totalprice", "c_acctbal", "o_orderpriority", "c_nation"), None, _levels(0.5))],
        "MAR": [
            (("c_acctbal", "o_orderpriority"), ("c_mktsegment", ["BUILDING", "MACHINERY"]), _levels(HIGH)),
            (("c_acctbal", "o_orderpriority"), ("c_mktsegment", ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]), _levels(LOW)),
            (("o_totalprice", "c_nation"), ("n_regionkey", ["0", "1"]), _levels(HIGH)),
            (("o_totalprice", "c_nation"), ("n_regionkey", ["2", "3", "4"]), _levels(LOW)),
        ],
        "MNAR": [
            (("o_totalprice",), ("o_totalprice", {"ge": 200000.0}), _levels(HIGH)),
            (("o_totalprice",), ("o_totalprice", {"lt": 200000.0}), _levels(LOW)),
            (("c_acctbal",), ("c_acctbal", {"lt": 0.0}), _levels(HIGH)),
            (("o_orderpriority",), ("o_orderpriority", "1-URGENT"), _levels(HIGH)),
        ],
    },
    "lineitem": {
        "MCAR": [(("l_quantity", "l_extendedprice", "l_discount", "l_linenumber_s"), None, _levels(0.5))],
        "MAR": [
            (("l_extendedprice", "l_linenumber_s"), ("l_linestatus", "O"), _levels(HIGH)),
            (("l_extendedprice", "l_linenumber_s"), ("l_linestatus", "F"), _levels(LOW)),
        ],
        "MNAR": [
            (("l_quantity",), ("l_quantity", {"gt": 40.0}), _levels(HIGH)),
            (("l_discount",), ("l_discount", {"ge": 0.03, "le": 0.06}), _levels(LOW)),
        ],
    },
}


def scenario_steps(dataset: str, scenario: str) -> list[Step]:
    """J6/J7: "MAR3" -> the MAR spec rows at rate index 2; "A & B" -> chain."""
    steps = []
    for single in [s.strip() for s in scenario.upper().split("&")]:
        mech, level = single[:-1], int(single[-1])
        for i, (cols, cond, rates) in enumerate(INJECTION_SPECS[dataset][mech]):
            steps.append(Step(strategy=mech, columns=tuple(cols), rate=rates[level - 1],
                              condition=None if mech == "MCAR" else cond, salt=f"{mech}{level}:{i}"))
    return steps


def injection_scenarios(evaluation_scenario: str):
    train, tests = EVALUATION_SCENARIOS[evaluation_scenario]
    return train.upper(), [t.upper() for t in tests]


def test_part(scenario: str) -> str:
    return f"X_test_{scenario}"
