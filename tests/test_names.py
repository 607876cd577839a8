import pytest

from plantloom.functions.names import (
    PhysicalRules,
    names_by_rules,
    sanitize_columns,
    sanitize_name,
)

RULES = PhysicalRules()


@pytest.mark.parametrize(
    ("name", "category", "limits"),
    [
        ("line2.tails_pb", "PERCENTAGE", (0, 100)),
        ("bank_grade_out", "PERCENTAGE", (0, 100)),
        ("sump_7_nivel", "LEVEL", (-500, 1500)),
        ("blower_airflow_n3", "FLOW_RATE", (0, 50000)),
        ("xanthate_dose", "FLOW_RATE", (0, 50000)),
        ("Shell temperature [K]", "TEMPERATURE_KELVIN", (200, 600)),
        ("bearing_temp", "TEMPERATURE_KELVIN", (200, 600)),
        ("bearing_temperature_c", "TEMPERATURE_CELSIUS", (-50, 350)),
        ("shaft_torque_nm", "TORQUE", (0, 500)),
        ("mill_rpm", "ROTATIONAL_SPEED", (0, 10000)),
        ("toolwear_2", "TOOL_WEAR", (0, 500)),
        ("pump_fault_3", "BINARY", (0, 1)),
        ("thickener.ph", "PH", (0, 14)),
        ("slurry_densidad", "DENSITY", (0.5, 5)),
        ("cyclone_p80", "PARTICLE_SIZE", (0, 1000)),
        ("drive_watt", "POWER", (0, 50000)),
        ("coffee_feed", "PERCENTAGE", (0, 100)),  # _fe
        ("weekly_phase", "PH", (0, 14)),  # _ph
        ("x_avg", "CURRENT", (0, 1000)),  # _a
        ("crossbar", "PRESSURE", (0, 1000)),  # bar
        ("zz_9_misc", "UNKNOWN", None),
    ],
)
def test_category(name, category, limits):
    assert RULES.category(name) == category
    assert RULES.limits(name) == limits


def test_overrides():
    rules = RULES.with_rule("Probe_AG", 0, 50)
    assert RULES.limits("probe_ag") == (0, 100)
    assert rules.limits("probe_ag") == (0, 50)
    assert rules.has_rule("PROBE_ag") and not RULES.has_rule("probe_ag")
    assert rules.list_overrides() == {"probe_ag": (0.0, 50.0)}
    assert rules.without_rule("probe_ag").limits("probe_ag") == (0, 100)
    with pytest.raises(ValueError):
        RULES.with_rule("x", 2, 1)


def test_expression_agrees_with_names(spark):
    names = ["line2.tails_pb", " Torque [Nm] ", "x_avg", "nothing", "my_special"]
    rules = RULES.with_rule("my_special", 1, 2)
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r for r in rules.classify(df, "name").collect()}
    for n in names:
        lo, hi = rules.limits(n) or (float("-inf"), float("inf"))
        assert (got[n]["category"], got[n]["min_allowed"], got[n]["max_allowed"]) == (
            rules.category(n), lo, hi)


def test_sanitize():
    assert sanitize_name("% Solids / Overflow") == "_solids_overflow"
    assert sanitize_name(" Flow (m3/h) ") == "flow_m3_h"


def test_sanitize_clash(spark):
    df = spark.createDataFrame([(1, 2)], ["A b", "a_b"])
    with pytest.raises(ValueError):
        sanitize_columns(df)
    assert sanitize_columns(df, on_clash="suffix").columns == ["a_b", "a_b_1"]


def test_rules_select():
    cols = ["date", "in.a", "in.b", "out.y", "state.x"]
    assert names_by_rules(cols, "out.y", ["in.", "state"], ["out", ".b"], ["date"]) == [
        "in.a", "out.y", "state.x"]
    assert names_by_rules(cols, "out.y") == ["out.y"]
    assert names_by_rules(cols, "out.y", ["in"], forced_drop=["out.y"]) == ["in.a", "in.b"]
