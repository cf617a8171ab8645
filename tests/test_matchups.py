"""Interactions of pairs: defaults, nulls, mirror images and one case by hand."""

import math

import pytest

from priorwise.operators.matchups import matchup_interactions


def made(spark, **values):
    return matchup_interactions(spark.createDataFrame([values])).first()


def test_by_hand(spark):
    r = made(
        spark, scheduled_rounds=5, weight_class="Heavyweight", reach_diff=-4.0, cardio_score_a=0.9, cardio_score_b=0.4, age_years_a=36.0, layoff_days_a=730.0,
        ko_loss_rate_decay_a=0.5, leg_share_decay_b=0.25, sub_win_rate_ctd_b=0.6, sub_att_per_15_decay_b=0.2, ko_win_rate_ctd_b=0.2, dec_rate_ctd_b=0.1, slpm_decay_a=3.0, slpm_decay_b=2.0,
    )
    want = {
        "cardio_gap_5rd": 0.5, "age_hw_a": 36.0, "age_hw_b": 0.0, "layoff_age_a": 2920.0, "layoff_chin_b": 1.0, "chin_decay_threat_b": 0.3, "chin_decay_threat_a": 0.0, "reach_kick_a": 0.0,
        "reach_kick_b": 1.0, "sub_specialist_idx_b": 0.6 * math.log(4), "sub_specialist_x_weakness_b": 0.06 * math.log(4), "finish_share_b": 0.8, "expected_total_strikes": 125.0, "stance_history_perf_a": 0.5,
    }
    for name, value in want.items():
        assert r[name] == pytest.approx(value), name


def test_missing_columns_and_nulls_take_their_defaults(spark):
    df = spark.sql("SELECT 1 AS contest, 9D AS sub_trap_a, CAST(NULL AS DOUBLE) AS reach_in_a, 75D AS reach_in_b, 0.5D AS distance_share_decay_b, 0.4D AS str_acc_decay_b, CAST(NULL AS INT) AS scheduled_rounds")
    r = matchup_interactions(df).first()
    assert r.reach_punish_a == pytest.approx(1.0) and r.reach_punish_b == 0
    assert r.sub_trap_a == 0 and r.cardio_gap_5rd == 0 and r.age_hw_a == 0 and r.reach_kick_a == 0 and r.expected_p_r1_finish == 0
    assert len(r) == 6 + 2 * 25 + 11  # the clashing column is replaced


def test_a_null_reach_difference_leaves_a_null(spark):
    r = matchup_interactions(spark.sql("SELECT CAST(NULL AS DOUBLE) AS reach_diff, 0.5D AS leg_share_decay_a")).first()
    assert r.reach_kick_a is None and r.reach_offense_b is None


def test_swapped_sides_swap_their_interactions(spark):
    names = ("td_per_15_decay", "td_def_decay", "ctrl_pct_decay", "slpm_decay", "str_acc_decay", "ko_loss_rate_decay", "reach_in")
    values = {f"{n}_{s}": (k + 2) / (7.0 + i) for i, s in enumerate("ab") for k, n in enumerate(names)}
    other = {f"{n[:-1]}{'b' if n[-1] == 'a' else 'a'}": v for n, v in values.items()}
    r, s = made(spark, reach_diff=2.0, **values), made(spark, reach_diff=-2.0, **other)
    for name in (n for n in r.asDict() if n.endswith("_a") and n not in values):
        assert r[name] == pytest.approx(s[f"{name[:-1]}b"]), name


def test_an_empty_table(spark):
    assert matchup_interactions(spark.range(0).selectExpr("id AS contest")).count() == 0
