"""The query of pairs' interactions; its SQL spells every formula out for itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.operators.matchups import DEFAULTS, MEASURES, matchup_interactions
from priorwise.plans.views import CONTESTS_SQL, contests, rounded

#: least value and width of measures that are not between 0 and 1
_RANGES = {"reach_in": (60, 25), "age_years": (20, 25), "layoff_days": (0, 1000)}


def _measure(side: str, k: int, name: str) -> Column:
    """Stand-in of a measure, from the side's quantity; every eleventh is missing."""
    low, width = _RANGES.get(name, (0, 1))
    value = low + width * ((F.col(f"{side}_quantity") * (3 * k + 7)) % 97) / 97
    return F.when((F.col("contest_id") + k) % 11 != 0, value).alias(f"{name}_{side}")


def matchup_interactions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All interactions of every contest, of measures that follow its sides' quantities."""
    key = F.col("contest_id")
    label = F.when(key % 3 == 0, "Light Heavyweight Title").when(key % 3 == 1, "Flyweight")
    given = [F.when(key % 4 != 0, key % 4 + 2).alias("scheduled_rounds"), label.alias("weight_class"), ((F.col("a_quantity") - F.col("b_quantity")) / 5).alias("reach_diff")]
    wide = contests(spark, sf_dir).select("contest_id", *given, *(_measure(s, k, m) for s in "ab" for k, m in enumerate(MEASURES)))
    made = matchup_interactions(wide)
    return made.select("contest_id", *(rounded(F.col(c)).alias(c) for c in made.columns if c not in wide.columns))


QUERIES = {"matchup_interactions": matchup_interactions_all}

# {o} is a side, {f} the other one, {sign} the direction of the reach difference
_SIDE_SQL = {
    "sub_trap": "wrestler_score_{o} * (sub_att_per_15_decay_{f} * sub_def_decay_{f})",
    "tdd_vs_wrestler": "td_def_decay_{f} * td_per_15_decay_{o}",
    "grappling_control_threat": "td_per_15_decay_{o} * ctrl_pct_decay_{o} * greatest(1 - td_def_decay_{f}, 0)",
    "reach_punish": "greatest(reach_in_{f} - reach_in_{o}, 0) * distance_share_decay_{f} * str_acc_decay_{f}",
    "reach_kick": "greatest({sign} * reach_diff, 0) * leg_share_decay_{o}",
    "reach_offense": "greatest({sign} * reach_diff, 0) * distance_share_decay_{o} * str_acc_decay_{o}",
    "opp_hittability": "sapm_decay_{f} * greatest(1 - str_def_decay_{f}, 0)",
    "stance_history_perf": "stance_wr_vs_opp_stance_{o}",
    "age_hw": "age_years_{o} * heavy * (age_years_{o} > 33)::INT",
    "layoff_age": "layoff_days_{o} * greatest(age_years_{o} - 32, 0)",
    "pace_x_power": "vol_attempted_pm_decay_{o} * kd_per_sig_decay_{f}",
    "power_vs_chin": "kd_per_15_decay_{o} * chin_proxy_{f}",
    "ko_threat": "ko_win_rate_decay_{o} * ko_loss_rate_decay_{f}",
    "sub_threat": "sub_win_rate_decay_{o} * sub_loss_rate_decay_{f}",
    "r1_ko_threat": "r1_ko_win_rate_decay_{o} * ko_loss_rate_decay_{f}",
    "r1_sub_threat": "r1_sub_win_rate_decay_{o} * sub_loss_rate_decay_{f}",
    "sub_specialist_idx": "sub_win_rate_ctd_{o} * ln(1 + sub_att_per_15_decay_{o} * 15)",
    "sub_specialist_x_weakness": "sub_win_rate_ctd_{o} * ln(1 + sub_att_per_15_decay_{o} * 15) * (sub_loss_rate_decay_{f} + 0.1::DOUBLE)",
    "ko_specialist_idx": "ko_win_rate_ctd_{o} * ln(1 + kd_per_15_decay_{o} * 15)",
    "ko_specialist_x_weakness": "ko_win_rate_ctd_{o} * ln(1 + kd_per_15_decay_{o} * 15) * (ko_loss_rate_decay_{f} + 0.1::DOUBLE)",
    "ko_specialist_x_chin": "ko_win_rate_ctd_{o} * ln(1 + kd_per_15_decay_{o} * 15) * ko_loss_rate_decay_{f}",
    "finish_share": "(ko_win_rate_ctd_{o} + sub_win_rate_ctd_{o}) / (ko_win_rate_ctd_{o} + sub_win_rate_ctd_{o} + dec_rate_ctd_{o} + 0.1::DOUBLE)",
    "ko_matchup": "slpm_decay_{o} * str_acc_decay_{o} * ko_loss_rate_decay_{f}",
    "chin_decay_threat": "ko_loss_rate_decay_{f} * (greatest(age_years_{f} - 30, 0) / 10)",
    "layoff_chin": "ko_loss_rate_decay_{f} * (layoff_days_{f} / 365)",
}
_PAIR_SQL = {
    "cardio_gap_5rd": "(cardio_score_a - cardio_score_b) * (rounds >= 5)::INT",
    "pace_diff": "volume_score_a - volume_score_b",
    "finish_combined": "1 - (1 - finish_rate_decay_a) * (1 - finish_rate_decay_b)",
    "dec_prone_combined": "dec_rate_decay_a * dec_rate_decay_b",
    "combined_slpm": "slpm_decay_a + slpm_decay_b",
    "combined_vol_attempted_pm": "vol_attempted_pm_decay_a + vol_attempted_pm_decay_b",
    "expected_total_strikes": "(slpm_decay_a + slpm_decay_b) * rounds * 5",
    "combined_power_density": "kd_per_sig_decay_a + kd_per_sig_decay_b",
    "combined_finish_rate": "finish_rate_decay_a + finish_rate_decay_b",
    "combined_dec_rate": "dec_rate_decay_a + dec_rate_decay_b",
    "expected_p_r1_finish": "1 - least(greatest(1 - r1_ko_win_rate_decay_a - r1_sub_win_rate_decay_a, 0), 1) * least(greatest(1 - r1_ko_win_rate_decay_b - r1_sub_win_rate_decay_b, 0), 1)",
}


def _measure_sql(side: str, k: int, name: str) -> str:
    low, width = _RANGES.get(name, (0, 1))
    value = f"{low} + {width} * (({side}_quantity * {3 * k + 7}) % 97) / 97::DOUBLE"
    return f"CASE WHEN (contest_id + {k}) % 11 <> 0 THEN {value} ELSE {DEFAULTS.get(name, 0)} END AS {name}_{side}"


def _interactions_sql() -> str:
    measures = ", ".join(_measure_sql(s, k, m) for s in "ab" for k, m in enumerate(MEASURES))
    sides = [(sql.format(o=o, f=f, sign=sign), f"{n}_{o}") for o, f, sign in (("a", "b", 1), ("b", "a", -1)) for n, sql in _SIDE_SQL.items()]
    chosen = ", ".join(f"round({sql}, 6) AS {n}" for sql, n in [*sides, *((sql, n) for n, sql in _PAIR_SQL.items())])
    return f"""
        WITH {CONTESTS_SQL}, m AS (
            SELECT contest_id, CASE WHEN contest_id % 4 <> 0 THEN contest_id % 4 + 2 ELSE 3 END AS rounds, (contest_id % 3 = 0)::INT AS heavy, (a_quantity - b_quantity) / 5::DOUBLE AS reach_diff, {measures} FROM contests)
        SELECT contest_id, {chosen} FROM m"""


ORACLE_SQL = {"matchup_interactions": _interactions_sql()}
