"""Interactions of the two sides of a pair: what one side does against where the other is weak."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: what stands in for a measure that a side lacks; 0 for all others
DEFAULTS = {"reach_in": 70.0, "cardio_score": 1.0, "age_years": 28.0, "stance_wr_vs_opp_stance": 0.5}
MEASURES = (
    "wrestler_score", "volume_score", "cardio_score", "chin_proxy", "reach_in", "age_years", "layoff_days", "stance_wr_vs_opp_stance",
    "sub_att_per_15_decay", "sub_def_decay", "td_per_15_decay", "td_def_decay", "ctrl_pct_decay", "kd_per_15_decay", "kd_per_sig_decay",
    "slpm_decay", "sapm_decay", "str_acc_decay", "str_def_decay", "vol_attempted_pm_decay", "distance_share_decay", "leg_share_decay",
    "ko_win_rate_decay", "ko_loss_rate_decay", "sub_win_rate_decay", "sub_loss_rate_decay", "r1_ko_win_rate_decay", "r1_sub_win_rate_decay",
    "finish_rate_decay", "dec_rate_decay", "ko_win_rate_ctd", "sub_win_rate_ctd", "dec_rate_ctd",
)


def _above(x: Column, floor: float = 0.0) -> Column:
    """x less the floor where it is over it, else 0; null stays null, which ``greatest`` would not keep."""
    return F.when(x > floor, x - floor).when(x.isNotNull(), 0.0)


def _share(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _of_side(me: SimpleNamespace, foe: SimpleNamespace, longer: Column, heavy: Column) -> dict[str, Column]:
    """Interactions of one side; ``longer`` is its reach beyond the other's, ``heavy`` 1 in the heaviest classes."""
    open_to_takedowns, leaky = _above(1 - foe.td_def_decay), _above(1 - foe.str_def_decay)
    submits = me.sub_win_rate_ctd * F.log1p(me.sub_att_per_15_decay * 15)
    stops = me.ko_win_rate_ctd * F.log1p(me.kd_per_15_decay * 15)
    finishes = me.ko_win_rate_ctd + me.sub_win_rate_ctd
    return {
        "sub_trap": me.wrestler_score * foe.sub_att_per_15_decay * foe.sub_def_decay,
        "tdd_vs_wrestler": me.td_per_15_decay * foe.td_def_decay,
        "grappling_control_threat": me.td_per_15_decay * me.ctrl_pct_decay * open_to_takedowns,
        "reach_punish": _above(foe.reach_in - me.reach_in) * foe.distance_share_decay * foe.str_acc_decay,
        "reach_kick": _above(longer) * me.leg_share_decay,
        "reach_offense": _above(longer) * me.distance_share_decay * me.str_acc_decay,
        "opp_hittability": foe.sapm_decay * leaky,
        "stance_history_perf": me.stance_wr_vs_opp_stance,
        "age_hw": F.when(me.age_years > 33, me.age_years * heavy).otherwise(0.0),
        "layoff_age": me.layoff_days * _above(me.age_years, 32.0),
        "pace_x_power": me.vol_attempted_pm_decay * foe.kd_per_sig_decay,
        "power_vs_chin": me.kd_per_15_decay * foe.chin_proxy,
        "ko_threat": me.ko_win_rate_decay * foe.ko_loss_rate_decay,
        "sub_threat": me.sub_win_rate_decay * foe.sub_loss_rate_decay,
        "r1_ko_threat": me.r1_ko_win_rate_decay * foe.ko_loss_rate_decay,
        "r1_sub_threat": me.r1_sub_win_rate_decay * foe.sub_loss_rate_decay,
        "sub_specialist_idx": submits,
        "sub_specialist_x_weakness": submits * (foe.sub_loss_rate_decay + 0.1),
        "ko_specialist_idx": stops,
        "ko_specialist_x_weakness": stops * (foe.ko_loss_rate_decay + 0.1),
        "ko_specialist_x_chin": stops * foe.ko_loss_rate_decay,
        "finish_share": finishes / (finishes + me.dec_rate_ctd + 0.1),
        "ko_matchup": me.slpm_decay * me.str_acc_decay * foe.ko_loss_rate_decay,
        "chin_decay_threat": foe.ko_loss_rate_decay * _above(foe.age_years, 30.0) / 10,
        "layoff_chin": foe.ko_loss_rate_decay * foe.layoff_days / 365,
    }


def _of_pair(a: SimpleNamespace, b: SimpleNamespace, rounds: Column) -> dict[str, Column]:
    """Interactions that both sides share."""
    strikes = a.slpm_decay + b.slpm_decay
    last = lambda s: _share(1 - s.r1_ko_win_rate_decay - s.r1_sub_win_rate_decay)
    return {
        "cardio_gap_5rd": F.when(rounds >= 5, a.cardio_score - b.cardio_score).otherwise(0.0),
        "pace_diff": a.volume_score - b.volume_score,
        "finish_combined": 1 - (1 - a.finish_rate_decay) * (1 - b.finish_rate_decay),
        "dec_prone_combined": a.dec_rate_decay * b.dec_rate_decay,
        "combined_slpm": strikes,
        "combined_vol_attempted_pm": a.vol_attempted_pm_decay + b.vol_attempted_pm_decay,
        "expected_total_strikes": strikes * rounds * 5,
        "combined_power_density": a.kd_per_sig_decay + b.kd_per_sig_decay,
        "combined_finish_rate": a.finish_rate_decay + b.finish_rate_decay,
        "combined_dec_rate": a.dec_rate_decay + b.dec_rate_decay,
        "expected_p_r1_finish": 1 - last(a) * last(b),
    }


def matchup_interactions(df: DataFrame, rounds: str = "scheduled_rounds", weight_class: str = "weight_class", reach_diff: str = "reach_diff") -> DataFrame:
    """``df`` with the interactions of its pairs, 25 for each side (``_a``, ``_b``) and 11 of both.

    Measures are read from ``<measure>_a`` and ``<measure>_b``; a null or a column
    that is missing counts as its default. Without scheduled rounds there are
    three, without a class it is no heavy one, without the column of reach
    differences they are 0; a null difference leaves its interactions null. An
    interaction replaces a column of its name. One projection, no shuffle.
    """
    held = set(df.columns)

    def measures(side: str) -> SimpleNamespace:
        default = lambda m: F.lit(DEFAULTS.get(m, 0.0))
        read = lambda m: F.coalesce(F.col(f"{m}_{side}").cast("double"), default(m)) if f"{m}_{side}" in held else default(m)
        return SimpleNamespace(**{m: read(m) for m in MEASURES})

    a, b = measures("a"), measures("b")
    planned = F.coalesce(F.col(rounds).cast("double"), F.lit(3.0)) if rounds in held else F.lit(3.0)
    heavy = F.coalesce(F.col(weight_class).rlike(r"(?i)\bheavyweight\b"), F.lit(False)).cast("double") if weight_class in held else F.lit(0.0)
    longer = F.col(reach_diff).cast("double") if reach_diff in held else F.lit(0.0)
    made = {f"{k}_a": c for k, c in _of_side(a, b, longer, heavy).items()} | {f"{k}_b": c for k, c in _of_side(b, a, -longer, heavy).items()}
    return df.withColumns(made | _of_pair(a, b, planned))
