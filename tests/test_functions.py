import datetime as dt

import pytest
from pyspark.sql import functions as F

from priorwise.functions import cells, maths, names
from priorwise.sources import quotes


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("9 of 12", (9, 12)), ("---", (0, 0)), ("7", (7, 7)), ("x of y", (0, 0)), (None, (0, 0))])
def test_x_of_y(spark, text, want):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(cells.x_of_y(F.col("t")).alias("x")).first().x) == want


@pytest.mark.parametrize(
    "make,text,want",
    [
        (cells.clock_seconds, "1:44", 104), (cells.clock_seconds, "--", 0), (cells.feet_inches, "5' 11\"", 71.0), (cells.feet_inches, "--", None), (cells.leading_number, "155 lbs.", 155.0),
        (cells.leading_number, '66"', 66.0), (cells.percent, "45%", 0.45), (cells.percent, "100%", 1.0), (cells.scheduled_rounds, "5 Rnd (5-5-5-5-5)", 5), (cells.scheduled_rounds, "none", 3),
        (cells.url_tail, "http://a/b/c12", "c12"), (cells.outcome_label, "KO/TKO", "KO"), (cells.outcome_label, "Decision - Split", "S-DEC"), (cells.outcome_label, "?", "NC"),
        (cells.stance_label, "Southpaw", "SOUTH"), (cells.stance_label, "Sideways", "UNKNOWN"), (cells.outcome_label, "Could Not Continue", "KO"), (cells.ticker_date, "EV-26JUL11ABCDEF-X", dt.date(2026, 7, 11)), (cells.first_date, "Jul 13, 1978", dt.date(1978, 7, 13)),
        (cells.first_date, "July 3, 1978", dt.date(1978, 7, 3)), (names.tight_key, "O'Neil-Smith ", "oneilsmith"), (names.spaced_key, "O'Neil-Smith", "o neil smith"), (names.plain_key, "Bo Li, Jr.", "bo li"),
        (names.alnum_key, "A b-1", "ab1"), (quotes.line_value, "2.5 rounds", 750.0), (quotes.line_value, "3 min", 180.0), (quotes.line_value, "bad", 0.0),
    ],
)
def test_cells(spark, make, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x == want


def test_accents(spark):
    assert one(spark, names.fold_accents(F.col("t")), t="José Çelik") == "Jose Celik"


def test_soft_cap_is_mirrored(spark):
    a, b = one(spark, maths.soft_cap(F.lit(0.99), 0.9)), one(spark, maths.soft_cap(F.lit(0.01), 0.9))
    assert a < 0.91 and a + b == pytest.approx(1, abs=1e-3) and one(spark, maths.soft_cap(F.lit(0.5), 0.9)) == pytest.approx(0.5, abs=1e-6)


def test_interpolation_and_arrays(spark):
    xs, ys = F.array(F.lit(0.0), F.lit(1.0), F.lit(3.0)), F.array(F.lit(0.0), F.lit(10.0), F.lit(30.0))
    assert [one(spark, maths.interp(F.lit(x), xs, ys)) for x in (-1.0, 0.5, 1.0, 2.0, 9.0)] == [0, 5, 10, 20, 30]
    assert one(spark, maths.running_max(F.array(F.lit(1), F.lit(3), F.lit(2)))) == [1, 3, 3]
    assert sum(one(spark, maths.softmax(F.array(F.lit(1.0), F.lit(2.0))))) == pytest.approx(1)


def test_prices(spark):
    assert one(spark, maths.kelly(F.lit(0.6), F.lit(0.5))) == pytest.approx(0.2)
    assert one(spark, maths.kelly(F.lit(0.4), F.lit(0.5))) == 0
    assert one(spark, maths.taker_cost(F.lit(0.5))) == pytest.approx(0.5175)
    assert one(spark, maths.safe_ratio(F.lit(1.0), F.lit(0.0))) is None
