import pytest
from instants import at
from pyspark.sql import functions as F

from tarmac.functions import classify, numeric, text, timecols


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "delta, expected, compat",
    [(-30, 1, 1), (14, 1, 1), (15, 2, 2), (119, 2, 2), (120, 3, 4), (239, 3, 4), (240, 4, 4)],
)
def test_five_classes(spark, delta, expected, compat):
    landed, value = F.lit("L"), F.lit(delta)
    assert one(spark, classify.classify5(value, landed)) == expected
    assert one(spark, classify.classify5(value, landed, compat=True)) == compat
    assert one(spark, classify.classify5(value, F.lit("C"))) == 0


@pytest.mark.parametrize("delta, expected", [(-5, 0), (12, 0), (13, 1), (40, 1), (41, 2)])
def test_three_classes(spark, delta, expected):
    assert one(spark, classify.classify3(F.lit(delta))) == expected


def test_labels(spark):
    assert one(spark, classify.class_label5(F.lit(3.0))) == "Delayed between 2 and 4 hours"
    assert one(spark, classify.class_label3(F.lit(2))) == "Delayed more than 41 minutes"
    assert one(spark, classify.class_label5(F.lit(9))) == "9"
    assert one(spark, classify.class_message(F.lit(2))) == "Delay less 2 hours"
    assert one(spark, classify.is_on_time(F.lit("On Time"))) is True


def moment(value):
    return F.lit(value).cast("timestamp_ntz")


def test_whole_minutes_cut_toward_zero(spark):
    a, b = moment("2024-01-01 10:00:59"), moment("2024-01-01 10:02:00")
    assert one(spark, timecols.whole_minutes(a, b)) == 1
    assert one(spark, timecols.whole_minutes(b, a)) == -1


def test_epoch(spark):
    assert one(spark, F.struct(*timecols.epoch_parts(F.lit(-1)))) == (1969, 12, 31, 23)
    assert one(spark, F.struct(*timecols.epoch_ms_parts(F.lit(0), F.lit("America/New_York")))) == (1969, 12, 31, 19)
    assert one(spark, F.struct(*timecols.epoch_ms_parts(F.lit(0)))) == (1970, 1, 1, 0)


@pytest.mark.parametrize(
    "zone, local, utc",
    [
        ("America/New_York", "2016-03-13 01:30", "2016-03-13 06:30"),
        ("America/New_York", "2016-03-13 03:30", "2016-03-13 07:30"),
        ("America/New_York", "2016-11-06 00:30", "2016-11-06 04:30"),
        ("America/New_York", "2016-11-06 01:30", "2016-11-06 05:30"),
        ("America/New_York", "2016-11-06 02:30", "2016-11-06 07:30"),
        ("America/Phoenix", "2016-07-01 12:00", "2016-07-01 19:00"),
        ("Asia/Kolkata", "2016-07-01 12:00", "2016-07-01 06:30"),
    ],
)
def test_local_to_utc(spark, zone, local, utc):
    assert one(spark, timecols.local_to_utc(moment(local), F.lit(zone))) == at(utc)


def test_search_key(spark):
    def parse(date, hour):
        return one(spark, F.struct(*[c.alias(n) for n, c in timecols.search_key(F.lit(date), F.lit(hour)).items()])).asDict()

    good = parse("2016-10-12", "16:40")
    assert (good["search_year"], good["search_month"], good["search_day"], good["search_hour"]) == ("2016", "10", "12", "16")
    assert good["reject_reason"] is None
    assert parse("2016-10", "7")["reject_reason"] == "no such date: 2016-10"
    assert parse("2016-1-2", "7")["search_hour"] == "7"


def test_departure_texts(spark):
    when = moment("2016-10-02 16:05")
    assert one(spark, timecols.long_date(when)) == "October 02 2016"
    assert one(spark, timecols.clock_time(when)) == "04:05 PM"


def test_weekdays_start_on_monday(spark):
    assert list(one(spark, F.struct(*timecols.weekday_onehot(moment("2024-01-01"))))) == [1, 0, 0, 0, 0, 0, 0]
    assert list(one(spark, F.struct(*timecols.weekday_onehot(moment("2024-01-07"))))) == [0, 0, 0, 0, 0, 0, 1]


def test_flight_codes(spark):
    code = F.lit("A B 0641")
    assert one(spark, text.carrier_of(code)) == "A B"
    assert one(spark, text.number_of(code)) == "0641"
    assert one(spark, text.flight_code(F.lit("NK"), F.lit("641"))) == "NK 641"


def test_places(spark):
    none = F.lit(None).cast("string")
    assert one(spark, text.place_label(F.lit("Logan"), F.lit("MA"), F.lit("US"))) == "Logan, MA"
    assert one(spark, text.place_label(F.lit("Orly"), none, F.lit("France"))) == "France"
    assert one(spark, text.ascii_only(F.lit('São "Paulo" 東'))) == 'So "Paulo" '
    assert one(spark, text.route_label(F.lit("BOS"), F.lit("LAS"))) == "BOS > LAS"


@pytest.mark.parametrize("celsius, fahrenheit", [(0.0, 32), (-17.5, 1), (-20.0, -4), (-18.055555, 0), (37.0, 99)])
def test_fahrenheit(spark, celsius, fahrenheit):
    assert one(spark, numeric.to_fahrenheit(F.lit(celsius))) == fahrenheit


def test_fahrenheit_rounds_half_up_below_zero(spark):
    assert one(spark, numeric.to_fahrenheit(F.lit(-32.5 / 1.8))) == 0


@pytest.mark.parametrize("value, zero, whole", [(None, 0, 0), (float("nan"), 0, 0), (-3.7, -3.7, 0), (3.7, 3.7, 3)])
def test_missing_features(spark, value, zero, whole):
    column = F.lit(value).cast("double")
    assert one(spark, numeric.zero_if_missing(column)) == zero
    assert one(spark, numeric.nonnegative_whole(column)) == whole


def test_coordinates(spark):
    assert one(spark, numeric.coordinate(F.lit(42.36646))) == 42.37
    assert one(spark, numeric.known_coordinate(F.lit(None))) == 0.0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_the_session_zone_moves_no_instant(spark, rows, zone):
    """In New York the hour from two to three of this night is skipped, and that from one to two of the second repeated."""
    df = rows([(at("2024-03-10 02:30"), 1710037800), (at("2024-11-03 01:30"), 1730597400)], "t timestamp_ntz, s bigint")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = df.select(
            timecols.utc_to_local(F.col("t"), F.lit("America/Los_Angeles")).alias("local"),
            timecols.local_to_utc(F.col("t"), F.lit("Europe/Paris")).alias("utc"),
            timecols.utc_instant(F.col("s") * 1_000_000).alias("told"),
            timecols.epoch_ms_to_local(F.col("s") * 1000, F.lit("America/New_York")).alias("there"),
        ).collect()
        assert [tuple(r) for r in got] == [
            (at("2024-03-09 18:30"), at("2024-03-10 01:30"), at("2024-03-10 02:30"), at("2024-03-09 21:30")),
            (at("2024-11-02 18:30"), at("2024-11-03 00:30"), at("2024-11-03 01:30"), at("2024-11-02 21:30")),
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
