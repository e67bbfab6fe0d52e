import pytest
from pyspark.sql import functions as F

from waymark.functions import scalars as S
from waymark.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_times(spark):
    assert one(spark, S.gtfs_seconds(F.lit("25:00:00"))) == 90000
    assert one(spark, S.time_label(F.lit(90060))) == "25:01"
    assert one(spark, S.gtfs_seconds(F.lit(None).cast("string"))) is None
    for bad in ("", "8:60:00", "x"):
        with pytest.raises(Exception, match="not a time"):
            one(spark, S.gtfs_seconds(F.lit(bad)))


def test_mesh(spark):
    lat, lon = S.mesh_centre(F.lit("5032137924"))
    assert 33.47 < one(spark, lat) < 33.49 and 132.49 < one(spark, lon) < 132.51
    assert one(spark, S.mesh_centre(F.lit("123"))[0]) is None


@pytest.mark.parametrize(("key", "bucket"), [("ab", 85), ("ac", 41), ("bc", 42), ("osm:12345:0:fwd", 23), ("", 0)])
def test_hash_bucket(spark, key, bucket):
    assert one(spark, S.hash_bucket(F.lit(key))) == int.from_bytes(key.encode(), "little") % 100 == bucket


def test_numbers(spark):
    assert one(spark, S.first_number(F.lit("50 mph"), 1)) == 50 and one(spark, S.first_number(F.lit("none"), 7)) == 7
    assert one(spark, S.tolerant_number(F.lit(" 1,234 "))) == 1234 and one(spark, S.tolerant_number(F.lit("-"))) == 0
    assert round(one(spark, S.geh(F.lit(110.0), F.lit(100.0))), 4) == 0.9759 and one(spark, S.geh(F.lit(0.0), F.lit(0.0))) == 0
    assert one(spark, S.bpr_minutes(F.lit(2.0), F.lit(1.0), F.lit(0.0))) == float("inf")
    assert one(spark, S.rescaled_walk(F.lit(10.0), 2.4)) == 20


@pytest.mark.parametrize(("value", "sign"), [(0.001, "positive"), (-0.001, "negative"), (0.0004, "neutral"), (-0.0004, "neutral"), (None, "unknown")])
def test_direction(spark, value, sign):
    assert one(spark, S.direction(F.lit(value).cast("double"))) == sign


def test_ages(spark):
    assert [one(spark, c) for c in S.nested_ages(*[F.lit(float(x)) for x in (10, 6, 4, 2)])] == [10, 6, 4, 2]
    assert [one(spark, c) for c in S.nested_ages(*[F.lit(float(x)) for x in (10, 16, -4, 2)])] == [10, 10, 0, 0]


def test_deterrence(spark):
    assert one(spark, S.deterrence(F.lit(0.0), 0.2)) == 1 and one(spark, S.deterrence(F.lit(None).cast("double"), 0.2, F.lit(True))) == 0
    with pytest.raises(Exception, match="missing or negative"):
        one(spark, S.deterrence(F.lit(-1.0), 0.2))


def test_names(spark):
    assert one(spark, T.facility_name(F.lit("医療法人　北斗会 大洲中央病院"))) == "北斗会大洲中央病院"
    assert one(spark, T.facility_name(F.lit("ＨＩＴＯ病院"))) == "hito病院"
    assert one(spark, T.shelter_name(F.lit("大洲小学校（体育館）"))) == "大洲小学校体育館"
    assert one(spark, T.address(F.lit("愛媛県大洲市大洲690番地の1"))) == "大洲690-1"
    lit = F.lit
    assert one(spark, T.match_score(lit("abcdef"), lit("abcdefgh"), lit(0.8), lit("x"), lit("x1"))) == pytest.approx(0.98)
    assert one(spark, T.match_quality(lit("大洲小学校"), lit("大洲小学校運動場"))) == "parent_feature"
    assert one(spark, T.compatible_names(lit("hospital"), lit("hospital a"), lit(""))) is False
