import pytest

from waymark.sources import places

ELEMENTS = "type string, id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>, geometry array<struct<lat:double,lon:double>>"


def test_facilities_and_named_places(spark):
    rows = [
        ("node", 1, 33.0, 132.0, None, {"amenity": "hospital"}, None),
        ("way", 2, None, None, (33.5, 132.5), {"amenity": "clinic", "name": "", "name:ja": "医院"}, [(33.0, 132.0), (33.2, 132.2)]),
        ("way", 3, None, None, None, {"amenity": "townhall", "name": "T"}, None),
        ("node", 4, 33.0, 132.0, None, {"office": "government", "name": "G", "addr:city": "C", "addr:street": "S"}, None),
        ("node", 4, 33.9, 132.9, None, {"office": "other", "name": "H"}, None),
        ("node", 5, 33.0, 132.0, None, {"amenity": "bank", "name": "B", "addr:full": "full"}, None),
    ]
    e = spark.createDataFrame(rows, ELEMENTS)
    assert {(r.place_id, r.name, round(r.lat, 6)) for r in places.facilities(e).collect()} == {("osm:node:1", "hospital", 33.0), ("osm:way:2", "医院", 33.1)}
    assert {(r.place_id, r.name, r.address, r.lat) for r in places.named_places(e).collect()} == {("osm:way:2", "医院", "", 33.5), ("osm:node:4", "G", "CS", 33.0), ("osm:node:5", "B", "full", 33.0)}


def test_hospitals(spark):
    cell = lambda i, kind="1", state="活動中", lat="33.5": ({"機関コード": i, "機関区分": kind, "活動区分": state, "正式名称": "N", "所在地座標（緯度）": lat, "所在地座標（経度）": "132.5"},)
    rows = spark.createDataFrame([cell("a"), cell("b", kind="2"), cell("c", state="休止"), cell("d", lat="x"), cell("e", lat="40"), cell("f", lat="33")], "cells map<string,string>")
    assert {r.official_id for r in places.active_hospitals(rows, 33, 132, 34, 133).collect()} == {"a", "f"}


def test_ages(spark):
    columns = ["地域コード", "総人口", "60-64歳の男性", "65-69歳の男性", "85歳以上の女性", "備考"]
    assert places.age_bands(columns) == {"60-64歳の男性": 60, "65-69歳の男性": 65, "85歳以上の女性": 85}
    rows = spark.createDataFrame([("1", "1,000", "10", "100", "50", ""), (" ", "9", "9", "9", "9", ""), ("2", "1000", "-", "-5", "50", "")], columns)
    r = places.age_context(rows).first()
    assert (r.regions, r.population, r.population_65plus, r.population_75plus, r.share_65plus_pct, r.share_85plus_pct) == (2, 2000.0, 200.0, 100.0, 10.0, 5.0)
    with pytest.raises(ValueError, match="missing"):
        places.age_context(rows.drop("総人口"))
