import json
import zipfile

import pytest
from pyspark.sql import functions as F

from waymark.functions.scalars import gtfs_seconds
from waymark.operators import timetable
from waymark.sources import feeds, files, sinks

FEED = {
    "agency.txt": "agency_id,agency_name\na,Bus\n", "stops.txt": "stop_id,stop_name,stop_lat,stop_lon\ns1,駅,33.5,132.5\ns2,B,33.51,132.5\ns3,C,33.52,132.5\n", "routes.txt": "route_id,route_short_name\n11,R\n",
    "trips.txt": "route_id,service_id,trip_id,shape_id\n11,w,t1,h1\n", "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,08:00:00,08:00:00,s1,1\nt1,08:10:00,08:11:00,s2,2\nt1,25:00:00,25:00:00,s3,10\n",
    "shapes.txt": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nh1,33.5,132.5,1\nh1,33.52,132.5,10\nh1,33.51,132.5,2\n", "notes.txt": "x\n1\n",
}


def zipped(path, files_, encoding="utf-8"):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files_.items():
            z.writestr(f"feed/{name}", text.encode(encoding))


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-8", "cp932"])
def test_feeds(spark, tmp_path, encoding):
    zipped(tmp_path / "a.zip", FEED, encoding)
    (tmp_path / "folder").mkdir()
    for name, text in FEED.items():
        (tmp_path / "folder" / name).write_bytes(text.encode(encoding))
    for cells in (files.zipped_feed(spark, str(tmp_path / "a.zip")), files.feed_folder(spark, str(tmp_path / "folder"))):
        assert cells.filter("member = 'notes.txt'").count() == 0
        stops = files.feed_table(cells, "stops.txt", "stop_id", "stop_name", "stop_lat", "stop_lon")
        assert stops.filter("stop_id = 's1'").first().stop_name == "駅"
        trips = files.feed_table(cells, "trips.txt", "route_id", "trip_id", "shape_id")
        times = files.feed_table(cells, "stop_times.txt", "trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time")
        timed = times.withColumns({"arrival": gtfs_seconds(F.col("arrival_time")), "departure": gtfs_seconds(F.col("departure_time"))})
        rides = timetable.connections(timed, trips).orderBy("seq").collect()
        assert [(r.from_stop, r.to_stop, r.dep, r.arr) for r in rides] == [("s1", "s2", 28800, 29400), ("s2", "s3", 29460, 90000)]
        assert timetable.feed_errors(stops, trips, files.feed_table(cells, "routes.txt", "route_id"), times).count() == 0
        shapes = files.feed_table(cells, "shapes.txt", "shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence")
        line = sinks.line_features(times, stops, shapes, trips).first()
        assert line.source == "official_shape" and [p[1] for p in line.points] == [33.5, 33.51, 33.52]


def test_missing_file(spark, tmp_path):
    zipped(tmp_path / "b.zip", {k: v for k, v in FEED.items() if k != "trips.txt"})
    with pytest.raises(Exception, match="missing trips.txt"):
        files.zipped_feed(spark, str(tmp_path / "b.zip")).count()


def test_workbook(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><r><t>A</t></r><r><t>B</t></r></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row r="1"/><row r="2"><c r="A2" t="s"><v>0</v></c><c r="AA2" t="inlineStr"><is><t>n</t></is></c></row><row r="3"><c r="AA3"><v>7</v></c></row><row r="4"><c r="A4"><v> </v></c></row><row r="5"><c r="A5" t="s"><v>1</v></c></row></sheetData></worksheet>')
    got = [r.cells for r in files.workbook(spark, str(tmp_path / "w.xlsx")).orderBy("row").collect()]
    assert got == [{"name": "", "n": "7"}, {"name": "AB", "n": ""}]


def test_features(spark, tmp_path):
    f = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": "1", "properties": {"kind": "x"}, "geometry": {"type": "Point", "coordinates": [132.5, 33.5]}}]}
    (tmp_path / "f.json").write_text(json.dumps(f))
    r = files.features(spark, str(tmp_path / "f.json"), "kind:string").first()
    assert (r.id, r.properties.kind, r.geometry.coordinates) == ("1", "x", [132.5, 33.5])


def test_feed_source(spark, tmp_path):
    """Archives of a folder, a partition for each member, only the wanted members and columns decoded."""
    zipped(tmp_path / "a.zip", FEED, "cp932")
    zipped(tmp_path / "b.zip", FEED | {"stop_times.txt": "trip_id,stop_id,stop_sequence\n" + "".join(f"t{k},s{k % 3},{k}\n" for k in range(12_345))})
    got = feeds.read_feeds(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 2 * 6
    old = files.zipped_feed(spark, str(tmp_path))
    told = lambda df: sorted((r.path.rsplit("/", 1)[-1], r.member, r.row, tuple(sorted(r.cells.items()))) for r in df.collect())
    assert told(got) == told(old) and got.filter("cells['stop_name'] = '駅'").count() == 2
    some = feeds.read_feeds(spark, str(tmp_path / "b.zip"), members=("stop_times.txt",), columns=("stop_id",))
    assert some.rdd.getNumPartitions() == 1 and some.count() == 12_345 and some.filter(F.size("cells") != 1).count() == 0
    zipped(tmp_path / "c.zip", {k: v for k, v in FEED.items() if k != "trips.txt"})
    with pytest.raises(Exception, match="missing trips.txt"):
        feeds.read_feeds(spark, str(tmp_path)).count()


def test_feeds_written_and_read_again(spark, tmp_path):
    rows = [("x", 1, 'a "quoted", name'), ("x", 2, None), ("y", 3, "日本\nline")]
    stops = spark.createDataFrame(rows, "feed string, stop_id long, stop_name string")
    rest = {m: stops.select("feed", F.lit("1").alias("id")).distinct() for m in ("agency.txt", "routes.txt", "trips.txt", "stop_times.txt")}
    feeds.write_feeds(str(tmp_path / "out"), {"stops.txt": stops} | rest)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["x.zip", "y.zip"]
    got = feeds.read_feeds(spark, str(tmp_path / "out"), members=("stops.txt",)).collect()
    assert {(r.path[-5], r.cells["stop_id"], r.cells["stop_name"]) for r in got} == {("x", "1", 'a "quoted", name'), ("x", "2", ""), ("y", "3", "日本\nline")}


def test_contract_of_a_broken_feed(spark, tmp_path):
    broken = FEED | {
        "agency.txt": "agency_id\n", "stops.txt": "stop_id,stop_lat,stop_lon\ns1,91,0\ns2,x,0\ns3,0,0\n", "routes.txt": "route_id,route_short_name,route_type\n",
        "trips.txt": "route_id,service_id,trip_id\n9,w,t1\n", "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,08:00:00,8:60:00,s1,1\nt1,25:00:00,25:00:00,s1,1\nt2,1:2:3,1:2:3,s9,x\nt1,00:00:00,00:00:00,s3,2\n",
    }
    zipped(tmp_path / "a.zip", broken)
    cells = feeds.read_feeds(spark, str(tmp_path))
    got = {r.error for r in timetable.contract_errors(cells, cells.select("path")).collect()}
    assert got == {
        "no rows: routes.txt", "missing column: stops.txt/stop_name", "stop out of range: s1", "no coordinate: s2", "trip without route: t1", "stop time without trip: t2", "stop time without stop: s9",
        "stop time that does not parse: t1/s1", "stop time that does not parse: t2/s9", "repeated stop time: t1/1",
    }


def test_json_lines_and_first_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    assert [r.value for r in sinks.json_lines(rows).collect()] == ['{"k":1,"v":"a"}']
    assert json.loads(sinks.json_lines(rows, pretty=True).first().value) == {"k": 1, "v": "a"} and "\n" in sinks.json_lines(rows, pretty=True).first().value
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name, text in (("b.csv", "x\n2\n"), ("a.CSV", "x,y\n1,z\n"), ("0.txt", "q\n")):
            z.writestr(name, text)
    assert [(r.member, dict(r.cells)) for r in files.first_csv(spark, str(tmp_path / "z.zip")).collect()] == [("a.CSV", {"x": "1", "y": "z"})]
