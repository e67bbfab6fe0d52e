import json
import zipfile

import pytest

from waymark.sources import files, registries

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path, sheets: dict) -> None:
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {MAIN} {REL}><sheets>" + "".join(f'<sheet name="{n}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{i + 1}">' + "".join(cell(i + 1, j, v) for j, v in enumerate(row) if v) + "</row>" for i, row in enumerate(rows))
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")


HEAD = ["№", "施設名", "住所", "x"]


def test_three_layouts(spark, tmp_path):
    book(tmp_path / "a.xlsx", {
        " 指定緊急避難場所 ": [["title"], ["9", "early", "before the header"], HEAD, ["１", " 公園 ", "町1", "●", "", "○", "●", "", "", "1,200"], ["計", "sum"], ["2", "", "no name"], ["3", "山"]],
        "指定一般避難所": [HEAD, ["1", "学校", "町2", "0893", "300人"], ["2", "会館", "町3", "", "４５"]],
        "指定福祉避難所": [HEAD, ["1", "園", "町4", "高齢者", "0894", "20"]], "other": [["1", "x", "y"]],
    })
    got = {r.official_id: r for r in registries.shelters(files.sheets(spark, str(tmp_path / "a.xlsx"))).collect()}
    assert set(got) == {"emergency:1", "emergency:3", "general:1", "general:2", "welfare:1"}
    e = got["emergency:1"]
    assert (e.name, e.address, e.capacity, e.phone) == ("公園", "町1", 1200, None)
    assert e.hazards == {"flood": True, "landslide": False, "storm_surge": False, "earthquake": True, "tsunami": False, "large_fire": False}
    assert (got["emergency:3"].address, got["emergency:3"].capacity) == ("", None)
    assert (got["general:1"].phone, got["general:1"].capacity, got["general:2"].capacity, got["general:1"].hazards) == ("0893", None, 45, None)
    assert (got["welfare:1"].target_users, got["welfare:1"].phone, got["welfare:1"].capacity) == ("高齢者", "0894", 20)

    placed = registries.shelters(files.sheets(spark, str(tmp_path / "a.xlsx"))).selectExpr("*", "33.5D AS lat", "132.5D AS lon", "1.0D AS location_match_score")
    told = {r.id: json.loads(r.feature) for r in registries.shelter_features(placed).collect()}
    assert told["emergency:1"]["geometry"] == {"type": "Point", "coordinates": [132.5, 33.5]} and told["emergency:1"]["properties"]["hazards"]["flood"] is True
    assert told["welfare:1"]["properties"]["target_users"] == "高齢者" and told["welfare:1"]["properties"]["kind_label"] == "指定福祉避難所" and "hazards" not in told["welfare:1"]["properties"]
    g = told["general:1"]["properties"]
    assert "hazards" not in g and "target_users" not in g and g["capacity"] is None and g["osm_name"] is None and g["location_match_score"] == 1.0


def test_sheet_without_header(spark, tmp_path):
    book(tmp_path / "b.xlsx", {"指定一般避難所": [["1", "学校", "町"]]})
    with pytest.raises(ValueError, match="指定一般避難所"):
        registries.shelters(files.sheets(spark, str(tmp_path / "b.xlsx")))


def test_meshes(spark, tmp_path):
    ring = lambda lon, lat: [[lon, lat], [lon + 0.02, lat], [lon + 0.02, lat + 0.02], [lon, lat + 0.02], [lon, lat]]
    mesh = lambda lon, lat, **p: {"type": "Feature", "properties": p, "geometry": {"type": "Polygon", "coordinates": [ring(lon, lat)]}}
    found = [mesh(132.51, 33.41, PTN_2020=10.0, PTN_2025=8.0, PTC_2025=3.0), mesh(132.55, 33.45, PTN_2020=5.5, PTN_2025=None), mesh(133.0, 33.0, PTN_2020=0.0, PTN_2025=0.0)]
    (tmp_path / "m.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": found}))
    rows = registries.meshes(spark, str(tmp_path / "m.geojson"))
    assert {(round(r.lon, 6), round(r.lat, 6)) for r in rows.collect()} == {(132.518, 33.418), (132.558, 33.458), (133.008, 33.008)}
    assert [tuple(r) for r in registries.mesh_grid(rows).collect()] == [("grid-132.5-33.4", 132.5, 33.4, 15.5, 8.0, 3.0, 2)]


def test_road_census(spark, tmp_path):
    head = ["車種区分", "交通量調査単位区間番号", "上り・下りの別", "２４時間自動車類交通量（台）", "道路種別", "路線番号", "令和３年度調査交通量観測・非観測の別"]
    rows = [["1", "s1", "1", "100", "3", "56", "観測"], ["1", "s1", "2", " 50.5 ", "9", "9", "x"], ["1", "s1", "2", "60.5", "", "", ""], ["2", "s1", "1", "999", "", "", ""], ["1", "", "1", "7", "", "", ""], ["1", "s2", "1", "", "4", "7", "非観測"]]
    (tmp_path / "c.csv").write_bytes("\r\n".join(",".join(r) for r in [head, *rows]).encode("cp932"))
    got = sorted(tuple(r) for r in registries.road_census(spark, str(tmp_path / "c.csv")).collect())
    assert got == [("s1", "3", "56", "観測", 160.5), ("s2", "4", "7", "非観測", 0.0)]
