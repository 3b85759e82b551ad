"""Files and archives on disk, and the faults they can have."""

import zipfile

from gridterrain.operators import quality
from gridterrain.plans.generate import build_from_archive
from gridterrain.plans.terrain_map import terrain_map, terrain_map_from_archives
from gridterrain.schemas import HEADER_LONG, HEADER_SHORT
from gridterrain.scratch import cut
from gridterrain.sources import archives, postcodes, tables, tiles

HEADINGS = ",".join(HEADER_SHORT) + "\r\n" + ",".join(f" {h} " for h in HEADER_LONG) + "\r\n"
NG = "NG1 1AA,10,457000,340000,E92000001,R1,H1,,D1,W1\nNG2 6AG,90,0,0,E92000001,R1,H1,,,\n"
E_ROWS = '"E1  1AA",10,533000,181000,E92000001,R2,H2,C1,D2,W2\n'


def test_scan_folder(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "ng.csv").write_text(NG)
    (tmp_path / "csv" / "e.csv").write_text(E_ROWS)
    (tmp_path / "head.csv").write_text(HEADINGS)
    table, faults = postcodes.load_postcode_folder(spark, str(tmp_path / "csv"), str(tmp_path / "head.csv"))
    assert faults.collect() == []
    got = {r.Postcode: (r.Postcode_area, r.Quality, r.Eastings, r.Admin_county_code) for r in table.collect()}
    assert got == {"NG1 1AA": ("NG", 10, 457000, None), "NG2 6AG": ("NG", 90, 0, None), "E1  1AA": ("E", 10, 533000, "C1")}
    (tmp_path / "csv" / "tq.csv").write_text(NG)
    (tmp_path / "head.csv").write_text(HEADINGS.replace("PQ", "QQ"))
    _, faults = postcodes.load_postcode_folder(spark, str(tmp_path / "csv"), str(tmp_path / "head.csv"))
    assert sorted((r.check, r.cases) for r in faults.collect()) == [("heading", 1), ("key", 2), ("key", 2)]


def write_zip(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)


def build(spark, folder):
    def sheet(rows, columns):
        return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))

    areas = sheet([("NG", "Nottingham"), ("E", "London")], ["Postcode Area", "Post Town"])
    counties = sheet([(" Greater  County ", "C1")], ["County Name", "County Code"])
    district = ["District Name", "District Code"]
    districts = {"DIS": sheet([("Rushcliffe", "D1")], district), "MTD": sheet([("M", "D8")], district), "UTA": sheet([("U", "D9")], district),
                 "LBO": sheet([("Hackney London Boro", "D2")], district)}
    ward = ["Ward Name", "Ward Code"]
    wards = {k: sheet([(f"{k} Ward", f"W{i}"), (f"{k} Ward (DET) ", f"W{i}")], ward) for i, k in enumerate(["UTW", "UTE", "DIW", "LBW", "MTW"])}
    return build_from_archive(spark, archives.read_archives(spark, str(folder)), areas, counties, districts, wards)


def test_build_from_archive(spark, tmp_path):
    write_zip(tmp_path / "codes.zip", {"Doc/Column_Headers.csv": HEADINGS, "Data/CSV/ng.csv": NG, "Data/CSV/e.csv": E_ROWS})
    table, faults, audit = build(spark, tmp_path)
    assert faults.collect() == []
    found = {(r.check, r.code_column, r.code): r.cases for r in audit.collect()}
    assert found[("unused", "Admin_district_code", "D8")] == 0 and found[("null, unlocated", "Admin_ward_code", None)] == 1
    assert not [k for k in found if k[0] == "failed"]
    rows = {r.Postcode: r for r in table.collect()}
    assert [rows[p].row_id for p in ("E1  1AA", "NG1 1AA", "NG2 6AG")] == [0, 1, 2]
    east = rows["E1  1AA"]
    assert (east["Post Town"], east["County Name"], east["District Name"], east["Ward Name"]) == ("London", "Greater", "London Borough of Hackney", "DIW Ward")
    assert (east.Pattern, east.Inward, east.Outward, east.District) == ("X9  9XX", "1AA", "E1", "1")
    assert quality.missing_columns(table) == []
    assert quality.missing_columns(table.drop("Pattern")) == ["Pattern"]


def test_bad_archive_and_rows(spark, tmp_path):
    write_zip(tmp_path / "codes.zip", {"Data/CSV/ng.csv": NG + "ab1 0AA,10,1,1,E92000001,,,,,\n"})
    write_zip(tmp_path / "evil.zip", {"Data/CSV/e.csv": E_ROWS, "Data/../../x": "x"})
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    table, faults, _ = build(spark, tmp_path)
    assert sorted((r.check, r.subject.split("/")[-1], r.cases) for r in faults.collect()) == [
        ("archive", "broken.zip", 1), ("archive", "evil.zip", 1), ("heading", "missing", 1), ("pattern", "ab1 0AA", 1)]
    assert table.filter("Postcode_area = 'E'").count() == 0


def test_export_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("NG1 1AA", "NG"), ("E1  1AA", "E")], "Postcode string, Postcode_area string")
    out = str(tmp_path)
    assert tables.export_csv(df, out, "zz") == 1 and tables.export_csv(df, out, "ng") == 0 and tables.export_csv(df, out) == 0
    assert spark.read.option("header", True).csv(tables.csv_path(out, "NG")).collect()[0].Postcode == "NG1 1AA"
    assert spark.read.option("header", True).csv(tables.csv_path(out)).count() == 2
    assert tables.load_table(spark, out + "/none", df.schema.simpleString()).isEmpty()
    tables.save_table(df, out + "/t")
    assert tables.load_table(spark, out + "/t", df.schema.simpleString()).count() == 2


HEAD = "ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 50\n"


def test_tile_faults(spark):
    cases = {
        HEAD + "1 2\n3 4\n": None, HEAD.replace("\n", "\r\n") + "1 2\r\n3 4": None, "cellsize 50\n" + HEAD.replace("cellsize 50\n", "") + "1e1 -.5\n  3 4. \n": None,
        "a\nb\nc\nd": "too few lines", HEAD.replace("50", "5.0") + "1 2\n3 4\n": "header value", HEAD + "1 2\n3 4\n\n": "row count",
        HEAD + "1 2\n": "row count", HEAD + "1 x\n3 4\n": "number", HEAD + "1 2d\n3 4\n": "number", HEAD + "1 2\n3\n": "row width", HEAD + "1 2\n\n": "row width",
        HEAD.replace("ncols", "cols") + "1 2\n3 4\n": "header field", HEAD.replace("ncols 2", "ncols 2 2") + "1 2\n3 4\n": "header form", "": "empty", None: "unreadable",
    }
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(cases)], "tile string, text string")
    headers = tiles.tile_headers(df)
    assert {int(r.tile): r.fault for r in headers.collect()} == dict(enumerate(cases.values()))
    cells = {(r.tile, r.row, r.col): r.alt for r in tiles.tile_cells(headers).collect()}
    assert len(cells) == 12 and cells[("0", 1, 0)] == 1.0 and cells[("0", 0, 1)] == 4.0 and cells[("2", 1, 1)] == -0.5


def test_terrain_from_archives(spark, tmp_path):
    for tile, body in {"ny00": "1 1\n1 1\n", "ny10": "1 2\n1 2\n", "ny01": "7 7\n7 x\n"}.items():
        (tmp_path / "ny").mkdir(exist_ok=True)
        write_zip(tmp_path / "ny" / f"{tile}_x.zip", {f"{tile.upper()}.asc": HEAD + body})
    write_zip(tmp_path / "ny" / "ny11_a.zip", {"NY11.asc": HEAD + "1 1\n1 1\n"})
    write_zip(tmp_path / "ny" / "ny11_b.zip", {"NY11.asc": HEAD + "1 1\n1 1\n"})
    texts = archives.tile_archive_texts(archives.read_archives(spark, str(tmp_path)))
    asked = spark.createDataFrame([(0, "ny00", "3x2")], "request_id int, name string, dims string")
    result = terrain_map(asked, texts, "", block=2)
    status = {(r.east, r.north): r.status for r in result.statuses.collect()}
    assert status == {(0, 0): "ok", (1, 0): "ok", (0, 1): "error", (1, 1): "error", (2, 0): "sea", (2, 1): "sea"}
    cells = {(r.row, r.col): r.alt for r in result.cells.collect()}
    assert len(cells) == 24 and cells[(1, 3)] == 2.0 and cells[(2, 0)] == -1000.0
    pixels = {(r.row, r.col): (r.r, r.g, r.b) for r in result.pixels().collect()}
    assert pixels[(2, 0)] == (0xCC, 0xE5, 0xFF) and len(pixels) == 24
    parts = result.statistics()
    assert parts["summary"].first().cells == 24


def test_stray_files_are_left_alone(spark, tmp_path):
    from gridterrain.sources.postcodes import scan_postcode_files

    (tmp_path / "ng.csv").write_text('"NG1 1AA",10,1,2,"E92000001","","","","",""\n')
    (tmp_path / "readme.txt").write_text("two\nlines\n")
    assert [r.Postcode for r in scan_postcode_files(spark, str(tmp_path)).collect()] == ["NG1 1AA"]


def test_damaged_entries_are_null_texts(spark, tmp_path):
    for i, data in enumerate([b"abcdef", b"abcdef", b"\xff\xfe"]):
        write_zip(tmp_path / f"xx0{i}_a.zip", {"XX00.asc": data})
    broken = tmp_path / "xx01_a.zip"
    broken.write_bytes(broken.read_bytes().replace(b"abcdef", b"abcdeg"))
    listed = archives.read_archives(spark, str(tmp_path))
    assert [r.text for r in archives.entry_texts(listed).orderBy("archive").collect()] == ["abcdef", None, None]
    assert archives.unreadable_entries(listed).count() == 2


def test_entries_of_one_archive_are_read_by_all_tasks(spark, tmp_path):
    """Many entries, packed in several ways, behind other bytes, beside archives without a directory."""
    path = tmp_path / "many.zip"
    with open(path, "wb") as raw:
        raw.write(b"bytes before the archive")
        with zipfile.ZipFile(raw, "w") as z:
            for i in range(2_000):
                how = (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)[i % 4]
                z.writestr(f"Data/{i}.csv", f"text {i} " * (i % 7), how)
            z.writestr("Data/folder/", "")
    (tmp_path / "cut.zip").write_bytes(path.read_bytes()[:5_000])
    write_zip(tmp_path / "none.zip", {})
    listed = archives.read_archives(spark, str(tmp_path))
    texts = archives.entry_texts(listed)
    assert {r.entry: r.text for r in texts.collect()} == {f"Data/{i}.csv": f"text {i} " * (i % 7) for i in range(2_000)}
    assert texts.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 100).count() >= 4
    assert {r.archive.split("/")[-1]: r.bad_entries for r in archives.rejected_archives(listed).collect()} == {"cut.zip": 1}
    assert archives.unreadable_entries(listed).collect() == []


def test_large_directories(spark, tmp_path):
    """ZIP64 sizes and offsets, an encrypted entry, and an entry whose header is gone."""
    with zipfile.ZipFile(tmp_path / "wide.zip", "w") as z:
        with z.open("Data/a.csv", "w", force_zip64=True) as out:
            out.write(b"wide\n")
    write_zip(tmp_path / "lost.zip", {"Data/b.csv": "lost"})
    lost = (tmp_path / "lost.zip").read_bytes()
    (tmp_path / "lost.zip").write_bytes(b"XX" + lost[2:])
    write_zip(tmp_path / "locked.zip", {"Data/c.csv": "locked"})
    locked = bytearray((tmp_path / "locked.zip").read_bytes())
    locked[locked.index(b"PK\x01\x02") + 8] |= 1
    (tmp_path / "locked.zip").write_bytes(bytes(locked))
    listed = archives.read_archives(spark, str(tmp_path))
    assert {r.entry: r.text for r in archives.entry_texts(listed).collect()} == {"Data/a.csv": "wide\n", "Data/b.csv": None, "Data/c.csv": None}
    assert [r.line for r in archives.entry_lines(listed).collect()] == ["wide"]


def test_only_wanted_archives_are_opened(spark, tmp_path):
    for tile in ("ny00", "ny01", "ny02"):
        write_zip(tmp_path / f"{tile}_x.zip", {f"{tile.upper()}.asc": HEAD + "1 1\n1 1\n"})
    write_zip(tmp_path / "ny02_y.zip", {"NY02.asc": "x"})
    listed = cut(archives.read_archives(spark, str(tmp_path)), "listed")
    # What is not wanted, or has a copy, is gone by now: opening it would end the job.
    for name in ("ny01_x.zip", "ny02_x.zip", "ny02_y.zip"):
        (tmp_path / name).unlink()
    asked = spark.createDataFrame([(0, "ny00", "1x1"), (1, "ny00", "1x1"), (2, "ny02", "1x1"), (3, "ny55", "1x1")], "request_id int, name string, dims string")
    made = terrain_map_from_archives(asked, listed)
    assert {r.request_id: r.status for r in made.statuses.collect()} == {0: "ok", 1: "ok", 2: "error", 3: "sea"}
    assert {r.request_id: r["count"] for r in made.pixels().groupBy("request_id").count().collect()} == {0: 4, 1: 4}


def test_lines_are_streamed_from_sound_entries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "LINES", 2)
    write_zip(tmp_path / "a.zip", {"Data/CSV/ng.csv": "one\r\ntwo\rthree\n\nfive", "Data/CSV/e.csv": "", "Doc/x.csv": "no"})
    write_zip(tmp_path / "b.zip", {"Data/CSV/tq.csv": "abcdef\nghi\n"})
    (tmp_path / "b.zip").write_bytes((tmp_path / "b.zip").read_bytes().replace(b"abcdef", b"abcdeg"))
    write_zip(tmp_path / "c.zip", {"Data/CSV/ab.csv": "stray\n", "Other/x": "x"})
    zipped = archives.read_archives(spark, str(tmp_path))
    found = archives.entry_lines(zipped, postcodes.DATA_ENTRY).collect()
    assert [(r.entry, r.line) for r in found] == [("Data/CSV/ng.csv", line) for line in ("one", "two", "three", "", "five")]
    assert [r.entry for r in archives.unreadable_entries(zipped).collect()] == ["Data/CSV/tq.csv"]
    assert [r.entry for r in archives.entry_texts(zipped, r"^Doc/").collect()] == ["Doc/x.csv"]


def test_overlong_header_numbers_are_faults(spark):
    from gridterrain.sources.tiles import tile_headers

    text = "ncols 99999999999999999999\nnrows 1\nxllcorner 0\nyllcorner 0\ncellsize 50\n1\n"
    tiles = spark.createDataFrame([("t", text)], "tile string, text string")
    assert tile_headers(tiles).select("fault").first().fault == "header value"


def test_missing_table_is_empty(spark, tmp_path):
    from gridterrain.sources.tables import load_table, save_table

    df = spark.createDataFrame([("NG", "NG1 1AA", "x"), ("AB", "AB1 1AA", "y")], "Postcode_area string, Postcode string, `Post Town` string")
    assert load_table(spark, str(tmp_path / "none"), df.schema).collect() == []
    save_table(df, str(tmp_path / "t"))
    assert load_table(spark, str(tmp_path / "t"), df.schema).count() == 2


def test_a_failed_build_leaves_the_former_table(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "t")
    names = "Postcode_area string, Postcode string"
    first = spark.createDataFrame([("NG", "NG1 1AA"), ("AB", "AB1 1AA")], names)
    tables.save_table(first, path)
    failing = first.withColumn("Postcode", F.when(F.col("Postcode_area") == "AB", F.raise_error(F.lit("midway"))).otherwise(F.col("Postcode")))
    try:
        tables.save_table(failing, path)
        raise AssertionError("the job should fail")
    except Exception as err:
        assert "midway" in str(err)
    assert tables.load_table(spark, path, first.schema).count() == 2
    before = tables.load_table(spark, path, first.schema)
    for n in range(3):  # a table is built from itself; a reader that has begun goes on while its version stays
        tables.save_table(tables.load_table(spark, path, first.schema).union(spark.createDataFrame([("E", f"E{n} 1AA")], names)), path)
        assert tables.load_table(spark, path, first.schema).count() == 3 + n
        if n == 0:
            assert before.count() == 2
    assert len([f for f in (tmp_path / "t").iterdir() if f.is_dir()]) == tables.VERSIONS


def test_malformed_rows_are_faults(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    odd = ["NG3 1AA,10,abc,1,E92000001,R1,H1,,D1,W1", "NG4 1AA,10,1,1,E92000001,R1,H1,,D1,W1,x,y", "NG5 1AA,10,1", '"NG6, 1AA",10,1,1,E92000001,R1,H1,,D1,W1']
    (tmp_path / "csv" / "ng.csv").write_text(NG + "\n".join(odd) + "\n\n")
    (tmp_path / "head.csv").write_text(HEADINGS)
    table, faults = postcodes.load_postcode_folder(spark, str(tmp_path / "csv"), str(tmp_path / "head.csv"))
    want = [("value", odd[0]), ("too many fields", odd[1]), ("too few fields", odd[2])]
    found = postcodes.malformed_rows(spark, str(tmp_path / "csv"))
    assert sorted((r.reason, r.line) for r in found.collect()) == sorted(want) and all(r.file.endswith("/ng.csv") for r in found.collect())
    assert sorted((r.check, r.cases) for r in faults.collect()) == [("row", 1)] * 3 and table.count() == 6
    lines = spark.createDataFrame([("Data/CSV/ng.csv", line) for line in [*NG.split("\n"), *odd]], "entry string, line string")
    assert sorted((r.reason, r.line) for r in postcodes.malformed_lines(lines).collect()) == sorted(want)
    assert postcodes.postcodes_from_lines(lines).count() == 6


def test_places_of_an_empty_table(spark):
    from gridterrain.operators.place import resolve_random
    from gridterrain.sources.dims import grid_squares

    table = spark.createDataFrame([], "row_id bigint, Postcode string, Postcode_area string")
    asked = spark.createDataFrame([(0, "pa", "random"), (1, "ng", "random"), (2, "pc", "NG1 1AA")], "request_id bigint, place_type string, place_value string")
    assert {r.request_id for r in resolve_random(asked, table, grid_squares(spark), 1).collect()} == {1, 2}
