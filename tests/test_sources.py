import hashlib

import numpy as np
import pandas as pd
import pytest

from framewise.operators.audit import inventory
from framewise.plans import encode
from framewise.sources import fits, tables


def write(folder, name, content):
    path = folder / name
    path.write_bytes(content)
    return str(path)


@pytest.fixture()
def folder(tmp_path):
    ints = np.arange(12, dtype=float).reshape(3, 4)
    write(tmp_path, "a.fits", encode.image(ints, [("BSCALE", 2.0), ("BZERO", 100.0), ("BLANK", 5), ("INSTRUME", "Cam O'Neil"), ("EXPTIME", 30.0),
                                                  ("EXPOSURE", 30.0), ("READMODE", 3), ("PSCOLOR", "LINEAR"), ("BUNIT", "adu")], bits=16))
    rgb = np.arange(24, dtype=float).reshape(3, 2, 4)
    rgb[1, 0, 1] = np.nan
    write(tmp_path, "b.fits", encode.image(rgb, [("GAIN", 1.0), ("GAIN", 2.0), ("EXPTIME", 1.0), ("EXPOSURE", 2.0), ("CCD-TEMP", -400.0)], bits=-32))
    write(tmp_path, "c.fits", encode.image(ints, [("BAYERPAT", "RGGB"), ("XBAYROFF", 1), ("YBAYROFF", 1), ("PSTMIN", -12.0)], bits=-64))
    write(tmp_path, "d.fits", encode.image(np.zeros((60, 60)))[:5000])
    return tmp_path


def test_headers(spark, folder):
    rows = {r["path"].rsplit("/", 1)[1]: r for r in fits.read_frame_headers(spark, f"{folder}/*.fits").collect()}
    a = rows["a.fits"]
    assert (a["width"], a["height"], a["channels"], a["bitpix"]) == (4, 3, 1, 16)
    assert a["text"] == {"camera": "Cam O'Neil", "readoutMode": "3", "domain": "linear", "units": "ADU"}
    assert a["numeric"]["exposure"] == 30.0 and a["numeric"]["scale"] == 2.0 and a["keys"]["exposure"] == ["EXPTIME", "EXPOSURE"]
    assert a["issues"] == []
    b = {(i["field"], i["code"]) for i in rows["b.fits"]["issues"]}
    assert b == {("gain", "invalid"), ("exposure", "conflict"), ("sensorTemperature", "invalid")}
    assert "gain" not in rows["b.fits"]["numeric"] and rows["b.fits"]["numeric"]["zero"] == 0.0
    assert rows["c.fits"]["text"]["sampling"] == "CFA:BGGR"
    assert {i["code"] for i in rows["c.fits"]["issues"]} == {"invalid"}
    assert rows["d.fits"]["issues"][0]["code"] == "unreadable"


def test_rules_of_headers(spark, tmp_path):
    grid = np.zeros((2, 2))
    cases = {
        "range": ([("PSTMIN", -12.0), ("PSTMAX", -8.0), ("CCD-TEMP", -10.0)], set()),
        "outside": ([("PSTMIN", -12.0), ("PSTMAX", -8.0), ("CCD-TEMP", 1.0)], {("sensorTemperature", "invalid")}),
        "unit": ([("CCD-TEMP", 280.0), ("TEMPUNIT", "K")], {("sensorTemperature", "invalid"), ("sensorTemperature", "unsupported")}),
        "bias": ([("PSBIAS", "perhaps"), ("PSCOLOR", "log")], {("biasState", "invalid"), ("domain", "unsupported")}),
        "offset": ([("BAYERPAT", "RGGB"), ("XBAYROFF", "x"), ("YBAYROFF", 3)], {("sampling", "invalid")}),
        "layout": ([("PSLAYOUT", "stripes")], {("sampling", "unsupported")}),
        "mono": ([("PSLAYOUT", "mono"), ("XBINNING", 1.5), ("FILTER", 7)], {("binX", "invalid"), ("filter", "invalid")}),
        "twice": ([("BZERO", 1.0), ("BZERO", 1.0)], {("BZERO", "duplicate"), ("zero", "invalid")}),
    }
    for name, (entries, _) in cases.items():
        write(tmp_path, f"{name}.fits", encode.image(grid, entries))
    write(tmp_path, "text.fits", b"no image at all" * 1000)
    rows = {r["path"].rsplit("/", 1)[1][:-5]: r for r in fits.read_frame_headers(spark, f"{tmp_path}/*.fits").collect()}
    for name, (_, want) in cases.items():
        assert {(i["field"], i["code"]) for i in rows[name]["issues"]} == want, name
    assert rows["offset"]["text"]["sampling"] == "CFA:GBRG" and rows["mono"]["text"]["sampling"] == "mono"
    assert rows["mono"]["keys"]["sampling"] == ["PSLAYOUT"] and "sensorTemperature" not in rows["unit"]["numeric"]
    empty = fits.decode_headers(spark.createDataFrame([("e", b""), ("f", None)], "path string, content binary").where("path = 'e'")).first()
    for row in (rows["text"], empty):
        assert [i["code"] for i in row["issues"]] == ["unreadable"] and row["text"] == {} and row["width"] is None


def test_large_file_by_ranges(spark, tmp_path):
    """A sparse file of 1 GB: headers come from its first blocks, samples from ranges that several tasks read."""
    head = encode.header([("SIMPLE", True), ("BITPIX", 16), ("NAXIS", 3), ("NAXIS1", 16384), ("NAXIS2", 8192), ("NAXIS3", 4)])
    with open(tmp_path / "big.fits", "wb") as out:
        out.write(head)
        out.truncate(len(head) + 16384 * 8192 * 4 * 2)
    listed = fits.listed(spark, f"{tmp_path}/*.fits")
    scanned = fits.scan(listed).first()
    assert scanned["header_bytes"] <= 1 << 20 and scanned["content"] is None
    row = fits.read_frame_headers(spark, f"{tmp_path}/*.fits").first()
    assert (row["width"], row["height"], row["channels"], row["issues"]) == (16384, 8192, 4, [])
    rng = fits.RANGE
    row = type("Row", (), {"path": str(tmp_path / "big.fits"), "bitpix": 16, "data_at": len(head), "channel": 3, "plane": 16384 * 8192,
                           "first": 16384 * 8192 - rng, "width": 16384, "scale": 1.0, "zero": 2.0, "blank": None})
    parts = list(fits.sample_batches(fits.at_offset(row.path), row))
    assert sum(map(len, parts)) == rng and parts[-1]["y"].iloc[-1] == 8191 and set(parts[0]["value"]) == {2.0}


def test_samples(spark, folder):
    rows = fits.read_frame_samples(spark, f"{folder}/a.fits").collect()
    assert len(rows) == 12
    for r in rows:
        raw = r["y"] * 4 + r["x"]
        assert r["value"] is None and r["coverage"] == 0 if raw == 5 else r["value"] == raw * 2 + 100
    rgb = fits.read_frame_samples(spark, f"{folder}/b.fits", channels=[1]).collect()
    assert len(rgb) == 8 and {r["channel"] for r in rgb} == {1}
    assert [r["value"] for r in rgb if (r["x"], r["y"]) == (1, 0)] == [None]


def test_numeric_table(spark, tmp_path):
    n = 5
    columns = {"b": ("B", np.arange(n)), "i": ("I", -np.arange(n)), "junk": ("3E", np.zeros((n, 3))), "j": ("J", np.arange(n) * 100000),
               "k": ("K", np.arange(n) * 10**12), "e": ("E", np.arange(n) / 2), "d": ("D", np.arange(n) / 3)}
    write(tmp_path, "t.fits", encode.table(columns))
    rows = fits.read_numeric_table(spark, f"{tmp_path}/t.fits", ["d", "k", "i", "b"]).orderBy("row").collect()
    assert [(r["b"], r["i"], r["k"], r["d"]) for r in rows] == [(i, -i, i * 1e12, i / 3) for i in range(n)]
    for wrong in (["missing"], ["junk"]):
        with pytest.raises(Exception):
            fits.read_numeric_table(spark, f"{tmp_path}/t.fits", wrong).collect()
    with pytest.raises(ValueError):
        fits.read_numeric_table(spark, f"{tmp_path}/t.fits", [])


def test_custom_decoder(spark, tmp_path):
    write(tmp_path, "x.bin", bytes([1, 2, 3]))

    def decode(path, content):
        yield pd.DataFrame({"x": np.arange(len(content), dtype="int32"), "y": np.int32(0), "channel": np.int32(0),
                            "value": np.frombuffer(content, "u1").astype(float), "coverage": 1.0})

    assert sorted(r["value"] for r in fits.read_frames_with(spark, f"{tmp_path}/*.bin", decode).collect()) == [1.0, 2.0, 3.0]


CATALOG = """Name;Type;RA;Dec;MajAx;MinAx;PosAng;B-Mag;V-Mag;M;NGC;IC;Identifiers;Common names
NGC0224;G;00:42:44.35;-00:30:00;177.83;69.66;35;4.3;3.4;031;;;2MASX;Andromeda
IC0002;*;00:01:00;+01:00:00;;;;;;;;;;
NGC0007;G;01:00:00;+10:00:60.0;1;1;400;12.5;;;;IC12;;
B033;DrkN;;;;;;;;;;;;
"""


def test_object_catalog(spark, tmp_path):
    path = write(tmp_path, "c.csv", CATALOG.encode())
    rows = {r["id"]: r for r in tables.read_object_catalog(spark, [path]).collect()}
    assert set(rows) == {"NGC0224", "NGC0007"}
    a = rows["NGC0224"]
    assert a["label"] == "M 31 / NGC 224" and a["dec"] == pytest.approx(-0.5) and a["magnitude"] == 3.4 and a["magnitude_band"] == "V"
    b = rows["NGC0007"]
    assert b["invalid_position_angle"] and b["position_angle"] is None and b["magnitude_band"] == "B" and b["dec"] == pytest.approx(10 + 1 / 60)
    with pytest.raises(ValueError):
        tables.read_object_catalog(spark, [path, path])
    bad = write(tmp_path, "bad.csv", CATALOG.replace("00:42:44.35", "24:42:44.35").encode())
    with pytest.raises(ValueError):
        tables.read_object_catalog(spark, [bad])


def test_outlines_and_spectra(spark, tmp_path):
    path = write(tmp_path, "o.txt", b"X-Outlines-1\nA 3 1 2 3 4\n5 6\nB 3 0 0 1 1 2 2 A 3 9 9 8 8 7 7\n")
    catalog = spark.createDataFrame([("A",)], "id string")
    rows = tables.read_outlines(spark, path, catalog).orderBy("contour_no", "point_no").collect()
    assert [(r["contour_no"], r["point_no"], r["ra"]) for r in rows] == [(0, 0, 1), (0, 1, 3), (0, 2, 5), (1, 0, 9), (1, 1, 8), (1, 2, 7)]
    csv = write(tmp_path, "s.csv", b'source_id,flux,flux_error\n7,"(1.5,2,3)","(0.1,0,0.2)"\n')
    rows = tables.read_sampled_spectra(spark, csv, 336, 2, 3).collect()
    assert [(r["wavelength"], r["flux"], r["error"]) for r in rows] == [(336, 1.5, 0.1), (338, 2, 0), (340, 3, 0.2)]
    for bad in (b'7,"(1,2)","(0,0,0)"\n', b'7,"(1,2,3)","(0,-1,0)"\n', b'7,"(1,2,3)","(0,0,0)"\n7,"(1,2,3)","(0,0,0)"\n'):
        csv = write(tmp_path, "bad.csv", b"source_id,flux,flux_error\n" + bad)
        with pytest.raises(ValueError):
            tables.read_sampled_spectra(spark, csv, 336, 2, 3)


def test_arrays_inventory_and_results(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])], "id bigint, v array<double>")
    long = tables.samples_from_arrays(df, "id", "v", 2, 2)
    assert {(r["x"], r["y"], r["channel"], r["value"]) for r in long.collect()} >= {(1, 0, 1, 3.0), (0, 1, 0, 4.0)}
    assert tables.samples_to_arrays(long, 2, 2).first()["values"] == [float(i) for i in range(8)]
    for n, c in (("p", b"same"), ("q", b"same"), ("r", b"other")):
        write(tmp_path, f"{n}.dat", c)
    rows = tables.file_inventory(spark, f"{tmp_path}/*.dat").collect()
    assert sorted(r["content_copies"] for r in rows) == [1, 2, 2]
    assert hashlib.sha256(b"other").hexdigest() in {r["sha"] for r in rows}
    assert inventory(spark.createDataFrame([], "path string, content binary")).count() == 0
    out = f"{tmp_path}/result"
    tables.write_result(long, out, ["channel"])
    assert spark.read.parquet(out).count() == 8
    with pytest.raises(Exception):
        tables.write_result(long, out)


def test_small_contours_travel_together(spark):
    n = tables.OUTLINE_ROWS // 3 + 10
    text = "X-Outlines-1 " + " ".join(f"C{i % 7} 3 1 1 2 2 3 {i % 80}" for i in range(n))
    texts = spark.createDataFrame([("a", text)], "path string, text string")
    rows = tables.parse_outlines(texts).collect()
    assert len(rows) == 3 * n and {r["path"] for r in rows} == {"a"}
    assert (rows[-1]["id"], rows[-1]["contour_no"], rows[-1]["point_no"], rows[-1]["dec"]) == (f"C{(n - 1) % 7}", (n - 1) // 7, 2, float((n - 1) % 80))


def test_many_files_as_rows_are_read_in_small_pieces(spark):
    """Python makes objects of about a megabyte of files at a time, and a scan for headers returns no contents."""
    import pyarrow as pa

    files = [(f"f{i}", encode.image(np.full((2, 2), float(i)))) for i in range(1000)]
    batch = pa.RecordBatch.from_pylist([{"path": p, "content": c} for p, c in files])
    parts = list(fits.pieces(iter([batch])))
    assert sum(map(len, parts)) == 1000 and max(p.nbytes for p in parts) <= 2 * fits.PIECE and len(parts) > 4
    df = spark.createDataFrame([*files, ("none", None)], "path string, content binary").coalesce(1)
    assert "content" not in fits.scan(fits.given(df), keep=False).columns
    got = fits.decode_samples(df.where("content is not null"))
    assert got.count() == 4000 and {(r["path"], r["value"]) for r in got.where("x = 0 and y = 0").collect()} == {(f"f{i}", float(i)) for i in range(1000)}


def test_own_format_puts_many_small_files_into_one_batch(spark):
    """Files of a few samples do not make a batch each; paths and missing values stay with their rows."""
    files = [(f"f{i}", bytes([i % 200] * (i % 4))) for i in range(900)]

    def decode(path, content):
        yield pd.DataFrame({"x": np.arange(len(content)), "y": 0, "channel": 0, "value": [None if b == 3 else float(b) for b in content], "coverage": 1.0})

    df = spark.createDataFrame(files, "path string, content binary").coalesce(1)
    got = {(r["path"], r["x"]): r["value"] for r in fits.frames_with(df, decode).collect()}
    assert got == {(p, x): None if c[x] == 3 else float(c[x]) for p, c in files for x in range(len(c))}
    parts = [p for p in (next(decode(*f)) for f in files)]
    assert fits.one_batch(parts, [p for p, _ in files]).num_rows == len(got)
