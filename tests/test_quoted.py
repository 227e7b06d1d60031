import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from glidemesh.sources import quoted, sites


def random_file(seed):
    """Fields with line ends, commas, quotes inside and after, empty ones; every record two or more fields."""
    rng, rows = random.Random(seed), []
    bits = ["a", "b c", ",", '""', "\n", "\r\n", "é", "", " "]
    for _ in range(rng.randint(5, 40)):
        fields = []
        for _ in range(rng.randint(2, 5)):
            if rng.random() < 0.5:
                fields.append('"' + "".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) + '"' + rng.choice(["", "", "x", 'y"z']))
            else:
                fields.append("".join(rng.choice(["a", "b", 'k"', " ", "é"]) for _ in range(rng.randint(0, 3))).lstrip('"'))
        rows.append(",".join(fields))
    return rng.choice(["\n", "\r\n"]).join(rows) + "\n"


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_records_as_the_csv_module_reads_them(spark, tmp_path, split):
    texts = {f"{i}.txt": random_file(i) for i in range(25)}
    texts["open.txt"] = 'a,b\nc,"left open\nd,e\n'
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, split)
        found = quoted.records(quoted.file_lines(spark, f"file://{tmp_path}"))
        got = found.where("record not in ('', '\r')").select("path", "line_no", quoted.fields(F.col("record")).alias("f")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    mine = {}
    for r in sorted(got, key=lambda r: (r.path, r.line_no)):
        mine.setdefault(r.path.rsplit("/", 1)[-1], []).append(r.f)
    for name, t in texts.items():
        want = [r for r in csv.reader(io.StringIO(t, newline="")) if r]
        if name == "open.txt":  # the file's last line end is none of the record's
            want[-1][-1] = want[-1][-1].rstrip("\n")
        assert mine[name] == want, name


def test_a_description_of_several_lines_keeps_its_grade(spark, tmp_path):
    head = "name,code,country,lat,lon,elev,style,rwdir,rwlen,rwwidth,desc,comment,type,images"
    rows = [
        'One,,FR,4530.000N,00630.000E,1200m,3,090,600m,30m,"first line\nsecond, with {facile}",,,',
        "Two,,FR,4531.000N,00630.000E,,3,,,98ft,,from the comment 123.50,{difficile},a.jpg b.pdf",
        "Three,,FR,4532.000N,00630.000E,,3,,,0,500 x 40",
    ]
    (tmp_path / "a.cup").write_bytes((head + "\r\n" + "\r\n".join(rows)).encode("latin-1"))
    got = {r.name: r for r in sites.read_waypoints(spark, f"file://{tmp_path}", "x").collect()}
    one, two, three = got["One"], got["Two"], got["Three"]
    assert (one.difficulty, one.width_m, one.notes) == ("A", 30.0, "first line\nsecond, with") and [r.line_no for r in (one, two, three)] == [1, 3, 4]
    assert (two.difficulty, two.width_m, two.notes, two.media_refs) == ("C", 29.9, "from the comment 123.50", ["a.jpg", "b.pdf"])
    assert [f.mhz for f in two.frequencies] == [123.5] and three.width_m == 40.0


def test_an_export_is_read_back_as_the_same_sites(spark, tmp_path):
    rows = [(f"p{i % 2}", "airfield" if i % 3 else "outlanding", f'Field "{i}", north', f"LFX{i % 7}", "FR", 40 + i / 10, 5 + i / 10, 100.0 * i, 90.0, 400.0 + i, "123.500", "[A] · a, b") for i in range(60)]
    cols = "pack_id string, kind string, name string, code string, country string, lat double, lon double, elev_m double, heading_deg double, length_m double, frequency string, description string"
    df = spark.createDataFrame(rows, cols)
    sites.export_waypoints(sites.waypoint_lines(df), f"file://{tmp_path}/out")
    back = sites.read_waypoints(spark, f"file://{tmp_path}/out", "export").collect()
    assert sorted((r.name, r.lat, r.lon, r.elev_m, r.length_m, r.heading_deg) for r in back) == sorted(
        (n, pytest.approx(lat, abs=1e-5), pytest.approx(lon, abs=1e-5), e, length, h) for _, _, n, _, _, lat, lon, e, h, length, _, _ in rows
    )
    assert {r.path.split("pack_id=")[1][:2] for r in back} == {"p0", "p1"}
    text = (next((tmp_path / "out" / "pack_id=p0").glob("*.txt"))).read_bytes()
    assert text.startswith(sites.HEADER.encode() + b"\r\n") and text.count(sites.HEADER.encode()) == 1
