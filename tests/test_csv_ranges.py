import random

import pytest

from spanledger.sources import tables


def _texts():
    rng = random.Random(8)
    atoms = ["word", " ", "\n", "\n\n", '"', '""', ",", "é", "\\", "\r\n", "end.", "'"]
    return [(f"f{k}", "".join(rng.choices(atoms, k=rng.choice([0, 1, 4, 30, 200])))) for k in range(150)]


@pytest.fixture
def narrow(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]

    def to(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 0)

    yield to
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [97, 1000, 1 << 27])
def test_ranges_read_what_one_split_reads(spark, tmp_path, narrow, size):
    df = spark.createDataFrame(_texts(), "patient_filename string, text string")
    path = str(tmp_path / "reports")
    tables.write_csv(df, path, single_file=True)
    whole = tables._csv(spark, path, tables.REPORTS, multi_line=True)
    want = sorted(map(tuple, whole.collect()), key=str)
    narrow(size)
    lines = spark.read.option("lineSep", "\n").text(path)
    assert size > 1000 or lines.rdd.getNumPartitions() > 8
    got = sorted(map(tuple, tables.read_reports(spark, path).collect()), key=str)
    assert got == want and len(got) == 150


def test_a_record_longer_than_many_ranges_and_several_files(spark, tmp_path, narrow):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_text('patient_filename,text\nx,"' + "line\n" * 300 + '"\r\ny,"b ""q"" b"\n\nz,\n')
    (folder / "b.csv").write_text('patient_filename,text\n"w, w",plain\n')
    narrow(64)
    got = {r["patient_filename"]: r["text"] for r in tables.read_reports(spark, str(folder)).collect()}
    assert got == {"x": "line\n" * 300, "y": 'b "q" b', "z": None, "w, w": "plain"}


def test_a_file_with_a_header_alone(spark, tmp_path):
    (tmp_path / "h.csv").write_text("patient_filename,text\n")
    assert tables.read_reports(spark, str(tmp_path / "h.csv")).count() == 0
