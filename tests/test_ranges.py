"""Files that are cut into records in byte ranges give what they give when read whole."""

import random

import pytest
from pyspark.sql import functions as F
from test_ingestion import FILES

from fairledger.sources import delimited, ranges

SIZE, COST = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


def made(seed, count):
    """Files of fields with quoted line ends, doubled, stray and open quotes, and odd line ends."""
    rng, out = random.Random(seed), {}
    fields = ["a", "12", "x y", '"q"', '"two\nlines"', '"three\r\n\r\nlines"', '"say ""hi"""', '"a,b"', "é", "",
              '"\n\n\n\n\n\n\n\n\n\n"', 'st"ray', "3.5", '"' + "long " * 12 + '\n"']
    for k in range(count):
        end = rng.choice(["\n", "\r\n"])
        width = rng.choice([1, 2, 3])
        rows = [",".join(rng.choice(fields) for _ in range(width if rng.random() < 0.8 else 2))
                for _ in range(rng.randint(0, 25))]
        text = end.join(rows) + rng.choice(["", end, end + end])
        if rng.random() < 0.15:
            text = text.replace(end, rng.choice(["\n", "\r\n"]), 1)
        if rng.random() < 0.1:
            text += '"never closed' + end + "x"
        body = text.encode("cp1252" if rng.random() < 0.2 else "utf-8")
        out[f"f{k}"] = (b"\xef\xbb\xbf" if rng.random() < 0.2 else b"") + body
    return out


def tables(done):
    sort = lambda df: sorted(map(repr, df.collect()))
    return {
        "runs": sort(done.runs), "columns": sort(done.columns), "rows": sort(done.rows),
        "rejected": sort(done.rejected)}


def versions(files):
    return files.select(
        F.lit("t").alias("tenant_id"), F.lit("p").alias("project_id"),
        F.col("filename").alias("dataset_version_id"), "*")


@pytest.mark.parametrize("source,size", [("known", 40), ("made", 60), ("made", 1 << 20)])
def test_ranges_of_any_size(spark, tmp_path, size, source):
    files = FILES if source == "known" else made(size, 16)
    for name, body in files.items():
        (tmp_path / f"{name} 1+%.csv").write_bytes(body)
    (tmp_path / "book.xlsx").write_bytes(b"PK")
    old = spark.conf.get(SIZE), spark.conf.get(COST)
    try:
        spark.conf.set(SIZE, str(size))
        spark.conf.set(COST, "1")
        got = tables(ranges.ingest(versions(ranges.listed(spark, str(tmp_path)))))
        many = ranges.lines_of(ranges.listed(spark, str(tmp_path))).select("path", "range").distinct().count()
    finally:
        spark.conf.set(SIZE, old[0])
        spark.conf.set(COST, old[1])
    want = tables(delimited.ingest(versions(delimited.read_files(spark, str(tmp_path)))))
    assert many > (2 if size < 100 else 0) * len([b for b in files.values() if len(b) > 120])
    for name in want:
        assert got[name] == want[name]


def test_a_lone_carriage_return_is_refused(spark, tmp_path):
    (tmp_path / "mac.csv").write_bytes(b"a,b\r1,2\r3,4")
    (tmp_path / "inner.csv").write_bytes(b'a,b\n1,"x\ry"\n2,z\rw\n')
    done = ranges.ingest(versions(ranges.listed(spark, str(tmp_path))))
    assert {r["filename"]: r["error_message"] for r in done.runs.collect()} == {
        "mac.csv": ranges.LONE, "inner.csv": None}
    assert [r["fields"] for r in done.rows.orderBy("row_number").collect()] == [["1", "x\ry"], ["2", "z\rw"]]


def test_no_files(spark, tmp_path):
    (tmp_path / "blank.csv").write_bytes(b"\n\r\n")
    files = versions(ranges.listed(spark, str(tmp_path)))
    assert ranges.ingest(files).runs.first()["row_count"] == 0
    none = ranges.ingest(files.where("filename = 'x'"))
    assert all(t.count() == 0 for t in (none.runs, none.columns, none.rows, none.rejected))


def test_a_byte_order_mark_of_a_file_that_is_not_utf8(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes(b"\xef\xbb\xbfa,b\n\xe9,2\n")
    (tmp_path / "open.csv").write_bytes(b'\xef\xbb\xbfa,b\n1,2\n3,"x\n')
    got = tables(ranges.ingest(versions(ranges.listed(spark, str(tmp_path)))))
    assert got == tables(delimited.ingest(versions(delimited.read_files(spark, str(tmp_path)))))
    assert "column_name='\u00ef\u00bb\u00bfa'" in "".join(got["columns"])
    assert "column_name='a'" in "".join(got["columns"])
