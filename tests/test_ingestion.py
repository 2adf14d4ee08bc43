"""Reading delimited files, landing, and the stream."""

import pytest
from pyspark.sql import functions as F

from fairledger.operators.cells import value_counts
from fairledger.operators.profile import column_facts
from fairledger.sources import delimited, landing
from fairledger.streaming import landing as stream
from fairledger.streaming.landing import landing_stream

MESSY = (
    "supplier_id;name;signup_date;credit_limit;is_active\n"
    "1;Acme Corp;2024-01-15;10000.50;true\n"
    "2;Globex Straße GmbH €;2024-03-02;25000.00;true\n"
    "3;Initech;2023-11-30;5000.00;false\n4;BadRow;2024-01-01\n"
    "5;Umbrella Corp;2022-07-19;7500.25;true"
)
FILES = {
    "messy": MESSY.encode("cp1252"),
    "headerless": b"1,100.00\n2,200.50\n3,300.75",
    "ragged": b"supplier_id,name,country\n1,Acme Corp,US\n2,Globex,DE\n3,BadRow\n"
              b"4,Initech,US,EXTRA\n5,Umbrella Corp,US",
    "quoted": b'\xef\xbb\xbfname,city\r\n"Acme, Inc.",Springfield\r\n\r\n'
              b'"Globex\r\nLLC ""x""",Shelbyville\r\n',
    "stray": b'a,b\n1,2"3\n', "after": b'a,b\n1,"2"3\n', "open": b'a,b\n1,"23\n', "empty": b"",
    "single": b"id\n1\n2\n3\n", "long": b"n\n" + b"1\n" * 9,
    "names": b"a,a,\n1,2,3\n4,5,6", "text": b"name,country\nAcme,US\nGlobex,DE",
    "ragged_header": b"a,b,c\n1,2\n3,4\n5,6", "inner": b'a,b\n1,x\n3,5" pipe\n4,y\n',
    "mixed_ends": b"id,name\n1,a\r\n2,b\n", "quoted_end": b'id,name\r\n1,"x\ny"\r\n2,z\r\n',
}
SCHEMA = ("tenant_id string, project_id string, dataset_version_id string, filename string, "
          "length long, content binary")


@pytest.fixture(scope="module")
def ingested(spark):
    data = [("t", "p", k, f"{k}.csv", len(v), bytearray(v)) for k, v in FILES.items()]
    data += [("t", "p", "book", "b.XLSX", 2, bytearray(b"PK")),
             ("t", "p", "big", "big.csv", 10**9, None)]
    return delimited.ingest(spark.createDataFrame(data, SCHEMA), max_bytes=50 << 20, max_rows=8)


def of(df, version, *cols):
    return [tuple(r) for r in df.where(F.col("dataset_version_id") == version).select(*cols).collect()]


def test_runs(ingested):
    runs = {r["dataset_version_id"]: r for r in ingested.runs.collect()}
    assert len(runs) == len(FILES) + 2
    m = runs["messy"]
    assert (m["detected_encoding"], m["detected_delimiter"], m["has_header"]) == (
        "windows-1252", ";", True)
    assert (m["row_count"], m["accepted_row_count"], m["rejected_row_count"]) == (5, 4, 1)
    assert runs["headerless"]["has_header"] is False
    assert runs["text"]["has_header"] is True
    failed = {k for k, r in runs.items() if r["status"] == "failed"}
    assert failed == {"book", "big", "long"}
    assert runs["long"]["row_count"] == 9 and "limit 8" in runs["long"]["error_message"]


def test_failed_files_leave_nothing(ingested):
    for df in (ingested.rows, ingested.rejected, ingested.columns):
        assert not {r[0] for r in df.select("dataset_version_id").distinct().collect()} & {
            "book", "big", "long"}


@pytest.mark.parametrize("name,raw", [
    ("stray", '1,2"3'), ("after", '1,"2"3\n'), ("open", '1,"23\n'), ("inner", '3,5" pipe')])
def test_a_bad_quote_rejects_its_record(ingested, name, raw):
    assert of(ingested.rejected, name, "raw_content", "reason") == [(raw, "Quotes are not well formed")]
    assert len(of(ingested.rows, name, "fields")) == (2 if name == "inner" else 0)


def test_the_first_line_end_is_the_only_one(ingested):
    assert of(ingested.rows, "mixed_ends", "fields") == [(["1", "a\r"],), (["2", "b"],)]
    assert of(ingested.rows, "quoted_end", "fields") == [(["1", "x\ny"],), (["2", "z"],)]


def test_no_limit_unless_set(spark):
    data = [("t", "p", "long", "long.csv", 20 << 30, bytearray(b"n\n" + b"1\n" * 300_000))]
    assert delimited.ingest(spark.createDataFrame(data, SCHEMA)).rows.count() == 300_000


def test_reports_of_versions_stay(ingested, spark, tmp_path):
    path = str(tmp_path / "rejected")
    for version in ("ragged", "stray", "ragged"):
        delimited.write_rejected(
            ingested.rejected.where(F.col("dataset_version_id") == version), path)
    lines = spark.read.csv(path, header=True, escape='"')
    assert sorted(r["dataset_version_id"] for r in lines.collect()) == ["ragged", "ragged", "stray"]


def test_rows(ingested):
    assert of(ingested.rows, "messy", "fields")[1][0][1] == "Globex Straße GmbH €"
    assert [n for n, in of(ingested.rows, "messy", "row_number")] == [1, 2, 3, 4]
    assert of(ingested.rows, "quoted", "fields") == [
        (["Acme, Inc.", "Springfield"],), (['Globex\r\nLLC "x"', "Shelbyville"],)]


def test_rejected(ingested):
    assert of(ingested.rejected, "ragged", "row_number", "raw_content", "reason") == [
        (4, "3,BadRow", "Expected 3 field(s), found 2"),
        (5, "4,Initech,US,EXTRA", "Expected 3 field(s), found 4")]
    # A ragged header is rejected like any row, so the next record is tested as header.
    assert of(ingested.rejected, "ragged_header", "row_number") == [(1,)]
    lines = of(delimited.rejected_report(ingested.rejected), "ragged", "line")
    assert lines[0] == ('4,"Expected 3 field(s), found 2"'.replace('"', "") + ',"3,BadRow"',) or (
        lines[0][0].startswith("4,"))


def test_columns_and_types(ingested):
    names = of(ingested.columns, "names", "column_name")
    assert names == [("a",), ("a",), ("column_3",)]
    assert of(ingested.columns, "headerless", "column_name") == [("column_1",), ("column_2",)]
    facts = column_facts(value_counts(ingested.rows))
    types = dict(of(facts, "messy", "col_idx", "inferred_type"))
    assert [types[i] for i in range(5)] == ["integer", "string", "date", "decimal", "boolean"]


@pytest.mark.parametrize("text,expected", [
    ("id;name;country\n1;Acme Corp;US\n2;Globex;DE\n3;Initech;US\n", ";"),
    ("id,name,country\n1,Acme Corp,US\n2,Globex,DE\n", ","),
    ("id\tname\n1\tAcme\n", "\t"), ("id|name\n1|Acme\n", "|"), ("id\n1\n2\n3\n", ","), ("", ","),
    ("a;b,c\n1;2,3\n", ","),
])
def test_delimiter(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(delimited.detect_delimiter(F.col("t"))).first()[0] == expected


def test_read_files_skips_content_of_large_ones(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "b.csv").write_bytes(b"x" * 500)
    got = {r["filename"]: r["content"] for r in delimited.read_files(
        spark, str(tmp_path), 100).collect()}
    assert got == {"a.csv": bytearray(b"a,b\n1,2\n"), "b.csv": None}


def test_landing_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "raw")
    files = spark.createDataFrame(
        [("t", "a b.csv", bytearray(b"1")), ("t", "a b.csv", bytearray(b"1")),
         ("t", "c.csv", bytearray(b"1"))], "tenant_id string, filename string, content binary")
    for _ in range(2):
        landing.land(files, path)
    keys = [r["storage_key"] for r in spark.read.parquet(path).collect()]
    assert len(keys) == 2 and any(k.endswith("-a_b.csv") for k in keys)


def test_stream(spark, tmp_path):
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    (inbox / "vendors").mkdir(parents=True)

    def run():
        landing_stream(
            spark, str(inbox), out, str(tmp_path / "check"), "t", "p"
        ).awaitTermination()

    (inbox / "vendors" / "one.csv").write_bytes(FILES["ragged"])
    (inbox / "vendors" / "bad.xlsx").write_bytes(b"PK")
    run()
    known = spark.read.parquet(f"{out}/dataset_versions")
    assert known.select("dataset_name", "version_number").collect() == [("vendors", 1)]
    assert sorted(r["status"] for r in landing.read_versions(spark, f"{out}/ingestion_runs").collect()) == [
        "completed", "failed"]
    (inbox / "vendors" / "two.csv").write_bytes(FILES["messy"])
    run()
    run()
    known = spark.read.parquet(f"{out}/dataset_versions")
    assert sorted(r["version_number"] for r in known.collect()) == [1, 2]
    profiles = landing.read_versions(spark, f"{out}/dataset_profiles")
    assert sorted(r["row_count"] for r in profiles.collect()) == [3, 4]
    assert landing.read_versions(spark, f"{out}/rejected_rows").count() == 3


TABLES = ["ingestion_runs", "dataset_profiles", "field_profiles", "anomalies", "rejected_rows",
          "audit_events"]


def contents(spark, out):
    tables = {t: landing.read_versions(spark, f"{out}/{t}") for t in TABLES}
    tables |= {t: spark.read.parquet(f"{out}/{t}") for t in ("raw", "dataset_versions")}
    return {t: sorted(map(repr, df.select(sorted(df.columns)).collect())) for t, df in tables.items()}


def test_a_lost_or_repeated_batch_leaves_the_same(spark, tmp_path, monkeypatch):
    inbox = tmp_path / "inbox" / "vendors"
    inbox.mkdir(parents=True)
    (inbox / "one.csv").write_bytes(FILES["ragged"])
    (inbox / "none.csv").write_bytes(b"\n\n")
    (inbox / "bad.xlsx").write_bytes(b"PK")
    (inbox / "large.csv").write_bytes(b"a,b\n" * 100)
    files = spark.read.format("binaryFile").load(str(inbox))

    def batch(out):
        stream.process_batch(files, out, "t", "p", max_bytes=300)

    once, twice = str(tmp_path / "once"), str(tmp_path / "twice")
    batch(once)
    want = contents(spark, once)
    status = {r["filename"]: r["status"] for r in landing.read_versions(
        spark, f"{once}/ingestion_runs").collect()}
    assert status == {
        "one.csv": "completed", "none.csv": "completed", "bad.xlsx": "failed", "large.csv": "failed"}
    assert len(want["dataset_profiles"]) == 2  # one of them without columns
    batch(twice)
    batch(twice)
    assert contents(spark, twice) == want
    for owner, step in ((landing, "land"), (stream, "write_profiled"), (landing, "replace_versions"),
                        (stream.V, "register")):
        lost, inner = str(tmp_path / f"lost-{step}"), getattr(owner, step)

        def fail(*a, inner=inner, **k):
            inner(*a, **k)
            raise RuntimeError("executor lost")

        monkeypatch.setattr(owner, step, fail)
        with pytest.raises(RuntimeError):
            batch(lost)
        monkeypatch.setattr(owner, step, inner)
        batch(lost)
        assert contents(spark, lost) == want


def test_faults_are_not_missing_tables(spark, tmp_path):
    assert not landing._exists(spark, str(tmp_path / "nothing"))
    (tmp_path / "t").mkdir()
    assert not landing._exists(spark, str(tmp_path / "t"))
    (tmp_path / "t" / "x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        landing._exists(spark, str(tmp_path / "t"))


def test_records_are_written_once_and_wide_files_keep_their_columns(spark):
    width = 400
    wide = "\n".join(",".join(f"{'n' if r == 0 else r}{c}" for c in range(width)) for r in range(22))
    files = spark.createDataFrame(
        [("t", "p", "wide", "wide.csv", len(wide), wide.encode())], SCHEMA)
    parsed = delimited.parse(files)
    arrays = [f.name for f in parsed.schema if f.dataType.typeName() == "array"]
    assert arrays == ["records"]
    done = delimited.ingest(files)
    assert done.runs.first()["has_header"] and done.rows.count() == 21
    assert [r["column_name"] for r in done.columns.orderBy("col_idx").collect()] == [
        f"n{c}" for c in range(width)]
