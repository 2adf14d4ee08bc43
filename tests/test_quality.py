"""Profiles, anomalies, semantic types."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairledger.functions import fixed as K
from fairledger.functions.text import conforms_strictly
from fairledger.operators import anomalies, profile, quantiles, semantics
from fairledger.operators import cells as cells_module
from fairledger.operators.cells import has, marked, spread, value_counts
from fairledger.plans import jobs
from fairledger.sources import landing


def profiled(make_rows, make_columns, names, data):
    fields = profile.profile(make_rows(data), make_columns(names)).collect()
    return {r["column_name"]: r for r in fields}


def test_profile_dimensions(make_rows, make_columns):
    f = profiled(make_rows, make_columns, ["supplier_id", "name", "signup_date"], [
        ("1", "Acme Corp", "2024-01-15"), ("2", "  Globex  ", "2024-03-02"),
        ("3", "Initech", "03/02/2024"), ("4", "BadCo", ""),
    ])
    assert f["name"]["conformity"] == 0.75
    d = f["signup_date"]
    assert (d["completeness"], d["validity"]) == (0.75, 1.0)
    assert d["conformity"] == pytest.approx(2 / 3)
    assert all(r["conformity"] <= r["validity"] for r in f.values())


@pytest.mark.parametrize("values,column,expected", [
    (["1", "007", "42", "099"], "conformity", 0.5),
    (["true", "false", "yes", "no"], "conformity", 0.5),
    (["2024-01-15", "2024-03-02", "1/5/2024", "2023-11-30"], "consistency", 0.75),
    (["US", "US", "US", "DE"], "uniqueness", 0.5),
    (["US", "US", "US", "DE"], "quality_score", 1.0),
    (["", " ", ""], "quality_score", 0.75),
    (["1", "abc", "2.5", "hello"], "inferred_type", "string"),
    (["true", "false", "true", "yes"], "inferred_type", "boolean"),
    (["1", "2.5"], "inferred_type", "string"),
])
def test_one_column(make_rows, make_columns, values, column, expected):
    f = profiled(make_rows, make_columns, ["c"], [(v,) for v in values])
    assert f["c"][column] == expected


def test_zero_rows(spark, make_rows, make_columns):
    cols = make_columns(["a", "b"])
    fields = profile.profile(make_rows([]), cols)
    r = fields.first()
    assert (r["completeness"], r["validity"], r["conformity"], r["consistency"]) == (1, 1, 1, 1)
    assert r["uniqueness"] == 0
    versions = cols.select("tenant_id", "project_id", "dataset_version_id").distinct()
    assert profile.dataset_profiles(versions, fields).first()["overall_quality_score"] == 1


def found(make_rows, make_columns, names, data):
    rows, columns = make_rows(data), make_columns(names)
    return anomalies.detect(rows, anomalies.column_stats(rows, columns)).collect()


ANOMALY_ROWS = [
    ("1", "EMEA", "100.00", "ok"), ("2", "APAC", "150.00", "ok"), ("3", "EMEA", "120.00", "ok"),
    ("4", "APAC", "N/A", "ok"), ("5", "EMEA", "130.00", ""), ("6", "APAC", "not-a-number", "ok"),
    ("7", "EMEA", "9999999.00", "ok"), ("8", "APAC", "140.00", "ok"),
]
ANOMALY_COLUMNS = ["supplier_id", "region", "credit_limit", "notes"]


def test_all_kinds_of_anomaly(make_rows, make_columns):
    got = {(a["row_number"], a["column_name"], a["anomaly_type"]) for a in found(
        make_rows, make_columns, ANOMALY_COLUMNS, ANOMALY_ROWS)}
    assert {
        (5, "notes", "null"), (6, "credit_limit", "malformed_value"),
        (7, "credit_limit", "outlier"), (4, "credit_limit", "suspicious_pattern"),
    } <= got


def test_broadcast_and_shuffled_stats_agree(spark, make_rows, make_columns):
    rows, columns = make_rows(ANOMALY_ROWS), make_columns(ANOMALY_COLUMNS)
    stats = anomalies.column_stats(rows, columns)
    few = anomalies.cell_anomalies(rows, stats).collect()
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    many = anomalies.cell_anomalies(rows, stats).collect()
    spark.conf.set(limit, before)
    assert sorted(map(str, few)) == sorted(map(str, many)) and few


@pytest.mark.parametrize("values,check,rows", [
    (list("abcdef") + ["", "g"], "null", [7]),
    (["a", "", "", "b", "", "", "", "c"], "null", []),
    (["30", "10", "1000", "20", "40", "41"], "outlier", [3]),
    (["1", "2", "1000"], "outlier", []),
    (["AB-123", "CD-456", "EF-789", "GH-012", "XY"], "shape", [5]),
    (["abc", "abc-1", "abc-1-x", "abc.1"], "shape", []),
    (["Acme", "N/A", "Globex", "Initech"], "sentinel", [2]),
    (["Acme", "N/A", "Globex", "Initech"], "malformed", []),
])
def test_single_checks(make_rows, make_columns, values, check, rows):
    got = found(make_rows, make_columns, ["c"], [(v,) for v in values])
    assert sorted(a["row_number"] for a in got if a["check"] == check) == rows


def test_duplicate_rows(make_rows):
    data = [("1", "Acme"), ("2", "Globex"), ("1", "Acme"), ("1", "23"), ("12", "3"), ("1", "Acme")]
    got = anomalies.duplicate_rows(make_rows(data)).collect()
    assert sorted((r["row_number"], r["first_row"]) for r in got) == [(3, 1), (6, 1)]
    same_joined = [("a\u0001", "b"), ("a", "\u0001b")]
    assert anomalies.duplicate_rows(make_rows(same_joined)).count() == 0


def test_clean_table_has_no_anomalies(make_rows, make_columns):
    data = [("1", "Alpha"), ("2", "Bravo"), ("3", "Gamma"), ("4", "Delta")]
    assert found(make_rows, make_columns, ["id", "category"], data) == []


def test_type_filter(spark, make_rows, make_columns):
    rows = make_rows(ANOMALY_ROWS)
    all_ = anomalies.detect(rows, anomalies.column_stats(rows, make_columns(ANOMALY_COLUMNS)))
    assert [a["row_number"] for a in anomalies.of_type(all_, "outlier").collect()] == [7]
    with pytest.raises(ValueError):
        anomalies.of_type(all_, "odd")


@pytest.mark.parametrize("bits", [12, 2])
@pytest.mark.parametrize("n", [1, 4, 5, 1001, 30_000])
def test_quartiles_are_exact(spark, monkeypatch, bits, n):
    monkeypatch.setattr(quantiles, "BITS", bits)
    rng = np.random.default_rng(n)
    values = np.round(rng.lognormal(3, 2, n), 2)
    values[: n // 3] = 7.25  # one value holds a third of all rows
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, x double")
    got = quantiles.quartiles(df, ["k"]).first()
    want = np.quantile(values, [0.25, 0.75])
    assert (got["q1"], got["q3"]) == pytest.approx(tuple(want))


def test_quartiles_of_odd_numbers(spark):
    x = [-1e308, 1e308, -5e-324, 5e-324, 0.0, -0.0, 1.0, -1.0, 2.0**-1022, 3.5]
    rows = [("k", v, 2) for v in x] + [("k", None, 9), ("none", None, 1), ("one", -3.0, 1)]
    df = spark.createDataFrame(rows, "k string, x double, w int")
    got = {r["k"]: r for r in quantiles.quartiles(df, ["k"], weight="w").collect()}
    assert set(got) == {"k", "one"} and got["one"]["q1"] == got["one"]["q3"] == -3
    want = np.quantile(np.repeat(x, 2), [0.25, 0.75])
    assert (got["k"]["n"], got["k"]["q1"], got["k"]["q3"]) == (20, *want)


def test_pattern_is_the_bits_of_a_double(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(0, 200, 500), 2.0 ** np.arange(-1074, 1024), [0.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = [r.b for r in df.select(quantiles.pattern(F.col("x")).alias("b")).collect()]
    assert got == x.view(np.int64).tolist()


def test_no_text_is_shuffled_for_a_profile(make_rows, make_columns):
    rows, columns = make_rows(ANOMALY_ROWS), make_columns(ANOMALY_COLUMNS)
    plan = profile.profile(rows, columns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 3
    for line in (x for x in plan.splitlines() if "Aggregate [" in x):
        keys = line.split("Aggregate [")[1].split("]")[0]
        assert not {"value", "raw", "shape"} & {k.split("#")[0].strip() for k in keys.split(",")}


SEMANTIC = [
    ("email", "a@x.com b@y.com c@z.com", "email"),
    ("billing_email", "ap@acme.com billing@globex.com finance@initech.com", "email"),
    ("site", "https://acme.example https://globex.example", "url"),
    ("homepage_url", "http://a.com http://b.com http://c.com", "url"),
    ("currency", "USD EUR USD GBP", "currency_code"),
    ("invoice_currency", "JPY CNY INR JPY", "currency_code"),
    ("country_code", "US CA MX US", "country_code"),
    ("supplier_country", "DE FR IT DE", "country_code"),
    ("phone_number", "+1_212-555-0180 212-555-0181 (212)_555-0182", "phone_number"),
    ("fax", "+44_20_7946_0958 +44_20_7946_0959", "phone_number"),
    ("tax_rate", "7.5 8.25 0.5 10.0", "percentage"),
    ("discount_percent", "5 10 15", "percentage"),
    ("unit_price", "19.99 5.00 120.00", "currency_amount"),
    ("total_spend", "150000.00 98000.50", "currency_amount"),
    ("supplier_id", "101 102 103", "identifier"),
    ("po_number", "PO-1001 PO-1002", "identifier"),
    ("postal_code", "94105 10001 02139", "postal_code"),
    ("zip", "94105 10001", "postal_code"),
    ("vendor_name", "Acme_Corp Globex_Inc", "organization_name"),
    ("company", "Wayne_Enterprises Stark_Industries", "organization_name"),
    ("first_name", "Alice Bob Carol", "person_name"),
    ("employee_name", "Dana_White Evan_Black", "person_name"),
    ("street_address", "1_Infinite_Loop 500_5th_Ave", "address_line"),
    ("vat_id", "GB123456789 IE9876543A", "tax_id"),
    ("status", "open closed pending", None),
    ("quantity", "1 2 3", None),
    ("description", "widget_A gadget_B", None),
    ("category", "hardware software", None),
]


def test_semantic_golden_set(spark, make_rows, make_columns):
    rows, columns = None, None
    for i, (name, values, _) in enumerate(SEMANTIC):
        r = make_rows([(v.replace("_", " "),) for v in values.split()], f"v{i}")
        c = make_columns([name], f"v{i}")
        rows = r if rows is None else rows.unionByName(r)
        columns = c if columns is None else columns.unionByName(c)
    typed = semantics.infer(columns, profile.column_facts(value_counts(rows))).collect()
    got = {int(r["dataset_version_id"][1:]): r["semantic_type"] for r in typed}
    assert [got[i] for i in range(len(SEMANTIC))] == [e for _, _, e in SEMANTIC]


def test_queue_shows_shapes_only(make_rows, make_columns):
    rows = make_rows([("open",), ("on-hold",), ("x.1",), ("closed",)])
    counts = value_counts(rows)
    typed = semantics.infer(make_columns(["status"]), profile.column_facts(counts))
    queue = semantics.review_queue(typed, semantics.shape_samples(rows, counts)).collect()
    assert [list(q["sample_shapes"]) for q in queue] == [["A", "A-A", "A.A"]]


def test_project_score(spark):
    df = spark.createDataFrame(
        [("t", "p", 0.5), ("t", "p", 1.0), ("t", "p", None), ("t", "q", None)],
        "tenant_id string, project_id string, overall_quality_score double",
    )
    got = {r["project_id"]: r for r in profile.project_scores(df).collect()}
    assert (got["p"]["dataset_count"], got["p"]["profiled_dataset_count"]) == (3, 2)
    assert got["p"]["overall_quality_score"] == 0.75
    assert got["q"]["overall_quality_score"] is None


def test_profile_job_replaces_results(spark, make_rows, make_columns, tmp_path):
    folder = str(tmp_path)
    columns = make_columns(ANOMALY_COLUMNS)
    dirty = jobs.profile_job(make_rows(ANOMALY_ROWS), columns)
    for _ in range(2):  # running twice must not double anything
        jobs.write_profiled(dirty, folder)
    kept = landing.read_versions(spark, f"{folder}/anomalies")
    assert kept.count() == dirty.anomalies.count() > 0
    clean = jobs.profile_job(make_rows([("1", "EMEA", "1.00", "ok")]), columns)
    jobs.write_profiled(clean, folder)
    assert landing.read_versions(spark, f"{folder}/anomalies").count() == 0
    assert landing.read_versions(spark, f"{folder}/field_profiles").count() == 4
    assert landing.read_versions(spark, f"{folder}/audit_events").count() == 1


def test_result_does_not_depend_on_partitions(make_rows, make_columns):
    columns = make_columns(ANOMALY_COLUMNS)
    one = profile.profile(make_rows(ANOMALY_ROWS).coalesce(1), columns)
    many = profile.profile(make_rows(ANOMALY_ROWS).repartition(7), columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_versions_of_other_tenants_stay_apart(make_rows, make_columns):
    rows = make_rows([("a",), ("a",)], tenant="t1").unionByName(make_rows([("a",)], tenant="t2"))
    assert anomalies.duplicate_rows(rows).select("tenant_id").collect() == [("t1",)]
    counts = value_counts(rows).collect()
    assert sorted((c["tenant_id"], c["n"]) for c in counts) == [("t1", 2), ("t2", 1)]


def test_a_file_of_many_pieces_and_one_row_group_is_spread(spark, tmp_path):
    n, cores = 20_000, spark.sparkContext.defaultParallelism
    path = tmp_path / "one.parquet"
    spark.range(n).coalesce(1).write.parquet(str(path))
    size = sum(f.stat().st_size for f in path.glob("*.parquet"))
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(c) for c in names]
    try:
        spark.conf.set(names[0], str(size // (2 * cores)))
        spark.conf.set(names[1], "1")
        df = spark.read.parquet(str(path))
        assert df.rdd.getNumPartitions() >= cores
        held = [len(p) for p in spread(df, "id").rdd.glom().collect()]
        even = spread(df, "id")
        assert spread(even, "id") is even
    finally:
        for c, v in zip(names, old):
            spark.conf.set(c, v)
    assert sum(held) == n and max(held) * cores <= 2 * n
    assert spread(spark.range(0), "id").count() == 0


def test_forms_are_told_without_patterns(spark):
    """Strict forms and phones of numbers and dates, as by the patterns, which are not run for them."""
    values = ["0", "-0", "007", "-7", "1234567", "-12345678", "1.5", "-1.50", "12345.67", "2024-01-15",
              "2024-01-15T10:20", "11/12/2024", "1/2/1998", "true", "NO", "%", "5 %", "n/a", "555-1234 9"]
    cell = marked(spark.createDataFrame([(v,) for v in values], "raw string"))
    plan = cell._jdf.queryExecution().optimizedPlan().toString()
    assert not any(p in plan for p in (K.STRICT_INTEGER, K.STRICT_DECIMAL, K.STRICT_DATE))
    got = cell.select("value", has("strict").alias("s"), conforms_strictly(F.col("raw"), F.col("class")).alias("w"),
                      "class", has("m_phone").alias("p")).collect()
    assert all(r.s == r.w for r in got if r["class"] != "string")
    assert {r.value for r in got if r.p} == {
        "1234567", "-12345678", "12345.67", "2024-01-15", "555-1234 9"}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_cells_are_merged_before_they_are_marked(spark, make_rows, monkeypatch):
    data = [("12", " a@b.c "), ("12", "a@b.c"), ("12", " "), (None, " "), ("x1 " * 40, "é"), ("7", "é", "more"), ()]
    rows = reduce(lambda a, b: a.unionByName(b), [make_rows(data, version=f"v{k}") for k in range(3)])
    key = ["dataset_version_id", "col_idx", "raw"]

    def summed(cell):
        return sorted(cell.groupBy(*key).agg(F.sum("n"), F.min("row_number")).collect(), key=repr)

    want = summed(cells_module.cells(rows).withColumn("n", F.lit(1)))
    merged = cells_module.merged_cells(rows.coalesce(1))
    assert summed(merged) == want and merged.count() == len(want) == 27
    assert "MapInArrow" in plan_of(value_counts(rows))
    got = {(r["dataset_version_id"], r["col_idx"], r["first_row"]): (r["n"], r["n_untouched"])
           for r in value_counts(rows).collect()}
    assert got["v1", 0, 1] == (3, 3) and got["v1", 0, 4] == (1, 0)
    assert got["v2", 1, 1] == (2, 1) and got["v2", 1, 3] == (2, 0) and len(got) == 24
    assert value_counts(make_rows([])).count() == 0 and value_counts(make_rows([(), ()])).count() == 0


def test_named_and_joined_lookups_agree(make_rows, monkeypatch):
    rows = make_rows([("y" * 70, "a-b"), ("z1 q",  "?"), ("7", "a-b-c")])
    shapes = sorted(semantics.shape_samples(rows, value_counts(rows)).collect())
    monkeypatch.setattr(cells_module, "NAMED", 1)
    assert sorted(semantics.shape_samples(rows, value_counts(rows)).collect()) == shapes and len(shapes) == 5


def test_checks_read_their_columns_only(make_rows, make_columns, monkeypatch):
    read = []
    cells_with = anomalies._cells_with_stats
    monkeypatch.setattr(anomalies, "_cells_with_stats", lambda rows, stats: read.append(
        {r["column_name"] for r in stats.collect()}) or cells_with(rows, stats))
    rows, columns = make_rows(ANOMALY_ROWS), make_columns(ANOMALY_COLUMNS)
    stats = anomalies.column_stats(rows, columns)
    got = anomalies.cell_anomalies(rows, stats, ["null"]).collect()
    assert [(a["row_number"], a["column_name"]) for a in got] == [(5, "notes")] and read == [{"notes"}]


def test_large_pieces_are_cut(spark, monkeypatch):
    table = spark.range(0, 1000, numPartitions=8)
    assert spread(table, "id").rdd.getNumPartitions() == 8
    monkeypatch.setattr(cells_module, "PIECE_ROWS", 50, raising=False)
    assert spread(table, "id").rdd.getNumPartitions() == 20


def test_duplicates_are_hashed_before_they_are_digested(make_rows):
    data = [(str(k), "x") for k in range(50)] + [("7", "x"), ("7", "x"), (None, "x"), ("", "x"), (None, "x")]
    found = anomalies.duplicate_rows(make_rows(data))
    assert sorted((r["row_number"], r["first_row"]) for r in found.collect()) == [(51, 8), (52, 8), (55, 53)]
    # digests are made of rows that share a hash, and written: none is made again to cite the first
    assert "sha2" not in plan_of(found)
