"""The driver tables as profiled datasets, written once as SQL text for both engines.

The tables are clean, so some cells are spoilt by a fixed rule on the key; every row is kept.
`{text}` is the engine's text type and `{day:x}` its ISO date of x.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairledger.operators.cells import columns_from_table, spread

MONEY = "cast(cast({0} as decimal(18,2)) as {{text}})"


def _plain(c: str) -> str:
    return f"coalesce(cast({c} as {{text}}), '')"


# (tenant, project, version, table, row number, [(column, expression)])
DATASETS = [
    ("acme", "sales", "orders-v1", "orders", "o_orderkey + 1", [
        ("order_id", _plain("o_orderkey")),
        ("customer_id",
         "case when o_orderkey % 53 = 0 then '  ' else cast(o_custkey as {text}) end"),
        ("status", "case when o_orderkey % 97 = 0 then 'N/A' else o_orderstatus end"),
        ("total_price",
         "case when o_orderkey % 101 = 0 then 'not-a-number' when o_orderkey % 211 = 0 then "
         "cast(cast(o_totalprice * 1000 as decimal(18,2)) as {text}) else "
         + MONEY.format("o_totalprice") + " end"),
        ("order_date",
         "case when o_orderkey % 89 = 0 then '1/2/1998' else {day:o_orderdate} end"),
        ("priority",
         "case when o_orderkey % 71 = 0 then concat('  ', o_orderpriority, ' ') "
         "else o_orderpriority end"),
    ]),
    ("acme", "sales", "customer-v1", "customer", "c_custkey + 1", [
        ("customer_number", _plain("c_custkey")),
        ("company", "c_name"),
        ("country_code",
         "case when c_nationkey % 3 = 0 then 'US' when c_nationkey % 3 = 1 then 'DE' else 'FR' end"
         ),
        ("balance", MONEY.format("c_acctbal")),
        ("tax_rate",
         "case when c_custkey % 5 = 0 then concat(cast(c_custkey % 30 as {text}), '%') "
         "else cast(c_custkey % 30 as {text}) end"),
        ("contact_email",
         "case when c_custkey % 4 = 3 then '' else "
         "concat('ap', cast(c_custkey as {text}), '@example.org') end"),
        ("fax", "concat('+1 212-555-', cast(1000 + c_custkey % 9000 as {text}))"),
        ("segment", "lower(c_mktsegment)"),
        ("remarks", "''"),
    ]),
    ("acme", "shipping", "lineitem-v1", "lineitem", "l_orderkey * 10 + l_linenumber", [
        ("order_id", _plain("l_orderkey")), ("part_id", _plain("l_partkey")),
        ("supplier_id", _plain("l_suppkey")), ("line", _plain("l_linenumber")),
        ("quantity", MONEY.format("l_quantity")), ("price", MONEY.format("l_extendedprice")),
        ("discount", MONEY.format("l_discount")), ("tax", MONEY.format("l_tax")),
        ("return_flag", "l_returnflag"), ("line_status", "l_linestatus"),
        ("ship_date", "{day:l_shipdate}"),
    ]),
    ("globex", "catalogue", "part-v1", "part", "p_partkey + 1", [
        ("name", "p_name"), ("brand", "p_brand"), ("kind", "p_type"),
    ]),
    ("globex", "catalogue", "supplier-v1", "supplier", "s_suppkey + 1", [
        ("supplier_id", _plain("s_suppkey")), ("supplier_name", "s_name"),
        ("nation", _plain("s_nationkey")), ("credit_limit", MONEY.format("s_acctbal")),
        ("currency",
         "case when s_nationkey % 10 = 0 then 'XXX' when s_nationkey % 2 = 0 then 'EUR' "
         "else 'USD' end"),
    ]),
    ("globex", "activity", "events-v1", "events", "event_id + 1", [
        ("event_no", _plain("event_id")), ("day", "{day:ts}"), ("user_no", _plain("user_id")),
        ("kind", "event_type"), ("measure", MONEY.format("value")),
    ]),
    ("globex", "texts", "documents-v1", "documents", "doc_id + 1", [
        ("doc", _plain("doc_id")), ("body", _plain("text")), ("lang", "lang"),
        ("source", "source"), ("chars", _plain("n_chars")),
    ]),
    ("globex", "texts", "pages-v1", "pages", "page_id + 1", [
        ("page", _plain("page_id")), ("link", "url"),
    ]),
    ("globex", "texts", "conversations-v1", "conversations", "conv_id * 1000 + turn + 1", [
        ("conversation", _plain("conv_id")), ("turn", _plain("turn")), ("role", "role"),
        ("message", _plain("text")),
    ]),
]


def _sql(expr: str, spark: bool) -> str:
    day = r"date_format(\1, 'yyyy-MM-dd')" if spark else r"strftime(\1, '%Y-%m-%d')"
    expr = re.sub(r"\{day:(\w+)\}", day, expr)
    return expr.replace("{text}", "string" if spark else "varchar")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for tenant, project, version, table, number, cols in DATASETS:
        fields = ", ".join(_sql(e, True) for _, e in cols)
        key = re.search(r"[a-z_]{3,}", number)[0]  # rows that share it share values
        parts.append(spread(read(spark, sf_dir, table), key).select(
            F.lit(tenant).alias("tenant_id"), F.lit(project).alias("project_id"),
            F.lit(version).alias("dataset_version_id"),
            F.expr(f"cast({number} as bigint)").alias("row_number"),
            F.expr(f"array({fields})").alias("fields"),
        ))
    return reduce(DataFrame.unionByName, parts)


def columns(spark: SparkSession) -> DataFrame:
    parts = [
        columns_from_table(spark.range(0), t, p, v, [name for name, _ in cols])
        for t, p, v, _, _, cols in DATASETS
    ]
    return reduce(DataFrame.unionByName, parts)


def versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(t, p, v) for t, p, v, *_ in DATASETS],
        "tenant_id string, project_id string, dataset_version_id string",
    )


def _rows_sql() -> str:
    return " union all ".join(
        f"select '{t}' as tenant_id, '{p}' as project_id, '{v}' as dataset_version_id, "
        f"cast({number} as bigint) as row_number, "
        f"[{', '.join(_sql(e, False) for _, e in cols)}] as fields from {table}"
        for t, p, v, table, number, cols in DATASETS
    )


def _columns_sql() -> str:
    values = ", ".join(
        f"('{t}', '{p}', '{v}', {i}, '{name}')"
        for t, p, v, _, _, cols in DATASETS for i, (name, _) in enumerate(cols)
    )
    return (
        "select * from (values " + values + ") x(tenant_id, project_id, dataset_version_id, "
        "col_idx, column_name)"
    )


BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(160), chr(65279))"
CLASS = """case when lower(v) in ('true','false','yes','no','y','n') then 'boolean'
 when regexp_full_match(v, '-?[0-9]+') then 'integer'
 when regexp_full_match(v, '-?[0-9]+\\.[0-9]+') then 'decimal'
 when regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}(:[0-9]{2})?)?')
   or regexp_full_match(v, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') then 'date'
 else 'string' end"""
SHAPE = "regexp_replace(regexp_replace(v, '[0-9]+', 'D', 'g'), '[A-Za-z]+', 'A', 'g')"
NUMBER = """case when regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
 then try_cast(v as double) end"""
VERSION = "tenant_id, project_id, dataset_version_id"

# Common table expressions every SQL check of this subject starts with.
CTES = f"""with rows as ({_rows_sql()}),
columns as ({_columns_sql()}),
cells as (select {VERSION}, row_number, unnest(fields) as raw,
  generate_subscripts(fields, 1) - 1 as col_idx from rows),
trimmed as (select *, trim(raw, {BLANKS}) as v from cells),
marked as materialized (select *, {CLASS} as class, {SHAPE} as shape, {NUMBER} as x from trimmed),
votes as (select {VERSION}, col_idx, count(*) as total,
  count(*) filter (where v <> '') as filled,
  count(*) filter (where v <> '' and class = 'integer') as n_integer,
  count(*) filter (where v <> '' and class = 'decimal') as n_decimal,
  count(*) filter (where v <> '' and class = 'boolean') as n_boolean,
  count(*) filter (where v <> '' and class = 'date') as n_date,
  count(*) filter (where v <> '' and class = 'string') as n_string
  from marked group by all),
types as materialized (select *, case when n_integer > filled / 2 then 'integer'
  when n_decimal > filled / 2 then 'decimal' when n_boolean > filled / 2 then 'boolean'
  when n_date > filled / 2 then 'date' else 'string' end as inferred_type from votes),
shapes as (select {VERSION}, col_idx, shape, count(*) as shape_n from marked
  where v <> '' group by all),
top_shape as materialized (select {VERSION}, col_idx, max(shape_n) as shape_n,
  max_by(shape, (shape_n, shape)) as dominant from shapes group by all),
fields as (select {VERSION}, col_idx, column_name, inferred_type, total as row_count,
  total - filled as null_count,
  (select count(distinct v) from marked m where m.v <> '' and m.dataset_version_id =
    t.dataset_version_id and m.col_idx = t.col_idx) as distinct_count,
  case when total = 0 then 1.0 else filled / total end as completeness,
  case when filled = 0 then 1.0 else (case inferred_type when 'integer' then n_integer
    when 'decimal' then n_decimal when 'boolean' then n_boolean when 'date' then n_date
    else n_string end) / filled end as validity,
  case when filled = 0 then 1.0 else (select count(*) from marked m where m.v <> ''
    and m.dataset_version_id = t.dataset_version_id and m.col_idx = t.col_idx
    and m.class = t.inferred_type and case t.inferred_type
      when 'integer' then regexp_full_match(m.v, '-?[1-9][0-9]*|0')
      when 'decimal' then regexp_full_match(m.v, '-?[0-9]+\\.[0-9]{{2}}')
      when 'date' then regexp_full_match(m.v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
      when 'boolean' then lower(m.v) in ('true', 'false')
      else m.raw = m.v end) / filled end as conformity,
  case when filled = 0 then 1.0 else shape_n / filled end as consistency, filled
  from types t join columns using ({VERSION}, col_idx)
  left join top_shape using ({VERSION}, col_idx)),
scored as (select *, case when filled = 0 then 0.0 else distinct_count / filled end as uniqueness,
  (completeness + validity + conformity + consistency) / 4 as quality_score from fields)
"""
