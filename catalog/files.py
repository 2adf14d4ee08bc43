"""Ingestion of delimited files: texts of the driver tables, each taken as one file."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.datasets import BLANKS, CLASS, read, spread
from fairledger.operators.cells import value_counts
from fairledger.functions.text import js_trim
from fairledger.operators.profile import column_facts
from fairledger.plans.staging import folder, stage
from fairledger.scope import VERSION
from fairledger.sources import delimited, landing, ranges
from fairledger.streaming import landing as stream

#: Bounds of the one query that shows them; all others read everything.
MAX_ROWS, MAX_BYTES = 60, 20_000
MARK = "case c_nationkey % 4 when 0 then ',' when 1 then ';' when 2 then chr(9) else '|' end"
# A small file per customer: four dialects, ragged lines, quoted fields, some without header.
MADE = """concat(
 case when c_custkey % 6 = 0 then '' else concat('id', d, ' name ', d, d, 'open', chr(10)) end,
 k, d, '"', c_name, d, chr(10), ' Ltd"', d, b, d, 'yes', chr(13), chr(10),
 case when c_custkey % 5 = 0 then concat(k, d, 'short', chr(10)) else '' end, chr(10),
 k, d, 'Stra', chr(case when c_nationkey = 7 then 223 else 115 end), 'e', d, b, d, 'no', chr(10),
 case when c_custkey % 7 = 0 then concat(k, d, '"said ""x"" ', d, '"', d, b, d, 'n', d, chr(10))
   else '' end,
 case when c_custkey % 31 = 0 then concat(k, d, 'a "stray" quote', d, b, d, 'n') else k end)"""


def _made(text_type: str) -> str:
    return (
        f"select concat('cust-', cast(c_custkey as {text_type})) as id, {MADE} as text, c_nationkey "
        f"from (select *, {MARK} as d, cast(c_custkey as {text_type}) as k, "
        f"cast(cast(c_acctbal as decimal(18,2)) as {text_type}) as b from customer)"
    )


def files(spark, sf) -> DataFrame:
    read(spark, sf, "customer").createOrReplaceTempView("customer")
    made = spark.sql(_made("string"))
    parts = [
        made.select("id", "text", F.when(
            F.col("c_nationkey") == 7, F.encode("text", "ISO-8859-1")
        ).otherwise(F.encode("text", "UTF-8")).alias("content")),
        *[
            read(spark, sf, t).select(
                F.concat(F.lit(p), F.col(k).cast("string")).alias("id"),
                F.col(c).alias("text"), F.encode(c, "UTF-8").alias("content"),
            )
            for t, p, k, c in (
                ("documents", "doc-", "doc_id", "text"), ("pages", "page-", "page_id", "html"),
            )
        ],
    ]
    return spread(reduce(DataFrame.unionByName, parts), "id").select(
        F.lit("acme").alias("tenant_id"), F.lit("inbox").alias("project_id"),
        F.col("id").alias("dataset_version_id"), F.concat("id", F.lit(".csv")).alias("filename"),
        F.length("content").cast("long").alias("length"), "content", "text",
    )


def _ingested(spark, sf):
    return delimited.ingest(files(spark, sf).drop("text"))


def delimiter_detect(spark, sf):
    return files(spark, sf).select(
        "dataset_version_id", delimited.detect_delimiter(F.col("text")).alias("delimiter")
    )


def charset_decode(spark, sf):
    f = files(spark, sf).withColumn("encoding", delimited.encoding_of(F.col("content")))
    return f.select(
        "dataset_version_id", "encoding",
        F.md5(delimited.decode(F.col("content"), F.col("encoding"))).alias("text_md5"),
    )


def ingestion_runs(spark, sf):
    return _ingested(spark, sf).runs.select(
        "dataset_version_id", "status", "detected_encoding", "detected_delimiter", "has_header",
        "row_count", "accepted_row_count", "rejected_row_count", "error_message",
    )


NAMED = """concat(dataset_version_id, case right(dataset_version_id, 1) when '0' then '.xlsx'
  when '1' then '.XLS' when '2' then '.xlsx.csv' else '.csv' end)"""


def ingestion_guards(spark, sf):
    """Runs under a bound of rows and bytes, with some files named as workbooks."""
    named = files(spark, sf).drop("text").withColumn("filename", F.expr(NAMED))
    runs = delimited.ingest(named, MAX_BYTES, MAX_ROWS).runs
    return runs.select(
        "dataset_version_id", "filename", "status", "source_format", "detected_encoding",
        "row_count", "accepted_row_count", "error_message")


def ragged_rows(spark, sf):
    return _ingested(spark, sf).rejected.select(
        "dataset_version_id", "row_number", "raw_content", "reason"
    )


def ingested_rows(spark, sf):
    return _ingested(spark, sf).rows.select(
        "dataset_version_id", "row_number", F.array_join("fields", "\n").alias("fields")
    )


def header_columns(spark, sf):
    return _ingested(spark, sf).columns.select("dataset_version_id", "col_idx", "column_name")


def ingested_types(spark, sf):
    facts = column_facts(value_counts(_ingested(spark, sf).rows))
    return facts.select("dataset_version_id", "col_idx", "row_count", "inferred_type")


def rejected_report(spark, sf):
    return delimited.rejected_report(_ingested(spark, sf).rejected).select(
        "dataset_version_id", "row_number", "line"
    )


def checksum_landing(spark, sf):
    docs = read(spark, sf, "documents").select(
        F.lit("acme").alias("tenant_id"), F.concat("source", F.lit(" /x.txt")).alias("filename"),
        F.encode("text", "UTF-8").alias("content"), "lang",
    )
    landed = landing.keyed(docs.where("lang = 'en'"))
    return landing.new_files(docs, stage(landed.select("storage_key"))).select(
        "storage_key", "checksum", F.length("content").cast("long").alias("bytes")
    )


def landing_stream(spark, sf):
    """One file per nation's suppliers, landed, versioned and profiled by the stream."""
    base = f"{folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    suppliers = read(spark, sf, "supplier").withColumn("nation", F.col("s_nationkey"))
    suppliers.repartition("nation").write.partitionBy("nation").csv(f"{base}/inbox", header=True)
    stream.landing_stream(
        spark, f"{base}/inbox", f"{base}/out", f"{base}/checkpoint", "acme", "inbox"
    ).awaitTermination()
    known = spark.read.parquet(f"{base}/out/dataset_versions")
    profiles = landing.read_versions(spark, f"{base}/out/dataset_profiles")
    return known.join(profiles, ["tenant_id", "project_id", "dataset_version_id"]).select(
        "dataset_name", "version_number", "row_count", "column_count"
    )


def ranged_rows(spark, sf):
    """Documents written as files of quoted texts, line ends and all, and cut into records in ranges."""
    path = f"{folder(spark)}/large-{uuid.uuid4().hex}"
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    read(spark, sf, "documents").select(
        F.concat_ws(",", F.concat(F.lit("d"), "doc_id"), quoted)).write.text(path)
    large = ranges.listed(spark, f"{path}/part-*").select(
        F.lit("acme").alias("tenant_id"), F.lit("inbox").alias("project_id"),
        F.col("filename").alias("dataset_version_id"), "path",
        F.concat("filename", F.lit(".csv")).alias("filename"), "length")
    # both columns are texts, so the first record counts as a header: it names its columns
    done = ranges.ingest(large)
    named = done.columns.groupBy(*VERSION).agg(
        F.array_sort(F.collect_list(F.struct("col_idx", "column_name")))["column_name"].alias("fields"))
    return done.rows.select("fields").unionByName(named.select("fields")).select(
        F.col("fields")[0].alias("id"), F.md5(js_trim(F.col("fields")[1])).alias("text_md5"))


QUERIES = {f.__name__: f for f in (
    ranged_rows,
    delimiter_detect, charset_decode, ingestion_runs, ingestion_guards, ragged_rows, ingested_rows, header_columns,
    ingested_types, rejected_report, checksum_landing, landing_stream,
)}

NL = "'\\r\\n|\\n|\\r'"
ID = "dataset_version_id"
BASE = f"""with made as ({_made('varchar')}),
files as (select id as {ID}, text, c_nationkey = 7 as latin from made
  union all select concat('doc-', cast(doc_id as varchar)), text, false from documents
  union all select concat('page-', cast(page_id as varchar)), html, false from pages),
all_lines as (select {ID}, unnest(regexp_split_to_array(text, {NL})) as line,
  generate_subscripts(regexp_split_to_array(text, {NL}), 1) as seq from files),
lines as (select *, row_number() over (partition by {ID} order by seq) as nth from all_lines
  where trim(line, {BLANKS}) <> '' qualify nth <= 20),
marks as (select * from (values (0, ','), (1, ';'), (2, chr(9)), (3, '|')) x(ord, d)),
widths as (select {ID}, ord, d, length(line) - length(replace(line, d, '')) + 1 as w,
  count(*) as n, min(nth) as first from lines, marks group by all),
modes as (select *, sum(n) over (partition by {ID}, ord) as total from widths
  qualify row_number() over (partition by {ID}, ord order by n desc, first) = 1),
best as (select * from modes where w > 1 qualify row_number() over (partition by {ID}
  order by n / total * w desc, ord) = 1),
dialect as (select {ID}, text, latin, coalesce(b.d, ',') as d from files left join best b
  using ({ID})),
"""
STRAY = "concat('([^\\r\\n\"', d, '])\"([^\\r\\n\"', d, '])')"
PARSED = BASE + f"""cleaned as materialized (select {ID}, d, regexp_replace(regexp_replace(text, {STRAY},
  concat('\\1', chr(64978), '\\2'), 'g'), {STRAY}, concat('\\1', chr(64978), '\\2'), 'g') as text
  from dialect),
pieces as (select {ID}, d, unnest(string_split(text, '"')) as piece,
  generate_subscripts(string_split(text, '"'), 1) as seq from cleaned),
ends as (select {ID}, regexp_extract(piece, '(\\r\\n|\\n|\\r)', 1) as nl from pieces
  where seq % 2 = 1 and regexp_matches(piece, {NL})
  qualify row_number() over (partition by {ID} order by seq) = 1),
joined as (select {ID}, d, string_agg(case when seq % 2 = 1 then
  replace(replace(piece, coalesce(nl, chr(10)), chr(64976)), d, chr(64977)) else piece end, '"'
  order by seq) as marked from pieces left join ends using ({ID}) group by all),
cut as (select {ID}, d, unnest(string_split(marked, chr(64976))) as r,
  generate_subscripts(string_split(marked, chr(64976)), 1) as seq from joined),
split as materialized (select {ID}, d, r, row_number() over (partition by {ID} order by seq) as nth,
  length(r) - length(replace(r, chr(64977), '')) + 1 as w from cut where r <> ''),
raw_fields as materialized (select {ID}, nth, unnest(string_split(r, chr(64977))) as f,
  generate_subscripts(string_split(r, chr(64977)), 1) as col from split),
broken as (select distinct {ID}, nth from raw_fields where contains(f, chr(64978))
  or contains(f, '"') and not regexp_full_match(f, '(?s)"([^"]|"")*"')),
records as materialized (select s.*, b.nth is not null as bad from split s left join broken b
  using ({ID}, nth)),
common as (select {ID}, w as width from (select {ID}, w, count(*) as n, min(nth) as first
  from records where not bad group by all) qualify row_number() over (partition by {ID}
  order by n desc, first) = 1),
good as (select {ID}, row_number() over (partition by {ID} order by nth) as pos, nth
  from records join common using ({ID}) where w = width and not bad),
fields as materialized (select {ID}, pos, col,
  case when f[1] = '"' then replace(f[2:-2], '""', '"') else f end
  as f from raw_fields join good using ({ID}, nth)),
typed as (select *, {CLASS} as class from (select *, trim(f, {BLANKS}) as v from fields)),
below as (select {ID}, col, count(*) as n,
  count(*) filter (where class = 'integer') as i, count(*) filter (where class = 'decimal') as dc,
  count(*) filter (where class = 'boolean') as bo, count(*) filter (where class = 'date') as da
  from typed where pos between 2 and 21 and f <> '' and v <> '' group by all),
signal as (select {ID}, col, case when i * 2 > n then 'integer' when dc * 2 > n then 'decimal'
  when bo * 2 > n then 'boolean' when da * 2 > n then 'date' end as type from below),
votes as (select {ID}, count(*) as n, count(*) filter (where t.class <> type) as differ
  from signal join typed t using ({ID}, col) where type is not null and pos = 1 group by all),
sizes as (select {ID}, count(*) as records from records group by all),
fits as (select {ID}, count(*) as fit from good group by all),
judged as materialized (select *, records - cast(header as int) as total from (
  select {ID}, latin, d, coalesce(records, 0) as records, coalesce(fit, 0) as fit,
  width, case when coalesce(fit, 0) = 0 then false when fit < 2 then true
  else coalesce(differ * 2 >= n, true) end as header
  from dialect left join sizes using ({ID}) left join fits using ({ID})
  left join common using ({ID}) left join votes using ({ID}))),
rows as (select {ID}, pos - cast(header as int) as row_number, col, f from fields
  join judged using ({ID}) where pos > cast(header as int)),
rejected as (select {ID}, nth as row_number,
  replace(replace(r, chr(64977), k.d), chr(64978), '"') as raw_content,
  case when bad then 'Quotes are not well formed' else
  'Expected ' || width || ' field(s), found ' || w end as reason
  from records join judged k using ({ID}) where bad or w <> width)
"""

ORACLES = {
    "ranged_rows": "select concat('d', doc_id) as id, md5(regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g')) "
    "as text_md5 from documents",
    "landing_stream": "select 'nation=' || s_nationkey as dataset_name, cast(1 as bigint) as "
    "version_number, count(*) as row_count, cast(4 as bigint) as column_count from supplier "
    "group by s_nationkey",
    "delimiter_detect": BASE.rstrip().rstrip(",") + f" select {ID}, d as delimiter from dialect",
    "charset_decode": BASE.rstrip().rstrip(",") + f" select {ID}, case when latin then "
    "'windows-1252' else 'UTF-8' end as encoding, md5(text) as text_md5 from dialect",
    "ingestion_runs": PARSED + f"""select {ID}, 'completed' as status,
  case when latin then 'windows-1252' else 'UTF-8' end as detected_encoding,
  d as detected_delimiter, header as has_header, cast(total as integer) as row_count,
  cast(fit - cast(header as int) as integer) as accepted_row_count,
  cast(records - fit as integer) as rejected_row_count,
  cast(null as varchar) as error_message from judged""",
    "ingestion_guards": PARSED + f"""select {ID}, filename,
  case when error is null then 'completed' else 'failed' end as status,
  case when book then 'xlsx' else 'csv' end as source_format,
  case when not book and not big then case when latin then 'windows-1252' else 'UTF-8' end end
    as detected_encoding,
  case when not book and not big then cast(total as integer) end as row_count,
  case when error is null then cast(fit - cast(header as int) as integer) end as accepted_row_count,
  error as error_message
  from (select *, case when big then 'File is larger than {MAX_BYTES} bytes'
    when book then 'Workbooks are not read' when total > {MAX_ROWS}
    then 'File has ' || total || ' rows, limit {MAX_ROWS}' end as error
    from (select *, {NAMED} as filename, right({ID}, 1) in ('0', '1') as book,
      case when latin then length(text) else strlen(text) end > {MAX_BYTES} as big
      from judged join (select {ID}, text from dialect) using ({ID})))""",
    "ragged_rows": PARSED + "select * from rejected",
    "ingested_rows": PARSED + f"select {ID}, row_number, string_agg(f, chr(10) order by col) "
    "as fields from rows group by all",
    "header_columns": PARSED + f"select {ID}, cast(col - 1 as integer) as col_idx, "
    "case when header and v <> '' then v else 'column_' || col end as column_name "
    f"from typed join judged using ({ID}) where pos = 1",
    "ingested_types": PARSED + f""", marked as (select *, {CLASS} as class from (select *,
  trim(f, {BLANKS}) as v from rows)) select {ID}, cast(col - 1 as integer) as col_idx,
  count(*) as row_count, coalesce(
  case when count(*) filter (where v <> '' and class = 'integer') * 2 >
    count(*) filter (where v <> '') then 'integer'
  when count(*) filter (where v <> '' and class = 'decimal') * 2 >
    count(*) filter (where v <> '') then 'decimal'
  when count(*) filter (where v <> '' and class = 'boolean') * 2 >
    count(*) filter (where v <> '') then 'boolean'
  when count(*) filter (where v <> '' and class = 'date') * 2 >
    count(*) filter (where v <> '') then 'date' end, 'string') as inferred_type
  from marked group by all""",
    "rejected_report": PARSED + f"""select {ID}, row_number, row_number || ',' ||
  case when contains(reason, ',') then '"' || reason || '"' else reason end || ',' ||
  case when regexp_matches(raw_content, '[",\\n]') then
    '"' || replace(raw_content, '"', '""') || '"' else raw_content end as line from rejected""",
    "checksum_landing": """with k as (select 'acme/' || sha256(text) || '-' ||
  regexp_replace(source || ' /x.txt', '[^a-zA-Z0-9._-]', '_', 'g') as storage_key,
  sha256(text) as checksum, cast(strlen(text) as bigint) as bytes, lang from documents)
  select distinct storage_key, checksum, bytes from k
  where storage_key not in (select storage_key from k where lang = 'en')""",
}
