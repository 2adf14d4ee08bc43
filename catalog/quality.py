"""Profiles, scores, anomalies and semantic types of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import datasets as D
from fairledger.operators import anomalies, profile, review, semantics
from fairledger.operators.cells import cells, value_counts
from fairledger.plans import jobs
from fairledger.plans.staging import stage
from fairledger.scope import COLUMN, VERSION

DIMENSIONS = [
    "completeness", "uniqueness", "validity", "conformity", "consistency", "quality_score"
]


def _rounded(names):
    return [F.round(c, 6).alias(c) for c in names]


def cells_melt(spark, sf):
    return cells(D.rows(spark, sf)).select(
        "dataset_version_id", "row_number", "col_idx", "raw"
    )


def classify_votes(spark, sf):
    facts = profile.column_votes(D.rows(spark, sf))
    return facts.select(
        *COLUMN, "filled", *[f"n_{t}" for t in
                             ("integer", "decimal", "boolean", "date", "string")]
    )


def majority_type(spark, sf):
    return profile.column_votes(D.rows(spark, sf)).select(*COLUMN, "inferred_type")


def field_profile(spark, sf):
    fields = profile.profile(D.rows(spark, sf), D.columns(spark))
    return fields.select(
        *COLUMN, "column_name", "inferred_type", "row_count", "null_count", "distinct_count",
        *_rounded(DIMENSIONS),
    )


def fields_by_name(spark, sf):
    fields = profile.profile(D.rows(spark, sf), D.columns(spark))
    return profile.fields_by_name(fields).select(
        *VERSION, "column_name", "inferred_type", *_rounded(["quality_score"])
    )


def dataset_profile(spark, sf):
    fields = profile.profile(D.rows(spark, sf), D.columns(spark))
    return profile.dataset_profiles(D.versions(spark), fields).select(
        *VERSION, "row_count", "column_count", *_rounded(["overall_quality_score"])
    )


def _anomaly(*checks):
    def query(spark, sf):
        rows = D.rows(spark, sf)
        stats = anomalies.column_stats(
            rows, D.columns(spark), with_fences="outlier" in checks, with_shapes="shape" in checks)
        return anomalies.cell_anomalies(rows, stats, list(checks)).select(
            "dataset_version_id", "row_number", "col_idx", "column_name", "anomaly_type", "value"
        )
    return query


def quartile_fences(spark, sf):
    counts = stage(value_counts(D.rows(spark, sf)))
    found = anomalies.fences(counts, stage(profile.column_facts(counts)))
    return found.select(
        *COLUMN, "n", *_rounded(["q1", "q3", "lower_fence", "upper_fence"])
    )


def dominant_shape(spark, sf):
    rows = D.rows(spark, sf)
    return anomalies.dominant_shapes(rows, profile.column_facts(value_counts(rows))).select(*COLUMN, "dominant_shape", *_rounded(["share"]))


# Two rounds of answers about columns; some are unknown labels, and one round is later.
ANSWERS = """select {v}, cast(col_idx as int) as col_idx, case col_idx % 4 when 0 then 'email'
  when 1 then 'unknown' when 2 then 'nonsense' else 'identifier' end as semantic_type,
  0.8D as confidence, 'first' as reasoning, 'm1' as model_version,
  timestamp '2024-01-01 00:00:00' as answered_at from columns
  union all select {v}, cast(col_idx as int), 'percentage', 0.6D, 'second', 'm2',
  timestamp '2024-01-02 00:00:00' from columns where col_idx % 3 = 0"""


def column_opinions(spark, sf):
    """What second opinions say of columns, one for each."""
    D.columns(spark).createOrReplaceTempView("columns")
    answers = spark.sql(ANSWERS.format(v=", ".join(VERSION)))
    return review.column_opinions(answers).select(
        *COLUMN, "ai_semantic_type", "ai_confidence", "ai_model_version")


def duplicate_row(spark, sf):
    return anomalies.duplicate_rows(D.rows(spark, sf))


def _all(spark, sf):
    rows = D.rows(spark, sf)
    return anomalies.detect(rows, anomalies.column_stats(rows, D.columns(spark)))


def anomaly_union(spark, sf):
    return _all(spark, sf).select(
        "dataset_version_id", "row_number", "column_name", "anomaly_type", "check"
    )


def anomaly_filter(spark, sf):
    return anomalies.of_type(_all(spark, sf), "suspicious_pattern").select(
        "dataset_version_id", "row_number", "column_name", "value"
    )


def anomaly_count(spark, sf):
    return anomalies.counts(_all(spark, sf))


def semantic_type(spark, sf):
    return semantics.infer(D.columns(spark), profile.column_votes(D.rows(spark, sf))).select(
        *COLUMN, "column_name", "inferred_type", "semantic_type"
    )


def shape_sample(spark, sf):
    rows = D.rows(spark, sf)
    return semantics.shape_samples(rows, value_counts(rows)).select(
        "dataset_version_id", "col_idx", "ordinal", "shape"
    )


def column_queue(spark, sf):
    rows = D.rows(spark, sf)
    counts = stage(value_counts(rows))
    typed = semantics.infer(D.columns(spark), profile.column_facts(counts))
    return semantics.review_queue(typed, semantics.shape_samples(rows, counts)).select(
        "dataset_version_id", "col_idx", "column_name", "inferred_type",
        F.array_join("sample_shapes", "\n").alias("sample_shapes"),
    )


def profile_job(spark, sf):
    done = jobs.profile_job(D.rows(spark, sf), D.columns(spark))
    return done.fields.select(
        *COLUMN, "inferred_type", "semantic_type", *_rounded(["quality_score"])
    )


QUERIES = {
    "profile_job": profile_job,
    "cells_melt": cells_melt,
    "classify_votes": classify_votes,
    "majority_type": majority_type,
    "field_profile": field_profile,
    "fields_by_name": fields_by_name,
    "dataset_profile": dataset_profile,
    "quartile_fences": quartile_fences,
    "dominant_shape": dominant_shape,
    "null_anomaly": _anomaly("null"),
    "sentinel_anomaly": _anomaly("sentinel"),
    "malformed_value": _anomaly("malformed"),
    "iqr_outlier": _anomaly("outlier"),
    "shape_break": _anomaly("shape"),
    "duplicate_row": duplicate_row,
    "anomaly_union": anomaly_union,
    "column_opinions": column_opinions,
    "anomaly_filter": anomaly_filter,
    "anomaly_count": anomaly_count,
    "semantic_type": semantic_type,
    "shape_sample": shape_sample,
    "column_queue": column_queue,
}

V = D.VERSION
KEY = "col_idx"
CITED = """select dataset_version_id, row_number, col_idx, column_name,
 '{kind}' as anomaly_type, {value} as value from cited where {rule}"""
CITED_CTE = D.CTES + f""", numbers as materialized (select {V}, col_idx, count(x) as n,
  quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3
  from marked join types using ({V}, col_idx)
  where inferred_type in ('integer', 'decimal') and x is not null group by all),
fences as materialized (select *, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence
  from numbers where n >= 4 and q3 > q1),
dominance as materialized (select {V}, col_idx, dominant, shape_n / filled as share
  from top_shape join types using ({V}, col_idx)
  where filled >= 4 and shape_n / filled >= 0.6 and shape_n < filled),
cited as (select m.*, c.column_name, t.inferred_type, t.filled / t.total as completeness,
  d.dominant, f.lower_fence, f.upper_fence
  from marked m join columns c using ({V}, col_idx) join types t using ({V}, col_idx)
  left join dominance d using ({V}, col_idx) left join fences f using ({V}, col_idx)),
firsts as (select {V}, fields, min(row_number) as first_row from rows group by all
  having count(*) > 1),
dups as (select {V}, row_number, first_row from rows join firsts using ({V}, fields)
  where row_number > first_row)
"""
SENTINELS = "('n/a','na','null','none','unknown','tbd','-','--','???','#n/a')"
RULES = {
    "null": ("null", "cast(null as varchar)", "v = '' and completeness >= 0.8 and completeness < 1"),
    "sentinel": ("suspicious_pattern", "raw", f"lower(v) in {SENTINELS}"),
    "malformed": ("malformed_value", "raw", "v <> '' and class <> inferred_type"),
    "outlier": ("outlier", "v", "v <> '' and (x < lower_fence or x > upper_fence)"),
    "shape": ("suspicious_pattern", "v", "v <> '' and shape <> dominant"),
}


def _cited(check: str) -> str:
    kind, value, rule = RULES[check]
    return CITED_CTE + CITED.format(kind=kind, value=value, rule=rule)


def _against(table: str, check: str) -> str:
    """The cells of only those columns that have a row in `table`."""
    kind, value, rule = RULES[check]
    return CITED_CTE + (
        f"select dataset_version_id, row_number, col_idx, column_name, '{kind}' as anomaly_type, "
        f"{value} as value from marked join {table} using ({V}, col_idx) "
        f"join columns using ({V}, col_idx) where {rule}")


UNION = " union all ".join(
    f"select {V}, row_number, column_name, '{kind}' as anomaly_type, '{check}' as \"check\", "
    f"{value} as value from cited where {rule}"
    for check, (kind, value, rule) in RULES.items()
) + (
    f" union all select {V}, row_number, '*', 'suspicious_pattern', 'duplicate', null from dups"
)


def _mostly(rule: str) -> str:
    return f"count(*) filter (where v <> '' and {rule}) / count(*) filter (where v <> '') >= 0.7"


CURRENCY = ("('USD','EUR','GBP','JPY','CNY','INR','AUD','CAD','CHF','SGD','MXN','BRL','ZAR','SEK',"
            "'NOK','DKK','AED','SAR','KRW','HKD')")
COUNTRY = ("('US','GB','DE','FR','IT','ES','NL','BE','CH','AT','CA','MX','BR','IN','CN','JP','KR',"
           "'AU','SG','ZA','SE','NO','DK','AE','SA')")
SEMANTIC = D.CTES + f""", flags as (select {V}, col_idx, count(*) filter (where v <> '') as f,
  {_mostly("regexp_full_match(v, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')")} as email,
  {_mostly("regexp_full_match(v, '(?i:https?)://[^\\s]+')")} as url,
  {_mostly("v in " + CURRENCY)} as currency,
  {_mostly("v in " + COUNTRY)} as country,
  {_mostly("regexp_full_match(v, '[+()0-9\\s.-]{7,20}') and "
           "length(regexp_replace(v, '[^0-9]', '', 'g')) >= 7")} as phone,
  {_mostly("try_cast(trim(regexp_replace(v, '%', '')) as double) between 0 and 100")} as pct
  from marked group by all),
semantic as (select {V}, col_idx, column_name, inferred_type, filled, case when f = 0 then null
  when email then 'email' when url then 'url' when currency then 'currency_code'
  when column_name like '%country%' and country then 'country_code'
  when regexp_matches(column_name, 'phone|tel(ephone)?|fax|mobile') and phone
    then 'phone_number'
  when regexp_matches(column_name, 'percent|_rate$|^rate$') and pct
    and inferred_type in ('integer', 'decimal') then 'percentage'
  when regexp_matches(column_name, 'zip|postal') and inferred_type in ('string', 'integer')
    then 'postal_code'
  when regexp_matches(column_name,
    'amount|price|cost|total|balance|credit_limit|revenue|spend|value')
    and inferred_type in ('integer', 'decimal') then 'currency_amount'
  when regexp_matches(column_name, 'tax_?id|vat_?(number|id)?|ein\\b') then 'tax_id'
  when regexp_matches(column_name, '(^|_)(id|code|number|no)($|_)') then 'identifier'
  when regexp_matches(column_name,
    'company|corp|organization|org_name|supplier_name|vendor_name|business_name')
    and inferred_type = 'string' then 'organization_name'
  when regexp_matches(column_name,
    'contact_name|person_name|first_name|last_name|full_name|employee_name')
    and inferred_type = 'string' then 'person_name'
  when regexp_matches(column_name, 'address|street|addr_line') and inferred_type = 'string'
    then 'address_line' end as semantic_type
  from columns join types using ({V}, col_idx) join flags using ({V}, col_idx)),
first_shapes as (select {V}, col_idx, shape, min(row_number) as first_row from marked
  where v <> '' group by all),
samples as (select *, row_number() over (partition by {V}, col_idx order by first_row, shape)
  as ordinal from first_shapes qualify ordinal <= 12)
"""
DIMS = ", ".join(f"round({c}, 6) as {c}" for c in DIMENSIONS)

ORACLES = {
    "profile_job": SEMANTIC + f"select {V}, col_idx, inferred_type, semantic_type, "
    f"round(quality_score, 6) as quality_score from scored join (select {V}, col_idx, "
    f"semantic_type from semantic) using ({V}, col_idx)",
    "cells_melt": D.CTES + "select dataset_version_id, row_number, cast(col_idx as integer) "
    "as col_idx, raw from cells",
    "classify_votes": D.CTES + f"select {V}, cast(col_idx as integer) as col_idx, filled, "
    "n_integer, n_decimal, n_boolean, n_date, n_string from votes",
    "majority_type": D.CTES + f"select {V}, cast(col_idx as integer) as col_idx, inferred_type "
    "from types",
    "field_profile": D.CTES + f"select {V}, col_idx, column_name, inferred_type, row_count, "
    f"null_count, distinct_count, {DIMS} from scored",
    "fields_by_name": D.CTES + f"select {V}, column_name, inferred_type, "
    "round(quality_score, 6) as quality_score from scored order by all",
    "dataset_profile": D.CTES + f"select {V}, max(row_count) as row_count, count(*) as "
    "column_count, round(avg(quality_score), 6) as overall_quality_score from scored group by all",
    "quartile_fences": CITED_CTE + f"select {V}, cast(col_idx as integer) as col_idx, n, "
    "round(q1, 6) as q1, round(q3, 6) as q3, round(lower_fence, 6) as lower_fence, "
    "round(upper_fence, 6) as upper_fence from fences",
    "dominant_shape": CITED_CTE + f"select {V}, cast(col_idx as integer) as col_idx, dominant as "
    "dominant_shape, round(share, 6) as share from dominance",
    "null_anomaly": _cited("null"),
    "sentinel_anomaly": _cited("sentinel"),
    "malformed_value": _cited("malformed"),
    "iqr_outlier": _against("fences", "outlier"),
    "shape_break": _against("dominance", "shape"),
    "duplicate_row": CITED_CTE + f"select {V}, row_number, first_row from dups",
    "anomaly_union": CITED_CTE + "select dataset_version_id, row_number, column_name, "
    f"anomaly_type, \"check\" from ({UNION})",
    "column_opinions": D.CTES + f"""select {V}, cast(col_idx as int) as col_idx,
  case when col_idx % 3 = 0 then 'percentage' when col_idx % 4 = 0 then 'email'
    when col_idx % 4 = 3 then 'identifier' end as ai_semantic_type,
  case when col_idx % 3 = 0 then 0.6::double when col_idx % 4 in (0, 3) then 0.8::double end
    as ai_confidence,
  case when col_idx % 3 = 0 then 'm2' when col_idx % 4 in (0, 3) then 'm1' end as ai_model_version
  from columns""",
    "anomaly_filter": CITED_CTE + "select dataset_version_id, row_number, column_name, value "
    f"from ({UNION}) where anomaly_type = 'suspicious_pattern'",
    "anomaly_count": CITED_CTE + f"select {V}, count(*) as anomaly_count from ({UNION}) "
    "group by all",
    "semantic_type": SEMANTIC + f"select {V}, col_idx, column_name, inferred_type, semantic_type "
    "from semantic",
    "shape_sample": SEMANTIC + "select dataset_version_id, cast(col_idx as integer) as col_idx, "
    "cast(ordinal as integer) as ordinal, shape from samples",
    "column_queue": SEMANTIC + "select dataset_version_id, col_idx, column_name, inferred_type, "
    "string_agg(shape, chr(10) order by ordinal) as sample_shapes "
    f"from semantic join samples using ({V}, col_idx) "
    "where semantic_type is null and filled > 0 group by all",
}
