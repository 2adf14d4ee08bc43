"""Partners, identifiers, matches, decisions, suppliers and versions made of the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.datasets import _sql, read, spread
from fairledger.functions import text as T
from fairledger.operators import (
    audit, decisions, matching, partners, profile, review, rowrules, suppliers, versions,
)
from fairledger.plans import jobs
from fairledger.plans.staging import stage
from fairledger.scope import for_tenant

# name -> [(table, {column: expression valid in both engines})]
INPUTS: dict[str, list[tuple[str, dict[str, str]]]] = {
    "partners": [
        ("pages", {
            "tenant_id": "'acme'", "project_id": "'web'",
            "id": "concat('web-', cast(page_id as {text}))", "primary_name": "url",
        }),
        ("part", {
            "tenant_id": "'globex'", "project_id": "'parts'",
            "id": "concat('part-', cast(p_partkey as {text}))",
            "primary_name": "concat(p_name, ' ', p_brand)",
        }),
    ],
    "addresses": [
        ("pages", {
            "tenant_id": "'acme'", "id": "concat('a1-', cast(page_id as {text}))",
            "business_partner_id": "concat('web-', cast(page_id as {text}))",
            "line1": "cast(null as {text})", "city": "split_part(url, '/', 3)",
            "region": "'north'", "postal_code": "cast(null as {text})",
            "country_code": "split_part(url, '/', 4)",
            "is_primary": "page_id % 2 = 0", "created_at": "cast('2024-01-02' as date)",
        }),
        ("pages", {
            "tenant_id": "'acme'", "id": "concat('a2-', cast(page_id as {text}))",
            "business_partner_id": "concat('web-', cast(page_id as {text}))",
            "line1": "split_part(url, '/', 5)", "city": "split_part(url, '/', 3)",
            "region": "cast(null as {text})", "postal_code": "cast(page_id % 100 as {text})",
            "country_code": "split_part(url, '/', 4)",
            "is_primary": "page_id % 3 = 0", "created_at": "cast('2024-01-01' as date)",
        }),
        ("part", {
            "tenant_id": "'globex'", "id": "concat('a-', cast(p_partkey as {text}))",
            "business_partner_id": "concat('part-', cast(p_partkey as {text}))",
            "line1": "case when p_size % 7 = 0 then null else p_type end",
            "city": "case when p_size % 7 = 0 then null else p_brand end",
            "region": "cast(null as {text})",
            "postal_code": "case when p_size % 7 = 0 then null else cast(p_size as {text}) end",
            "country_code": "cast(null as {text})",
            "is_primary": "p_size % 2 = 0", "created_at": "cast('2024-01-01' as date)",
        }),
    ],
    "identifiers": [
        ("part", {
            "tenant_id": "'globex'",
            "id": "concat('i-', cast(p_partkey as {text}))",
            "business_partner_id": "concat('part-', cast(p_partkey as {text}))",
            "identifier_type": "case when p_size < 45 then 'duns' else 'gtin' end",
            "identifier_value": "concat(case when p_partkey % 3 = 0 then lower(p_brand) "
            "else p_brand end, case when p_partkey % 3 = 0 then '-' when p_partkey % 3 = 1 "
            "then ' / ' else '.' end, cast(p_size as {text}))",
            "created_at": "cast('2024-01-01' as date)",
        }),
        ("pages", {
            "tenant_id": "'acme'", "id": "concat('j-', cast(page_id as {text}))",
            "business_partner_id": "concat('web-', cast(page_id as {text}))",
            "identifier_type": "'path'",
            "identifier_value": "concat(split_part(url, '/', 4), '-', split_part(url, '/', 5))",
            "created_at": "cast('2024-01-01' as date)",
        }),
    ],
    "doc_partners": [
        ("documents", {
            "tenant_id": "'acme'", "project_id": "source",
            "id": "concat('doc-', cast(doc_id as {text}))", "primary_name": "text",
        }),
    ],
    "doc_identifiers": [
        ("documents", {
            "tenant_id": "'acme'",
            "business_partner_id": "concat('doc-', cast(doc_id as {text}))",
            "identifier_type": "'checksum'",
            "identifier_value": "case when doc_id % 2 = 0 then md5(text) else "
            "upper(concat(' ', md5(text), '.')) end",
        }),
    ],
    "existing": [
        ("part", {
            "tenant_id": "'globex'", "project_id": "'parts'",
            "business_partner_id": "least(concat('part-', cast(p_partkey as {text})), "
            "concat('part-', cast(p_partkey + 1 as {text})))",
            "candidate_business_partner_id": "greatest(concat('part-', cast(p_partkey as {text})),"
            " concat('part-', cast(p_partkey + 1 as {text})))",
            "match_method": "'fuzzy'", "confidence": "cast(0.6 as double)",
            "decision": "case p_partkey % 4 when 0 then 'needs_review' when 1 then 'merge' "
            "when 2 then 'keep_separate' else 'reject' end",
            "decided_by": "case when p_partkey % 4 = 0 then null else 'u1' end",
            "decided_at": "case when p_partkey % 4 = 0 then null else "
            "cast('2024-02-01' as date) end",
        }),
    ],
    "rulings": [
        ("part", {
            "tenant_id": "'globex'", "project_id": "'parts'",
            "business_partner_id": "least(concat('part-', cast(p_partkey as {text})), "
            "concat('part-', cast(p_partkey + 1 + p_size % 2 as {text})))",
            "candidate_business_partner_id": "greatest(concat('part-', cast(p_partkey as {text})),"
            " concat('part-', cast(p_partkey + 1 + p_size % 2 as {text})))",
            "decision": "case p_size % 5 when 0 then 'merge' when 1 then 'keep_separate' "
            "when 2 then 'reject' when 3 then 'needs_review' else 'maybe' end",
            "user_id": "concat('u', cast(p_size as {text}))",
            "role": "case p_partkey % 3 when 0 then 'STEWARD' when 1 then 'APPROVER' "
            "else 'VIEWER' end",
            "decided_at": "cast('2024-03-01' as date)",
        }),
    ],
    "suppliers": [
        ("lineitem", {
            "tenant_id": "'acme'", "id": "concat(cast(l_orderkey as {text}), '-', "
            "cast(l_linenumber as {text}), '-', cast(l_partkey as {text}), '-', "
            "cast(l_suppkey as {text}), '-', cast(l_extendedprice as decimal(18,2)))",
            "business_partner_id": "concat('s-', cast(l_suppkey as {text}))",
            "supplier_number": "case when l_linenumber = 7 then null else "
            "cast(l_partkey % 50 as {text}) end",
            "source_system": "case when l_quantity > 45 then null when l_quantity > 40 then '' "
            "else concat('sys-', l_returnflag, l_linestatus) end",
            "status": "case when l_quantity < 2 then 'gone' else 'active' end",
            "created_at": "cast(l_shipdate as date)",
        }),
    ],
    "known_suppliers": [
        ("supplier", {
            "tenant_id": "'acme'", "id": "concat('k-', cast(s_suppkey as {text}))",
            "business_partner_id": "concat('s-', cast(s_suppkey as {text}))",
            "supplier_number": "cast(s_suppkey % 50 as {text})", "source_system": "'sys-AF'",
        }),
    ],
    "supplier_partners": [
        ("supplier", {
            "tenant_id": "'acme'", "project_id": "'sourcing'",
            "id": "concat('s-', cast(s_suppkey * 2 as {text}))", "primary_name": "s_name",
            "bp_type": "case when s_nationkey = 3 then 'robot' else 'organization' end",
        }),
    ],
    "relations": [
        ("supplier", {
            "tenant_id": "'acme'", "id": "concat('r-', cast(s_suppkey as {text}))",
            "business_partner_id": "concat('s-', cast(s_suppkey as {text}))",
            "related_business_partner_id":
            "concat('s-', cast(case when s_nationkey % 5 = 0 then s_suppkey "
            "else s_suppkey + s_nationkey end as {text}))",
            "relationship_type": "'parent_of'", "created_at": "cast('2024-01-01' as date)",
        }),
    ],
    "arrivals": [
        ("orders", {
            "tenant_id": "'acme'", "project_id": "o_orderpriority",
            "dataset_name": "concat('file-', cast(o_custkey % 40 as {text}))",
            "dataset_version_id": "concat('v-', cast(o_orderkey as {text}))",
            "arrived_at": "cast(o_orderdate as date)",
        }),
    ],
    "registered": [
        ("nation", {
            "tenant_id": "'acme'", "project_id": "'1-URGENT'",
            "dataset_name": "concat('file-', cast(n_nationkey as {text}))",
            "dataset_version_id": "concat('old-', cast(n_nationkey as {text}))",
            "version_number": "cast(n_regionkey + 1 as bigint)",
        }),
    ],
    "before": [
        ("customer", {
            "tenant_id": "'acme'", "id": "cast(c_custkey as {text})", "name": "c_name",
            "segment": "case when c_custkey % 7 = 0 then 'OTHER' else c_mktsegment end",
        }),
    ],
    "after": [
        ("customer", {
            "tenant_id": "'acme'",
            "id": "cast(case when c_custkey % 11 = 0 then c_custkey + 10000000 else c_custkey "
            "end as {text})", "name": "c_name",
            "segment": "case when c_custkey % 13 = 0 then null else c_mktsegment end",
        }),
    ],
    "answers": [
        ("part", {
            "tenant_id": "'globex'", "project_id": "'parts'",
            "business_partner_id": "least(concat('part-', cast(p_partkey as {text})), "
            "concat('part-', cast(p_partkey + 1 as {text})))",
            "candidate_business_partner_id": "greatest(concat('part-', cast(p_partkey as {text})),"
            " concat('part-', cast(p_partkey + 1 as {text})))",
            "recommendation": "case p_size % 4 when 0 then 'merge' when 1 then 'keep_separate' "
            "when 2 then 'uncertain' else 'no idea' end",
            "confidence": "cast(p_size as double) / 40",
            "reasoning": "case when p_size % 6 = 0 then '' else p_name end",
            "model_version": "'m1'",
        }),
    ],
}


def table(spark, sf, name: str) -> DataFrame:
    parts = []
    for source, cols in INPUTS[name]:
        df = read(spark, sf, source)
        parts.append(df.selectExpr(*[f"{_sql(e, True)} as {c}" for c, e in cols.items()]))
    return reduce(DataFrame.unionByName, parts)


def ctes(*names: str) -> str:
    out = []
    for n in names:
        body = " union all ".join(
            "select " + ", ".join(f"{_sql(e, False)} as {c}" for c, e in cols.items())
            + f" from {source}" for source, cols in INPUTS[n]
        )
        out.append(f"{n} as ({body})")
    return "with " + ", ".join(out)


def _flat(matches: DataFrame) -> DataFrame:
    """Match rows with the evidence as plain text."""
    signal = F.transform(
        "evidence",
        lambda e: F.concat(e["type"], F.lit("="), F.round(e["score"], 4).cast("decimal(6,4)")
                           .cast("string")),
    )
    return matches.select(
        *matching.PAIR, "match_method", "confidence",
        F.array_join(signal, ";").alias("evidence"),
    )


def _three(spark, sf):
    return [table(spark, sf, n) for n in ("partners", "identifiers", "addresses")]


def trigram_similarity(spark, sf):
    return read(spark, sf, "pages").select(
        "page_id", F.round(T.trigram_similarity(
            F.col("url"), F.split_part("url", F.lit("/"), F.lit(3))
        ), 6).alias("similarity"),
    )


def whole_text_similarity(spark, sf):
    # each text is cut once, for both of its neighbours, by all tasks; only its trigrams are joined
    docs = stage(spread(read(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", T.trigram_codes(F.col("text")).alias("items_x")))
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("items_x").alias("items_y"))
    return docs.join(nxt, "doc_id").select("doc_id", F.round(
        T.set_similarity(F.col("items_x"), F.col("items_y")), 6).alias("similarity"))


def name_key(spark, sf):
    return table(spark, sf, "doc_partners").select(
        "id", F.md5(T.name_match_key(F.col("primary_name"))).alias("name_key"),
        F.md5(T.normalize_display_text(F.col("primary_name"))).alias("display"),
    )


def address_key(spark, sf):
    return table(spark, sf, "addresses").select(
        "id", "business_partner_id",
        T.address_match_key(*[F.col(c) for c in ("line1", "city", "postal_code", "country_code")])
        .alias("address_key"),
        T.address_text(*[F.col(c) for c in ("line1", "city", "postal_code", "country_code")])
        .alias("address_text"),
        T.normalize_postal_code(F.col("postal_code")).alias("postal"),
    )


def identifier_key(spark, sf):
    return table(spark, sf, "identifiers").select(
        "id", T.identifier_match_key(F.col("identifier_value")).alias("match_key")
    )


def exact_groups(spark, sf):
    return matching.exact_groups(
        table(spark, sf, "doc_partners"), table(spark, sf, "doc_identifiers")
    ).select(
        "project_id", "match_key", "business_partner_id", "group_size", "leader_id"
    )


def exact_match(spark, sf):
    p, i, _ = _three(spark, sf)
    return _flat(matching.exact_matches(p, i))


def exact_match_documents(spark, sf):
    found = matching.exact_matches(
        table(spark, sf, "doc_partners"), table(spark, sf, "doc_identifiers")
    )
    return _flat(found)


def primary_address(spark, sf):
    return matching.primary_addresses(table(spark, sf, "addresses")).select(
        "tenant_id", "business_partner_id", "address_id", "city", "postal_code"
    )


def fuzzy_match(spark, sf):
    p, _, a = _three(spark, sf)
    return _flat(matching.fuzzy_matches(p, a))


def match_overlay(spark, sf):
    return _flat(matching.all_matches(*_three(spark, sf)))


def class_pairs(spark, sf):
    p, _, a = _three(spark, sf)
    return matching.class_pairs(p, a).select(
        *matching.PAIR, F.round("name_similarity", 6).alias("name_similarity"),
        F.round("address_similarity", 6).alias("address_similarity"), "members", "candidate_members")


def name_brackets(spark, sf):
    p, _, a = _three(spark, sf)
    return matching.name_brackets(p, a).withColumn("name_similarity", F.round("name_similarity", 6))


def ambiguous_pairs(spark, sf):
    p, _, a = _three(spark, sf)
    return _flat(matching.ambiguous(matching.fuzzy_matches(p, a)))


def _exact_and_existing(spark, sf):
    p, i, _ = _three(spark, sf)
    existing = table(spark, sf, "existing").withColumn(
        "evidence", F.array().cast("array<struct<type:string,detail:string,score:double>>")
    )
    return matching.exact_matches(p, i, existing.select(*matching.PAIR)), existing


def pending_pairs(spark, sf):
    return _flat(matching.pending(*_exact_and_existing(spark, sf)))


def match_refresh(spark, sf):
    found, existing = _exact_and_existing(spark, sf)
    opinions = review.pair_opinions(table(spark, sf, "answers"))
    new = matching.refresh(existing, found, opinions)
    return new.select(
        *matching.PAIR, "match_method", "confidence", "decision", "decided_by",
        "ai_recommendation", "ai_confidence",
    )


def match_summary(spark, sf):
    found, existing = _exact_and_existing(spark, sf)
    opinions = review.pair_opinions(table(spark, sf, "answers"))
    return matching.run_summary(found, existing, opinions)


def match_list(spark, sf):
    existing = table(spark, sf, "existing")
    return matching.match_list(existing, table(spark, sf, "partners"), "keep_separate").select(
        *matching.PAIR, "business_partner_name", "candidate_business_partner_name", "decision"
    )


def score_pairs(spark, sf):
    found = matching.score_pairs(table(spark, sf, "existing"), *_three(spark, sf))
    return _flat(found)


QUEUED = [
    *matching.PAIR, "confidence", "primary_name_a", "city_a", "postal_code_a", "primary_name_b",
    "city_b", "country_code_b",
]


def pair_queue(spark, sf):
    p, _, a = _three(spark, sf)
    return review.pair_queue(
        matching.fuzzy_matches(p, a), table(spark, sf, "existing"), p, a
    ).select(*QUEUED)


def second_opinions(spark, sf):
    return review.pair_opinions(table(spark, sf, "answers")).select(
        *matching.PAIR, "ai_recommendation", "ai_confidence", "ai_reasoning"
    )


def _applied(spark, sf):
    return decisions.apply(table(spark, sf, "existing"), table(spark, sf, "rulings"))


def decision_outcomes(spark, sf):
    return _applied(spark, sf).judged.select(
        *matching.PAIR, "decision", "role", "user_id", "outcome"
    )


def decision_apply(spark, sf):
    return _applied(spark, sf).matches.select(*matching.PAIR, "decision", "decided_by")


def decision_audit(spark, sf):
    return _applied(spark, sf).audit.select(
        "tenant_id", "actor_user_id", "action", "entity_id", "old_value", "new_value"
    )


def _children(spark, sf):
    return partners.child_rows(
        address=table(spark, sf, "addresses"), identifier=table(spark, sf, "identifiers")
    )


def partner_detail(spark, sf):
    return partners.detail(table(spark, sf, "partners"), _children(spark, sf)).select(
        "tenant_id", "business_partner_id", "primary_name", "section", "child_id"
    )


def pair_view(spark, sf):
    return partners.pair_view(
        table(spark, sf, "existing"), table(spark, sf, "partners"), _children(spark, sf)
    ).select(*matching.PAIR, "side", "partner_id", "section", "child_id")


def orphan_children(spark, sf):
    _, rejected = partners.check_children(
        table(spark, sf, "suppliers"), table(spark, sf, "supplier_partners")
    )
    return rejected.select("id", "business_partner_id", "reason")


def kept_children(spark, sf):
    kept, _ = partners.check_children(
        table(spark, sf, "suppliers"), table(spark, sf, "supplier_partners")
    )
    return kept.groupBy("tenant_id", "business_partner_id").agg(
        F.count(F.lit(1)).alias("records")
    )


def relationship_check(spark, sf):
    _, rejected = partners.check_relationships(
        table(spark, sf, "relations"), table(spark, sf, "supplier_partners")
    )
    return rejected.select("id", "business_partner_id", "related_business_partner_id", "reason")


def supplier_check(spark, sf):
    return suppliers.check(
        spread(table(spark, sf, "suppliers"), "id"), table(spark, sf, "known_suppliers")
    ).select("id", "business_partner_id", "outcome")


def supplier_duplicates(spark, sf):
    return suppliers.duplicate_sources(table(spark, sf, "suppliers"))


def row_rules(spark, sf):
    bad = rowrules.split(table(spark, sf, "suppliers"), rowrules.supplier_rules())[1]
    return bad.select("id", F.array_join("reasons", "; ").alias("reasons"))


def partner_rules(spark, sf):
    bad = rowrules.split(table(spark, sf, "supplier_partners"), rowrules.partner_rules())[1]
    return bad.select("id", F.array_join("reasons", "; ").alias("reasons"))


def unique_rule(spark, sf):
    return rowrules.repeated_keys(
        table(spark, sf, "suppliers"),
        ["business_partner_id", "source_system", "supplier_number"],
    )


def audit_diff(spark, sf):
    return audit.diff(
        table(spark, sf, "before"), table(spark, sf, "after"), "Project"
    ).select("tenant_id", "action", "entity_id", "old_value", "new_value")


def version_lineage(spark, sf):
    return versions.register(
        table(spark, sf, "arrivals"), table(spark, sf, "registered")
    ).select(*versions.DATASET, "dataset_version_id", "version_number", "parent_version_id")


def _all_versions(spark, sf):
    cols = [*versions.DATASET, "dataset_version_id", "version_number"]
    new = versions.register(table(spark, sf, "arrivals"), table(spark, sf, "registered"))
    return new.select(*cols).unionByName(table(spark, sf, "registered").select(*cols))


def latest_version(spark, sf):
    return versions.latest(_all_versions(spark, sf))


def _scores(spark, sf):
    """Orders that are not open stand for profiled versions; the price makes their score."""
    return read(spark, sf, "orders").selectExpr(
        "'acme' as tenant_id", "concat('v-', cast(o_orderkey as string)) as dataset_version_id",
        "(o_orderkey % 1000) / 1000 as overall_quality_score", "o_orderstatus",
    ).where("o_orderstatus <> 'O'").drop("o_orderstatus")


def dataset_scores(spark, sf):
    return profile.dataset_scores(
        versions.latest(_all_versions(spark, sf)), _scores(spark, sf)
    ).select(*versions.DATASET, "dataset_version_id", F.round(
        "overall_quality_score", 6).alias("overall_quality_score"))


def project_quality(spark, sf):
    scored = profile.dataset_scores(
        versions.latest(_all_versions(spark, sf)), _scores(spark, sf)
    )
    return profile.project_scores(scored).select(
        "tenant_id", "project_id", "dataset_count", "profiled_dataset_count",
        F.round("overall_quality_score", 6).alias("overall_quality_score"),
    )


def tenant_scope(spark, sf):
    return for_tenant(table(spark, sf, "partners"), "acme", "web").select("id", "primary_name")


def partner_list(spark, sf):
    dated = table(spark, sf, "addresses").select("tenant_id", "id", "created_at")
    return partners.newest_first(for_tenant(dated, "acme"))


def version_history(spark, sf):
    return versions.history(_all_versions(spark, sf))


def _match_job(spark, sf):
    existing = _exact_and_existing(spark, sf)[1]
    return jobs.match_job(*_three(spark, sf), existing, table(spark, sf, "answers"), "u9")


def match_job(spark, sf):
    return _match_job(spark, sf).summary


def match_job_matches(spark, sf):
    return _match_job(spark, sf).matches.select(
        *matching.PAIR, "match_method", "confidence", "decision", "decided_by", "ai_recommendation")


def match_job_queue(spark, sf):
    return _match_job(spark, sf).queue.select(*QUEUED)


def match_job_audit(spark, sf):
    return _match_job(spark, sf).audit.select("tenant_id", "actor_user_id", "action", "entity_id", "new_value")


QUERIES = {f.__name__: f for f in (
    tenant_scope, partner_list, version_history, match_job, match_job_matches, match_job_queue,
    match_job_audit, class_pairs, name_brackets,
    trigram_similarity, whole_text_similarity, name_key, address_key, identifier_key, exact_groups,
    exact_match, exact_match_documents, primary_address, fuzzy_match, match_overlay,
    ambiguous_pairs, pending_pairs, match_refresh, match_summary, match_list, score_pairs,
    pair_queue, second_opinions, decision_outcomes, decision_apply, decision_audit, partner_detail,
    pair_view, orphan_children, kept_children, relationship_check, supplier_check,
    supplier_duplicates, row_rules, partner_rules, unique_rule, audit_diff, version_lineage,
    latest_version, dataset_scores, project_quality,
)}

PAIR = "tenant_id, project_id, business_partner_id, candidate_business_partner_id"


def _trigrams(x: str) -> str:
    return (
        "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(" + x + "), "
        "'[^\\p{L}\\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2),"
        " lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def _similar(a: str, b: str) -> str:
    return (
        f"case when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b})) / "
        f"(len({a}) + len({b}) - len(list_intersect({a}, {b}))) end"
    )


FOUR = "cast(cast(round({0}, 4) as decimal(6,4)) as varchar)"
BEST_ADDRESS = """, best as (select * from (select *, row_number() over (partition by tenant_id,
  business_partner_id order by is_primary desc, created_at, id) as nth from addresses)
  where nth = 1)"""
SCORES = f"""'fuzzy' as match_method,
  floor(least(1.0, case when address_similarity is null then name_similarity * 0.85
    else 0.65 * name_similarity + 0.35 * address_similarity end) * 10000 + 0.5) / 10000
    as confidence,
  'name_similarity=' || {FOUR.format('name_similarity')} || coalesce(';address_similarity=' ||
    {FOUR.format('address_similarity')}, '') as evidence"""
# every_class: all pairs of classes of similar names; listed: those that the list is defined by
FUZZY = ctes("partners", "addresses", "identifiers", "existing") + BEST_ADDRESS + f""",
texts as materialized (select p.*, lower(primary_name) as nm, b.city, b.region, b.postal_code,
  b.country_code, concat_ws(' ', line1, city, postal_code, country_code) as addr
  from partners p left join best b on b.tenant_id = p.tenant_id
  and b.business_partner_id = p.id),
counted as (select tenant_id, project_id, nm, addr, min(id) as class_id, count(*) as members
  from texts where regexp_matches(nm, '[\\p{{L}}\\p{{N}}]') group by all),
classes as materialized (select *, case when addr <> '' then {_trigrams('addr')} end as h
  from counted),
named as materialized (select *, min(class_id) over w as leader_id, count(*) over w as classes,
  (sum(members) over w)::bigint as named_alike,
  min(case when addr = '' then class_id end) over w as blank_id
  from classes window w as (partition by tenant_id, project_id, nm)),
leaders as materialized (select tenant_id, project_id, leader_id, classes, named_alike,
  {_trigrams('nm')} as g from named where class_id = leader_id),
name_grams as materialized (select tenant_id, project_id, leader_id, len(g) as n, unnest(g) as t
  from leaders),
alike as materialized (select a.tenant_id, a.project_id, a.leader_id as a, b.leader_id as b,
  count(*) / (a.n + b.n - count(*)) as name_similarity
  from name_grams a join name_grams b on a.tenant_id = b.tenant_id and a.project_id = b.project_id
  and a.t = b.t and a.leader_id < b.leader_id
  group by a.tenant_id, a.project_id, a.leader_id, b.leader_id, a.n, b.n
  having count(*) / (a.n + b.n - count(*)) >= 0.5
  union all select tenant_id, project_id, leader_id, leader_id, 1.0 from leaders),
every_class as materialized (select a, b, s.tenant_id, s.project_id, x.class_id as x, y.class_id as y,
  x.blank_id as blank_a, y.blank_id as blank_b, x.members as members_x, y.members as members_y,
  name_similarity, case when x.addr <> '' and y.addr <> '' then {_similar('x.h', 'y.h')} end
    as address_similarity
  from alike s join named x on x.tenant_id = s.tenant_id and x.project_id = s.project_id
  and x.leader_id = s.a join named y on y.tenant_id = s.tenant_id
  and y.project_id = s.project_id and y.leader_id = s.b
  where s.a <> s.b or x.class_id < y.class_id),
listed as materialized (select tenant_id, project_id, least(x, y) as business_partner_id,
  greatest(x, y) as candidate_business_partner_id, name_similarity, address_similarity,
  case when x < y then members_x else members_y end as members,
  case when x < y then members_y else members_x end as candidate_members
  from every_class where address_similarity >= 0.5 or x = a and y = b or a = b and x = a
  or a <> b and (x = blank_a and y = b or x = a and y = blank_b)),
fuzzy as materialized (select {PAIR}, {SCORES} from (
  select {PAIR}, name_similarity, address_similarity from listed
  union all select tenant_id, project_id, class_id, id, 1.0,
  case when addr <> '' then case when len(h) > 0 then 1.0 else 0.0 end end
  from texts join classes using (tenant_id, project_id, nm, addr) where id <> class_id))
"""


# fuzzy: all pairs of partners with similar names
EVERY_FUZZY = FUZZY[: FUZZY.index("counted as")] + f"""\
members as materialized (select tenant_id, project_id, id, nm,
  case when addr <> '' then {_trigrams('addr')} end as h from texts),
names as materialized (select distinct tenant_id, project_id, nm, {_trigrams('nm')} as g from texts
  where regexp_matches(nm, '[\\p{{L}}\\p{{N}}]')),
name_grams as materialized (select tenant_id, project_id, nm, len(g) as n, unnest(g) as t from names),
alike as materialized (select a.tenant_id, a.project_id, a.nm as a, b.nm as b,
  count(*) / (a.n + b.n - count(*)) as name_similarity
  from name_grams a join name_grams b on a.tenant_id = b.tenant_id and a.project_id = b.project_id
  and a.t = b.t and a.nm < b.nm group by a.tenant_id, a.project_id, a.nm, b.nm, a.n, b.n
  having count(*) / (a.n + b.n - count(*)) >= 0.5
  union all select tenant_id, project_id, nm, nm, 1.0 from names),
fuzzy as materialized (select {PAIR}, {SCORES} from (select s.tenant_id, s.project_id,
  least(x.id, y.id) as business_partner_id, greatest(x.id, y.id) as candidate_business_partner_id,
  name_similarity, case when x.h is not null and y.h is not null then {_similar('x.h', 'y.h')} end
    as address_similarity
  from alike s join members x on x.tenant_id = s.tenant_id and x.project_id = s.project_id
  and x.nm = s.a join members y on y.tenant_id = s.tenant_id and y.project_id = s.project_id
  and y.nm = s.b where case when s.a = s.b then x.id < y.id else x.id <> y.id end))
"""


def _scored(asked: str) -> str:
    """scored: the fuzzy rows of the pairs asked for, each by its own names and addresses."""
    return f""", grams as materialized (select tenant_id, project_id, id,
  {_trigrams('primary_name')} as g, case when addr <> '' then {_trigrams('addr')} end as h
  from texts),
scored as (select {PAIR}, {SCORES} from (select k.tenant_id, k.project_id, k.business_partner_id,
  k.candidate_business_partner_id, {_similar('a.g', 'b.g')} as name_similarity,
  case when a.h is not null and b.h is not null then {_similar('a.h', 'b.h')} end
    as address_similarity from ({asked}) k
  join grams a on a.tenant_id = k.tenant_id and a.project_id = k.project_id
  and a.id = k.business_partner_id
  join grams b on b.tenant_id = k.tenant_id and b.project_id = k.project_id
  and b.id = k.candidate_business_partner_id) where name_similarity >= 0.5)
"""


NONE = "select '', '', '', '' where false"
EXISTING = f"select {PAIR} from existing"


def _exact_sql(partners_cte: str, identifiers_cte: str, asked: str = NONE) -> str:
    """exact_all: all pairs that share an identifier; exact: leader and member, and pairs asked for."""
    key = "regexp_replace(upper(trim(identifier_value)), '[\\s\\-./]+', '', 'g')"
    return f""", keyed as (select i.tenant_id, project_id, business_partner_id, identifier_type,
  {key} as match_key from {identifiers_cte} i join {partners_cte} p
  on p.tenant_id = i.tenant_id and p.id = i.business_partner_id where {key} <> ''),
led as (select *, min(business_partner_id) over (partition by tenant_id, project_id,
  identifier_type, match_key) as leader_id from keyed),
shared as (select a.tenant_id, a.project_id, a.business_partner_id,
  b.business_partner_id as candidate_business_partner_id, 'exact' as match_method,
  cast(1.0 as double) as confidence, 'identifier_exact=1.0000' as evidence,
  bool_or(a.business_partner_id = a.leader_id) as led
  from led a join led b on a.tenant_id = b.tenant_id and a.project_id = b.project_id
  and a.identifier_type = b.identifier_type and a.match_key = b.match_key
  and a.business_partner_id < b.business_partner_id group by all),
exact_all as (select * exclude (led) from shared),
exact as (select * exclude (led) from shared
  where led or ({PAIR}) in ({asked}))
"""


EXACT = ctes("partners", "identifiers", "existing", "answers", "rulings") + _exact_sql(
    "partners", "identifiers"
)
EXACT_ASKED = ctes("partners", "identifiers", "existing", "answers", "rulings") + _exact_sql(
    "partners", "identifiers", EXISTING
)
EXACT_DOCS = ctes("doc_partners", "doc_identifiers") + _exact_sql(
    "doc_partners", "doc_identifiers"
)
ROW = f"{PAIR}, match_method, confidence, evidence"
OPINIONS = f""", opinions as (select {PAIR},
  case when ok then recommendation end as ai_recommendation,
  case when ok then confidence end as ai_confidence,
  case when ok then reasoning end as ai_reasoning
  from (select *, recommendation in ('merge', 'keep_separate', 'uncertain')
    and confidence between 0 and 1 and length(reasoning) between 1 and 400 as ok from answers))
"""
JUDGED = ctes("existing", "rulings") + f""", judged as (select r.*, e.decision as old_decision,
  case when role = 'VIEWER' then 'forbidden' when r.decision = 'maybe' then 'invalid'
  when r.decision = 'merge' and role <> 'APPROVER' then 'merge_denied'
  when e.decision is null then 'not_found' else 'ok' end as outcome
  from rulings r left join existing e using ({PAIR})),
winner as (select {PAIR}, max((decided_at, user_id, decision)) as w from judged
  where outcome = 'ok' group by all)
"""
CHILDREN = f"""{ctes('partners', 'addresses', 'identifiers', 'existing')}, children as (
  select tenant_id, business_partner_id, 'address' as section, id as child_id from addresses
  union all select tenant_id, business_partner_id, 'identifier', id from identifiers)
"""
VERSIONS = ctes("arrivals", "registered") + """, nth as (select *, row_number() over (
  partition by tenant_id, project_id, dataset_name order by arrived_at, dataset_version_id) as n
  from arrivals),
numbered as (select n.tenant_id, n.project_id, n.dataset_name, n.dataset_version_id,
  n + coalesce(r.version_number, 0) as version_number,
  coalesce(lag(n.dataset_version_id) over (partition by n.tenant_id, n.project_id, n.dataset_name
    order by n), r.dataset_version_id) as parent_version_id
  from nth n left join registered r using (tenant_id, project_id, dataset_name)),
everything as (select tenant_id, project_id, dataset_name, dataset_version_id, version_number
  from numbered union all select tenant_id, project_id, dataset_name, dataset_version_id,
  version_number from registered),
latest as (select * from everything qualify row_number() over (partition by tenant_id,
  project_id, dataset_name order by version_number desc) = 1),
scores as (select latest.*, s.score from latest left join (select
  concat('v-', cast(o_orderkey as varchar)) as dataset_version_id,
  (o_orderkey % 1000) / 1000 as score from orders where o_orderstatus <> 'O') s
  using (dataset_version_id))
"""
SUFFIX = ("INCORPORATED|CORPORATION|COMPANY|LIMITED|GMBH|LLC|LLP|INC|CORP|CO|LTD|LP|PLC|AG|SA|SRL"
          "|BV")


def _name_key(x: str) -> str:
    return (
        "trim(regexp_replace(regexp_replace(regexp_replace(upper(replace(coalesce(" + x
        + ", ''), chr(223), 'SS')), "
        "'[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\b(" + SUFFIX + ")\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
    )


JSON = "json_object('name', name, 'segment', segment)"
DIFF = ctes("before", "after") + """select tenant_id, case when b.id is null then
  'project.created' else 'project.updated' end as action, id as entity_id,
  case when b.id is not null then cast(json_object('name', b.name, 'segment', b.segment)
    as varchar) end as old_value,
  cast(json_object('name', a.name, 'segment', a.segment) as varchar) as new_value
  from after a left join before b using (tenant_id, id)
  where b.id is null or b.name is distinct from a.name
    or b.segment is distinct from a.segment"""

ASKED = f"select {PAIR} from existing union select {PAIR} from answers"
RUN = FUZZY.replace("with partners", "with answers as (" + ctes("answers")[len("with answers as ("):]
                    + ", partners", 1) + _exact_sql(
    "partners", "identifiers", f"select {PAIR} from fuzzy union {ASKED}",
) + _scored(ASKED) + OPINIONS + f""",
found as materialized (select {ROW} from exact union all select {ROW} from (
  select * from fuzzy union select * from scored) anti join exact using ({PAIR})),
adjudged as (select {PAIR}, ai_recommendation, ai_confidence from opinions
  semi join (select {PAIR} from found anti join (select {PAIR} from existing where decision <>
  'needs_review') using ({PAIR}) where match_method = 'fuzzy' and confidence >= 0.5
  and confidence < 0.9) using ({PAIR})),
run as (select f.tenant_id, f.project_id, count(*) as candidates_found,
  count(*) filter (where e.decision is null or e.decision = 'needs_review') as new_or_refreshed,
  count(*) filter (where e.decision <> 'needs_review') as skipped_already_decided,
  count(o.ai_recommendation) as adjudicated
  from found f left join existing e using ({PAIR}) left join adjudged o using ({PAIR})
  group by all)
"""


def _queue(found: str) -> str:
    return f"""select f.tenant_id, f.project_id, f.business_partner_id,
  f.candidate_business_partner_id, f.confidence, a.primary_name as primary_name_a,
  a.city as city_a, a.postal_code as postal_code_a, b.primary_name as primary_name_b,
  b.city as city_b, b.country_code as country_code_b
  from {found} f join texts a on a.id = f.business_partner_id
  join texts b on b.id = f.candidate_business_partner_id
  where f.match_method = 'fuzzy' and f.confidence >= 0.5 and f.confidence < 0.9 and not exists (
  select 1 from existing e where e.business_partner_id = f.business_partner_id and
  e.candidate_business_partner_id = f.candidate_business_partner_id and decision <> 'needs_review')"""


ORACLES = {
    "tenant_scope": ctes("partners") + "select id, primary_name from partners "
    "where tenant_id = 'acme' and project_id = 'web'",
    "partner_list": ctes("addresses") + "select tenant_id, id, created_at from addresses "
    "where tenant_id = 'acme' order by created_at desc, id",
    "version_history": VERSIONS + "select * from everything",
    "match_job": RUN + "select * from run",
    "match_job_audit": RUN + "select tenant_id, 'u9' as actor_user_id, 'entity_match.run' as "
    "action, project_id as entity_id, '{\"candidates_found\":' || candidates_found || "
    "',\"adjudicated\":' || adjudicated || '}' as new_value from run",
    "trigram_similarity": f"select page_id, round({_similar('a', 'b')}, 6) as similarity from "
    f"(select page_id, {_trigrams('url')} as a, "
    + _trigrams("split_part(url, '/', 3)") + " as b from pages)",
    "whole_text_similarity": "with g as (select doc_id, " + _trigrams("text") + " as t from "
    f"documents) select a.doc_id, round({_similar('a.t', 'b.t')}, 6) as similarity "
    "from g a join g b on b.doc_id = a.doc_id + 1",
    "name_key": ctes("doc_partners") + "select id, md5(" + _name_key("primary_name")
    + ") as name_key, md5(trim(regexp_replace(primary_name, '\\s+', ' ', 'g'))) as display "
    "from doc_partners",
    "address_key": ctes("addresses") + "select id, business_partner_id, "
    "concat_ws(' ', nullif(" + _name_key("line1") + ", ''), nullif(upper(trim(city)), ''), "
    "nullif(regexp_replace(upper(postal_code), '\\s+', '', 'g'), ''), "
    "nullif(upper(trim(country_code)), '')) as address_key, "
    "nullif(concat_ws(' ', line1, city, postal_code, country_code), '') as address_text, "
    "coalesce(postal_code, '') as postal from addresses",
    "identifier_key": ctes("identifiers") + "select id, regexp_replace(upper(trim("
    "identifier_value)), '[\\s\\-./]+', '', 'g') as match_key from identifiers",
    "exact_groups": EXACT_DOCS + "select project_id, match_key, business_partner_id, "
    "count(*) over g as group_size, min(business_partner_id) over g as leader_id from keyed "
    "window g as (partition by project_id, match_key) qualify group_size > 1",
    "exact_match": EXACT + f"select {ROW} from exact",
    "exact_match_documents": EXACT_DOCS + f"select {ROW} from exact",
    "primary_address": ctes("addresses") + BEST_ADDRESS + "select tenant_id, "
    "business_partner_id, id as address_id, city, postal_code from best",
    "fuzzy_match": EVERY_FUZZY + f"select {ROW} from fuzzy",
    "match_overlay": FUZZY + _exact_sql("partners", "identifiers", f"select {PAIR} from fuzzy")
    + f"select {ROW} from exact union all select {ROW} from fuzzy anti join exact using ({PAIR})",
    "ambiguous_pairs": EVERY_FUZZY + f"select {ROW} from fuzzy where confidence >= 0.5 "
    "and confidence < 0.9",
    "pending_pairs": EXACT_ASKED + f"select {ROW} from exact where not exists (select 1 from existing e "
    "where e.business_partner_id = exact.business_partner_id and e.candidate_business_partner_id "
    "= exact.candidate_business_partner_id and decision <> 'needs_review')",
    "match_refresh": EXACT_ASKED + OPINIONS + f"""select {PAIR},
  case when coalesce(e.decision, 'needs_review') = 'needs_review' and x.match_method is not null
    then x.match_method else e.match_method end as match_method,
  case when coalesce(e.decision, 'needs_review') = 'needs_review' and x.match_method is not null
    then x.confidence else e.confidence end as confidence,
  coalesce(e.decision, 'needs_review') as decision, e.decided_by,
  case when coalesce(e.decision, 'needs_review') = 'needs_review' and x.match_method is not null
    then o.ai_recommendation end as ai_recommendation,
  case when coalesce(e.decision, 'needs_review') = 'needs_review' and x.match_method is not null
    then o.ai_confidence end as ai_confidence
  from existing e full join exact x using ({PAIR}) left join opinions o using ({PAIR})""",
    "match_summary": EXACT_ASKED + OPINIONS + f"""select tenant_id, project_id,
  count(*) as candidates_found,
  count(*) filter (where e.decision is null or e.decision = 'needs_review') as new_or_refreshed,
  count(*) filter (where e.decision <> 'needs_review') as skipped_already_decided,
  count(ai_recommendation) as adjudicated
  from exact left join existing e using ({PAIR}) left join opinions using ({PAIR})
  group by all""",
    "match_list": ctes("existing", "partners") + f"""select {PAIR},
  p.primary_name as business_partner_name, c.primary_name as candidate_business_partner_name,
  decision from existing e join (select id, primary_name from partners) p
  on p.id = e.business_partner_id join (select id, primary_name from partners) c
  on c.id = e.candidate_business_partner_id where decision = 'keep_separate'""",
    "score_pairs": FUZZY + _exact_sql("partners", "identifiers") + _scored(
        f"select {PAIR} from existing") + f"""select {ROW} from exact_all
  semi join existing using ({PAIR}) union all select {ROW} from scored
  anti join exact_all using ({PAIR})""",
    "class_pairs": FUZZY + f"select {PAIR}, round(name_similarity, 6) as name_similarity, "
    "round(address_similarity, 6) as address_similarity, members, candidate_members from listed",
    "name_brackets": FUZZY + """select s.tenant_id, s.project_id, a, b,
  round(name_similarity, 6) as name_similarity,
  case when a = b then x.named_alike * (x.named_alike - 1) // 2
    else x.named_alike * y.named_alike end as pairs,
  floor((0.65 * name_similarity + 0.35 * 0.5) * 10000 + 0.5) / 10000 as others_below
  from alike s join leaders x on x.tenant_id = s.tenant_id and x.project_id = s.project_id
  and x.leader_id = a join leaders y on y.tenant_id = s.tenant_id and y.project_id = s.project_id
  and y.leader_id = b where a <> b or x.named_alike > 1""",
    "match_job_matches": RUN + f"""select {PAIR},
  case when fresh then found_method else match_method end as match_method,
  case when fresh then found_confidence else confidence end as confidence,
  coalesce(decision, 'needs_review') as decision, decided_by,
  case when fresh then ai_recommendation end as ai_recommendation
  from (select {PAIR}, e.match_method, e.confidence, e.decision, e.decided_by,
    x.match_method as found_method, x.confidence as found_confidence,
    coalesce(e.decision, 'needs_review') = 'needs_review' and x.match_method is not null as fresh
    from existing e full join found x using ({PAIR})) left join adjudged using ({PAIR})""",
    "match_job_queue": RUN + _queue("found"),
    "pair_queue": EVERY_FUZZY + _queue("fuzzy"),
    "second_opinions": ctes("answers") + OPINIONS + f"select {PAIR}, ai_recommendation, "
    "ai_confidence, ai_reasoning from opinions",
    "decision_outcomes": JUDGED + f"select {PAIR}, decision, role, user_id, outcome from judged",
    "decision_apply": JUDGED + f"select {PAIR}, coalesce(w[3], decision) as decision, "
    f"coalesce(w[2], decided_by) as decided_by from existing left join winner using ({PAIR})",
    "decision_audit": JUDGED + """select tenant_id, user_id as actor_user_id,
  case outcome when 'ok' then 'entity_match.decision_recorded'
    else 'entity_match.merge_denied' end as action,
  concat(business_partner_id, '::', candidate_business_partner_id) as entity_id,
  case outcome when 'ok' then '{"decision":"' || old_decision || '"}' end as old_value,
  case outcome when 'ok' then '{"decision":"' || decision || '"}'
    else '{"attemptedDecision":"merge","role":"' || role || '"}' end as new_value
  from judged where outcome in ('ok', 'merge_denied')""",
    "partner_detail": CHILDREN + "select p.tenant_id, p.id as business_partner_id, primary_name, "
    "section, child_id from partners p left join children c on c.tenant_id = p.tenant_id "
    "and c.business_partner_id = p.id",
    "pair_view": CHILDREN + f""", sides as (select *, 'a' as side, business_partner_id as
  partner_id from existing union all select *, 'b', candidate_business_partner_id from existing)
  select s.tenant_id, s.project_id, s.business_partner_id, s.candidate_business_partner_id, side,
  partner_id, section, child_id from sides s join partners p on p.id = partner_id
  left join children c on c.business_partner_id = partner_id""",
    "orphan_children": ctes("suppliers", "supplier_partners") + "select id, business_partner_id, "
    "'Business partner not found' as reason from suppliers where business_partner_id not in "
    "(select id from supplier_partners)",
    "kept_children": ctes("suppliers", "supplier_partners") + "select tenant_id, "
    "business_partner_id, count(*) as records from suppliers where business_partner_id in "
    "(select id from supplier_partners) group by all",
    "relationship_check": ctes("relations", "supplier_partners") + "select * from (select id, "
    "business_partner_id, related_business_partner_id, case when business_partner_id = "
    "related_business_partner_id then 'A business partner cannot have a relationship to itself' "
    "when business_partner_id not in (select id from supplier_partners) then "
    "'Business partner not found' when related_business_partner_id not in (select id from "
    "supplier_partners) then 'related business partner not found' end as reason from relations) "
    "where reason is not null",
    "supplier_check": ctes("suppliers", "known_suppliers") + """, joined as (select s.*,
  coalesce(bool_or(k.supplier_number = s.supplier_number), false) as copy,
  count(k.id) > 0 as sibling from suppliers s left join known_suppliers k
  on k.business_partner_id = s.business_partner_id and k.source_system = s.source_system
  group by all),
nth as (select *, row_number() over (partition by business_partner_id, source_system,
  supplier_number order by created_at, id) as full_nth, row_number() over (
  partition by business_partner_id, source_system order by created_at, id) as source_nth
  from joined)
select id, business_partner_id, case when copy or (supplier_number is not null
  and source_system is not null and full_nth > 1) then 'blocked'
  when source_system <> '' and (sibling or source_nth > 1) then 'flagged' else 'ok' end
  as outcome from nth""",
    "supplier_duplicates": ctes("suppliers") + "select tenant_id, business_partner_id, "
    "source_system, count(*) as records from suppliers where source_system <> '' group by all "
    "having count(*) > 1",
    "row_rules": ctes("suppliers") + "select id, 'status is not one of its allowed values' as "
    "reasons from suppliers where status not in ('active', 'inactive', 'obsolete')",
    "partner_rules": ctes("supplier_partners") + "select id, 'bp_type is not one of its allowed "
    "values' as reasons from supplier_partners where bp_type = 'robot'",
    "unique_rule": ctes("suppliers") + "select business_partner_id, source_system, "
    "supplier_number, count(*) as occurrences from suppliers where source_system is not null and "
    "supplier_number is not null group by all having count(*) > 1",
    "audit_diff": DIFF,
    "version_lineage": VERSIONS + "select tenant_id, project_id, dataset_name, "
    "dataset_version_id, version_number, parent_version_id from numbered",
    "latest_version": VERSIONS + "select * from latest",
    "dataset_scores": VERSIONS + "select tenant_id, project_id, dataset_name, "
    "dataset_version_id, round(score, 6) as overall_quality_score from scores",
    "project_quality": VERSIONS + "select tenant_id, project_id, count(*) as dataset_count, "
    "count(score) as profiled_dataset_count, round(avg(score), 6) as overall_quality_score "
    "from scores group by all",
}
