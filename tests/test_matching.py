"""Candidates, refresh, decisions, suppliers, versions, rules, audit."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from fairledger.functions.text import set_similarity, trigram_codes
from fairledger.operators import (
    audit, decisions, matching, numbering, partners, review, rowrules, similarity, suppliers, versions,
)
from fairledger.operators.similarity import brute_force, similar_pairs
from fairledger.plans.staging import stage

PARTNER = "tenant_id string, project_id string, id string, primary_name string"
IDENT = "tenant_id string, business_partner_id string, identifier_type string, identifier_value string"
ADDRESS = (
    "tenant_id string, id string, business_partner_id string, line1 string, city string, "
    "region string, postal_code string, country_code string, is_primary boolean, created_at date"
)
MATCH = (
    "tenant_id string, project_id string, business_partner_id string, "
    "candidate_business_partner_id string, match_method string, confidence double, "
    "evidence array<struct<type:string,detail:string,score:double>>, decision string, "
    "decided_by string, decided_at date"
)
GOLDEN = {
    "acme_a": ("Acme Corp", "12-3456789"), "acme_b": ("Acme Corporation", "123456789"),
    "globex_a": ("Globex Corporation", "98-7654321"), "globex_b": ("Globex Corp", "11-1111111"),
    "wayne_a": ("Wayne Enterprises", None), "wayne_b": ("Wayne Enterprizes", None),
    "ajax": ("Ajax Corp", None), "stark": ("Stark Industries", None),
    "umbrella": ("Umbrella Corp", None),
}


@pytest.fixture(scope="module")
def golden(spark):
    # The same partners in two tenants: nothing may pair across them.
    p = [(t, "p", f"{t}_{k}", n) for t in ("t1", "t2") for k, (n, _) in GOLDEN.items()]
    i = [(t, f"{t}_{k}", "tax_id", v) for t in ("t1", "t2") for k, (_, v) in GOLDEN.items() if v]
    return (
        spark.createDataFrame(p, PARTNER), spark.createDataFrame(i, IDENT),
        spark.createDataFrame([], ADDRESS),
    )


def pairs(df):
    return {(r["business_partner_id"], r["candidate_business_partner_id"]): r for r in df.collect()}


def test_golden_set(golden):
    got = pairs(matching.all_matches(*golden))
    assert {k: r["match_method"] for k, r in got.items()} == {
        pair: method for t in ("t1", "t2") for pair, method in {
            (f"{t}_acme_a", f"{t}_acme_b"): "exact",
            (f"{t}_globex_a", f"{t}_globex_b"): "fuzzy",
            (f"{t}_wayne_a", f"{t}_wayne_b"): "fuzzy",
            (f"{t}_acme_b", f"{t}_globex_a"): "fuzzy",  # exactly at the bound of 0.5
        }.items()
    }
    assert all(a < b for a, b in got)
    exact = got["t1_acme_a", "t1_acme_b"]
    assert exact["confidence"] == 1
    assert exact["evidence"][0]["detail"] == 'Shared tax_id identifier "12-3456789"'
    assert got["t1_globex_a", "t1_globex_b"]["confidence"] == pytest.approx(0.4675)


@pytest.mark.parametrize("hot", [4096, 3, 0])
@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.55, 0.9, 1.0])
def test_similarity_join_is_exact(spark, hot, threshold):
    words = ["acme", "global", "north", "trade", "steel", "foods"]
    forms = ["corp", "inc", "ltd", "a", "i"]
    names = [" ".join(w) for w in itertools.product(words, words, forms)] + ["a", "b", "a b", "-"]
    sets = spark.createDataFrame(
        [("t", "p" if i % 3 else "q", f"{i:04}", n) for i, n in enumerate(names)], PARTNER
    ).withColumn("items", trigram_codes(F.col("primary_name")))
    scope = ["tenant_id", "project_id"]
    got = similar_pairs(sets, scope, "id", "items", threshold, hot).collect()
    want = brute_force(sets, scope, "id", "items", threshold).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most,hot", [(0, 4096), (0, 3), (100_000, 4096)])
def test_exploded_items_are_not_broadcast(spark, monkeypatch, most, hot):
    """Spark takes them for as small as the sets they come from."""
    monkeypatch.setattr(similarity, "LOOKED_UP", most)
    sets = spark.range(50).selectExpr(
        "'t' as tenant_id", "'p' as project_id", "string(id) as id", "sequence(id, id + 40) as items")
    scope = ["tenant_id", "project_id"]
    found = similar_pairs(sets, scope, "id", "items", 0.5, hot)
    assert "SortMergeJoin" in plan_of(found) and "BroadcastHashJoin" not in plan_of(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, brute_force(
        sets, scope, "id", "items", 0.5).collect()))


@pytest.mark.parametrize("rows,broadcast", [(1000, True), (200_000, False)])
def test_what_is_large_in_memory_is_not_broadcast(spark, rows, broadcast):
    table = stage(spark.range(rows).selectExpr("id as x", "array_repeat(id % 7, 100) as items"))
    held = matching._looked_up(table, 8 * F.size("items") + 200)
    few = stage(spark.range(rows * 10).withColumnRenamed("id", "x"))
    assert ("BroadcastHashJoin" in plan_of(few.join(held.select("x", "items"), "x"))) == broadcast


@pytest.fixture(scope="module")
def crowd(spark):
    """One name and one identifier held by a third of all partners, and some others near."""
    p, i, a = [], [], []
    for n in range(90):
        name = "Hot Name Ltd" if n % 3 == 0 else ("Hot Names Ltd" if n % 3 == 1 else f"Firm {n}")
        p.append(("t", "p", f"{n:03}", name))
        i.append(("t", f"{n:03}", "vat", "X-1" if n % 3 == 0 else f"Y{n // 2}"))
        if n % 2:
            a.append(("t", f"a{n}", f"{n:03}", f"{n % 5} Street", "Town", None, None, "DE", True,
                      dt.date(2024, 1, 1)))
    return (spark.createDataFrame(p, PARTNER), spark.createDataFrame(i, IDENT),
            spark.createDataFrame(a, ADDRESS))


def every_pair(partners):
    """All pairs of partners, in the form in which pairs are asked for."""
    a = partners.select("tenant_id", "project_id", F.col("id").alias("business_partner_id"))
    b = partners.select(
        "tenant_id", "project_id", F.col("id").alias("candidate_business_partner_id"))
    return a.join(b, ["tenant_id", "project_id"]).where(
        "business_partner_id < candidate_business_partner_id")


def test_lists_connect_what_all_pairs_connect(crowd):
    listed = pairs(matching.all_matches(*crowd))
    full = pairs(matching.score_pairs(every_pair(crowd[0]), *crowd))
    assert len(listed) < 3 * 90 < len(full)
    for k, r in listed.items():
        assert (r["match_method"], r["confidence"]) == (
            full[k]["match_method"], full[k]["confidence"])
    groups = matching.exact_groups(crowd[0], crowd[1])
    hot = groups.where("group_size > 5")
    assert hot.count() == 30 and hot.select("leader_id").distinct().collect() == [("000",)]
    assert components(listed) == components(full)
    asked = every_pair(crowd[0]).where("business_partner_id < '030'")
    more = pairs(matching.all_matches(*crowd, asked=asked))
    assert set(more) == set(listed) | {k for k in full if k[0] < "030"}


@pytest.mark.parametrize("size", [2, 100, 101, 3000])
def test_one_rule_for_groups_of_any_size(spark, size):
    ids = [f"{n:05}" for n in range(size)]
    partners = spark.createDataFrame([("t", "p", i, "Acme Corp") for i in ids] + [
        ("t", "p", "x", "Acme Corporation"), ("t", "p", "z", "Other")], PARTNER)
    identifiers = spark.createDataFrame([("t", i, "vat", "1-2") for i in [*ids[1:], "z"]], IDENT)
    addresses = spark.createDataFrame([], ADDRESS)
    got = pairs(matching.all_matches(partners, identifiers, addresses))
    exact = {(ids[1], i) for i in [*ids[2:], "z"]}
    fuzzy = {(ids[0], i) for i in ids[1:]} | {(ids[0], "x")}
    assert {k for k, r in got.items() if r["match_method"] == "exact"} == exact
    assert {k for k, r in got.items() if r["match_method"] == "fuzzy"} == fuzzy - exact
    last = spark.createDataFrame([("t", "p", ids[-1], "x"), ("t", "p", ids[-1], "z")],
                                 "tenant_id string, project_id string, business_partner_id string, "
                                 "candidate_business_partner_id string")
    asked = pairs(matching.score_pairs(last, partners, identifiers, addresses))
    assert {k: r["match_method"] for k, r in asked.items()} == {
        (ids[-1], "x"): "fuzzy", (ids[-1], "z"): "exact"}


def test_most_confident_pair_of_two_names_is_listed(spark):
    partners = spark.createDataFrame([
        ("t", "p", "a1", "Acme Holding"), ("t", "p", "a2", "Acme Holding"), ("t", "p", "a3", "Acme Holding"),
        ("t", "p", "b1", "Acme Holdings")], PARTNER)
    place = {"a1": "Alte Gasse 1 Wien", "a2": "7 Long Street Leeds", "a3": "Rue Longue 5 Lyon",
             "b1": "7 Long Street Leeds"}
    addresses = spark.createDataFrame(
        [("t", f"x{k}", k, v, None, None, None, None, True, dt.date(2024, 1, 1)) for k, v in place.items()],
        ADDRESS)
    identifiers = spark.createDataFrame([], IDENT)
    got = pairs(matching.all_matches(partners, identifiers, addresses))
    full = pairs(matching.score_pairs(every_pair(partners), partners, identifiers, addresses))
    assert got["a2", "b1"]["confidence"] == full["a2", "b1"]["confidence"] == max(
        r["confidence"] for r in full.values())
    assert {("a1", "a2"), ("a1", "a3"), ("a1", "b1")} <= set(got)
    queue = review.pair_queue(
        matching.all_matches(partners, identifiers, addresses), existing_rows(spark), partners, addresses)
    assert ("a2", "b1") in {(r["business_partner_id"], r["candidate_business_partner_id"])
                            for r in queue.collect()}


@pytest.mark.parametrize("seed,least", [(1, 0.5), (2, 0.3), (3, 0.9)])
def test_every_pair_has_a_row_of_its_classes_or_is_below_the_bracket(spark, seed, least):
    rng = random.Random(seed)
    names = ["Acme Corp", "acme corp", "Acme Corporation", "Acme", "Globex AG", "Globex", "--", "Ünion Öl"]
    streets = ["1 Main St Leeds", "2 Main St Leeds", "1 Main Street Leeds", "9 Hill Rd York", None, None, "?"]
    rows = [("t", rng.choice("pq"), f"{n:03}", rng.choice(names)) for n in range(70)]
    partners = spark.createDataFrame(rows, PARTNER)
    line = {r[2]: rng.choice(streets) for r in rows}
    addresses = spark.createDataFrame(
        [("t", f"x{k}", k, v, None, None, None, None, True, dt.date(2024, 1, 1))
         for k, v in line.items() if v], ADDRESS)
    full = pairs(matching.score_pairs(
        every_pair(partners), partners, spark.createDataFrame([], IDENT), addresses))
    listed = pairs(matching.fuzzy_matches(partners, addresses, least_address=least))
    assert all(listed[k]["confidence"] == full[k]["confidence"] for k in listed)
    spoken = {(r["business_partner_id"], r["candidate_business_partner_id"]): r
              for r in matching.class_pairs(partners, addresses, least_address=least).collect()}
    of = {r[2]: (r[1], r[3].lower(), line[r[2]] or "") for r in rows}
    first, leader, size = {}, {}, {}
    for id, c in sorted(of.items()):
        first.setdefault(c, id)
        leader.setdefault(c[:2], id)
        size[c] = size.get(c, 0) + 1
    below = {(r["a"], r["b"]): r for r in matching.name_brackets(
        partners, addresses, least_address=least).collect()}
    seen = dict.fromkeys(below, 0)
    for (a, b), row in full.items():
        x, y = sorted((first[of[a]], first[of[b]]))
        names_of = tuple(sorted((leader[of[a][:2]], leader[of[b][:2]])))
        seen[names_of] += 1
        if x == y:
            assert (x, max(a, b)) in listed or x in (a, b)
        elif (x, y) in spoken:
            row = spoken[x, y]
            assert listed[x, y]["confidence"] == full[a, b]["confidence"]
            assert (row["members"], row["candidate_members"]) == (size[of[x]], size[of[y]])
        elif "" in (of[a][2], of[b][2]):  # the name alone counts: one row speaks for all addresses
            blank = first[of[a] if of[a][2] == "" else of[b]]
            assert any(blank in k and listed[k]["confidence"] == full[a, b]["confidence"]
                       for k in spoken if set(k) <= set(of))
        else:
            assert full[a, b]["confidence"] < below[names_of]["others_below"]
    assert seen == {k: r["pairs"] for k, r in below.items()}


def test_one_name_with_many_addresses_stays_linear(spark):
    rows = [("t", "p", f"{n:04}", "One Name" if n % 2 else "One Names") for n in range(600)]
    partners = spark.createDataFrame(rows, PARTNER)
    addresses = spark.createDataFrame(
        [("t", f"x{r[2]}", r[2], f"{r[2]}{int(r[2]) * 7919 % 9973} street", None, None, None, None, True,
          dt.date(2024, 1, 1)) for r in rows], ADDRESS)
    assert matching.fuzzy_matches(partners, addresses, least_address=0.9).count() < 3 * 600


@pytest.mark.parametrize("slot", [matching.SLOT, 3])
def test_all_pairs_of_similar_names(spark, crowd, monkeypatch, slot):
    """Those of one class as well as those of classes with other addresses; ids and rows may repeat."""
    monkeypatch.setattr(matching, "SLOT", slot)
    none = spark.createDataFrame([], IDENT)
    full = pairs(matching.score_pairs(every_pair(crowd[0]), crowd[0], none, crowd[2]))
    got = matching.fuzzy_matches(crowd[0], crowd[2]).collect()
    assert len(got) == len(full) and all(full[
        r["business_partner_id"], r["candidate_business_partner_id"]] == r for r in got)
    names = [("1", "Acme Corp"), ("1", "Acme Corps"), ("2", "ACME corp"), ("2", "Acme Corp"), ("3", "Acme Corps"),
             (None, "Acme Corp"), ("4", None), ("5", "--"), ("6", "--")]
    odd = spark.createDataFrame([("t", "p", i, n) for i, n in names], PARTNER)
    found = matching.fuzzy_scores(odd, crowd[2]).collect()
    want = [(*sorted((i, j)), n.lower() == m.lower()) for (i, n), (j, m) in itertools.combinations(names[:5], 2) if i != j]
    assert sorted((r["business_partner_id"], r["candidate_business_partner_id"], r["name_similarity"] == 1)
                  for r in found) == sorted(want)


@pytest.mark.parametrize("name", ["fuzzy_match", "ambiguous_pairs", "pair_queue"])
def test_queries_of_similar_partners_leave_none_out(spark, tmp_path, name):
    """Four parts of one name at two addresses: in a list by classes, each pair but three is left out."""
    import __spark_entry__ as entry

    parts = [(n, "red ring", "Brand#1", "SMALL" if n else "STANDARD", 2) for n in (0, 1, 2, 3)]
    spark.createDataFrame(
        parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
    ).write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = pairs(entry.queries()[name](spark, str(tmp_path)))
    every = set(itertools.combinations([f"part-{n}" for n in range(4)], 2))
    low = {k for k in every if k[0] == "part-0"}  # another address, below 0.9
    assert {k: r["confidence"] < 0.9 for k, r in got.items()} == {
        k: k in low for k in (every if name == "fuzzy_match" else low)}


def components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    out = {}
    for x in list(parent):
        out.setdefault(root(x), set()).add(x)
    return sorted(map(sorted, out.values()))


def test_primary_address(spark):
    day = dt.date
    df = spark.createDataFrame([
        ("t", "1", "x", "a", None, None, None, None, False, day(2020, 1, 1)),
        ("t", "2", "x", "b", None, None, None, None, True, day(2022, 1, 1)),
        ("t", "3", "x", "c", None, None, None, None, True, day(2021, 1, 1)),
    ], ADDRESS)
    assert matching.primary_addresses(df).first()["address_id"] == "3"


def existing_rows(spark, *rows):
    return spark.createDataFrame(
        [("t1", "p", a, b, "fuzzy", 0.1, [], d, u, None) for a, b, d, u in rows], MATCH
    )


def test_refresh_keeps_decisions(spark, golden):
    found = matching.all_matches(*golden).where("tenant_id = 't1'")
    old = existing_rows(
        spark, ("t1_globex_a", "t1_globex_b", "reject", "u"),
        ("t1_wayne_a", "t1_wayne_b", "needs_review", None), ("t1_x", "t1_y", "needs_review", None),
    )
    new = pairs(matching.refresh(old, found))
    assert len(new) == 5
    assert new["t1_globex_a", "t1_globex_b"]["decision"] == "reject"
    assert new["t1_globex_a", "t1_globex_b"]["confidence"] == 0.1
    assert new["t1_wayne_a", "t1_wayne_b"]["confidence"] == pytest.approx(0.6071)
    assert new["t1_x", "t1_y"]["confidence"] == 0.1
    assert new["t1_acme_a", "t1_acme_b"]["decision"] == "needs_review"
    s = matching.run_summary(found, old).first()
    assert (s["candidates_found"], s["new_or_refreshed"], s["skipped_already_decided"]) == (4, 3, 1)
    again = pairs(matching.refresh(matching.refresh(old, found), found))
    assert {k: r["confidence"] for k, r in again.items()} == {
        k: r["confidence"] for k, r in new.items()}


def test_decisions(spark):
    table = existing_rows(spark, ("a", "b", "needs_review", None), ("c", "d", "needs_review", None))
    rule = ("tenant_id string, project_id string, business_partner_id string, "
            "candidate_business_partner_id string, decision string, user_id string, role string, "
            "decided_at date")
    day = dt.date
    asked = spark.createDataFrame([
        ("t1", "p", "a", "b", "merge", "s", "STEWARD", day(2024, 1, 1)),
        ("t1", "p", "a", "b", "reject", "s", "STEWARD", day(2024, 1, 2)),
        ("t1", "p", "a", "b", "merge", "m", "APPROVER", day(2024, 1, 3)),
        ("t1", "p", "c", "d", "reject", "v", "VIEWER", day(2024, 1, 3)),
        ("t1", "p", "c", "d", "maybe", "s", "STEWARD", day(2024, 1, 3)),
        ("t1", "p", "c", "e", "reject", "s", "STEWARD", day(2024, 1, 3)),
    ], rule)
    out = decisions.apply(table, asked)
    assert sorted(r["outcome"] for r in out.judged.collect()) == [
        "forbidden", "invalid", "merge_denied", "not_found", "ok", "ok"]
    got = pairs(out.matches)
    assert (got["a", "b"]["decision"], got["a", "b"]["decided_by"]) == ("merge", "m")
    assert got["c", "d"]["decision"] == "needs_review"
    old = {(r["new_value"], r["old_value"]) for r in out.audit.collect() if r["old_value"]}
    assert old == {('{"decision":"reject"}', '{"decision":"needs_review"}'),
                   ('{"decision":"merge"}', '{"decision":"reject"}')}
    actions = [r["action"] for r in out.audit.collect()]
    assert sorted(actions) == ["entity_match.decision_recorded"] * 2 + [
        "entity_match.merge_denied"]


def test_pair_queue_hides_private_fields(golden):
    p, _, a = golden
    queue = review.pair_queue(
        matching.all_matches(*golden), existing_rows(p.sparkSession), p, a)
    assert not {"line1_a", "line1_b"} & set(queue.columns)
    assert {r["business_partner_id"] for r in queue.collect()} == {"t1_wayne_a", "t2_wayne_a"}


def test_scorer_and_validation(golden):
    p, _, a = golden
    queue = review.pair_queue(
        matching.all_matches(*golden), existing_rows(p.sparkSession), p, a)

    def scorer(batches):
        for b in batches:
            keys = b[["tenant_id", "project_id", "business_partner_id",
                      "candidate_business_partner_id"]]
            wrong = b["tenant_id"] == "t2"
            yield keys.assign(recommendation="merge", confidence=wrong + 0.5, reasoning="near",
                              model_version="m")[[
                "tenant_id", "project_id", "business_partner_id",
                "candidate_business_partner_id", "recommendation", "confidence", "reasoning",
                "model_version"]]

    answers = review.pair_opinions(review.ask(queue, scorer, "recommendation")).collect()
    assert {r["tenant_id"]: r["ai_recommendation"] for r in answers} == {"t1": "merge", "t2": None}


def test_one_answer_per_pair(spark):
    answers = spark.createDataFrame([
        ("t", "p", "a", "b", "merge", 0.9, "late", "m", 2), ("t", "p", "a", "b", "uncertain", 0.9, "first", "m", 1),
        ("t", "p", "a", "b", "what", 0.9, "no form", "m", 3), ("t", "p", "c", "d", "what", 0.9, "x", "m", 1),
    ], "tenant_id string, project_id string, business_partner_id string, candidate_business_partner_id "
       "string, recommendation string, confidence double, reasoning string, model_version string, at int")
    timed = answers.withColumn("answered_at", F.timestamp_seconds("at"))
    got = {r["business_partner_id"]: r["ai_recommendation"] for r in review.pair_opinions(timed).collect()}
    assert got == {"a": "merge", "c": None} and review.pair_opinions(answers).count() == 2


SUPPLIER = ("tenant_id string, id string, business_partner_id string, supplier_number string, "
            "source_system string, created_at int")


def test_suppliers(spark):
    known = spark.createDataFrame([("t", "k", "bp", "V-1001", "SAP", 0)], SUPPLIER)
    new = spark.createDataFrame([
        ("t", "1", "bp", "V-1001", "SAP", 1), ("t", "2", "bp", "V-1001", "CRM", 1),
        ("t", "3", "bp", "V-1002", "SAP", 1), ("t", "4", "bp", None, None, 1),
        ("t", "5", "bp", None, None, 2), ("t", "6", "b2", "1", "X", 1), ("t", "7", "b2", "1", "X", 2),
        ("u", "8", "bp", "V-1001", "SAP", 1),
    ], SUPPLIER)
    got = {r["id"]: r["outcome"] for r in suppliers.check(new, known).collect()}
    assert got == {"1": "blocked", "2": "ok", "3": "flagged", "4": "ok", "5": "ok", "6": "ok",
                   "7": "blocked", "8": "ok"}
    twice = suppliers.duplicate_sources(new).collect()
    assert sorted(r["source_system"] for r in twice) == ["SAP", "X"]


def test_numbering_with_one_large_group(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias(
            "g"), ((F.col("id") * 7919) % 2003).alias("o"))
    got = numbering.number_in_order(df, ["g"], ["o"], "n").collect()
    for g in {r["g"] for r in got}:
        mine = sorted((r["o"], r["n"]) for r in got if r["g"] == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_versions(spark):
    cols = ("tenant_id string, project_id string, dataset_name string, "
            "dataset_version_id string, arrived_at int")
    old = spark.createDataFrame(
        [("t", "p", "d", "o1", 1), ("t", "p", "d", "o2", 2)], cols.replace(
            "arrived_at int", "version_number long"))
    new = spark.createDataFrame(
        [("t", "p", "d", "n2", 6), ("t", "p", "d", "n1", 5), ("t", "p", "e", "m", 5)], cols)
    got = {r["dataset_version_id"]: (r["version_number"], r["parent_version_id"])
           for r in versions.register(new, old).collect()}
    assert got == {"n1": (3, "o2"), "n2": (4, "n1"), "m": (1, None)}


def test_children_and_relationships(spark):
    p = spark.createDataFrame([("t", "p", "a", "A"), ("t", "p", "b", "B")], PARTNER)
    rel = spark.createDataFrame(
        [("t", "1", "a", "b"), ("t", "2", "a", "a"), ("t", "3", "x", "b"), ("t", "4", "a", "x"),
         ("u", "5", "a", "b")],
        "tenant_id string, id string, business_partner_id string, "
        "related_business_partner_id string")
    ok, bad = partners.check_relationships(rel, p)
    assert ok.count() == 1
    assert {r["id"]: r["reason"].split()[0] for r in bad.collect()} == {
        "2": "A", "3": "Business", "4": "related", "5": "Business"}


def test_row_rules(spark):
    df = existing_rows(spark, ("a", "b", "merge", None), ("b", "a", "odd", None))
    ok, bad = rowrules.split(df, rowrules.match_rules())
    assert ok.count() == 1
    assert len(bad.first()["reasons"]) == 2
    twice = df.unionByName(df.limit(1))
    assert rowrules.repeated_keys(
        twice, ["business_partner_id", "candidate_business_partner_id"]).count() == 1


def test_audit_diff(spark):
    s = "tenant_id string, id string, name string"
    before = spark.createDataFrame([("t", "1", "a"), ("t", "2", "b"), ("t", "3", None)], s)
    after = spark.createDataFrame(
        [("t", "1", "a"), ("t", "2", "c"), ("t", "3", None), ("t", "4", "d")], s)
    got = {r["entity_id"]: r for r in audit.diff(before, after, "Project").collect()}
    assert set(got) == {"2", "4"}
    assert (got["2"]["old_value"], got["2"]["new_value"]) == ('{"name":"b"}', '{"name":"c"}')
    assert got["4"]["action"] == "project.created"


def test_signatures_lose_no_similar_pair(spark):
    from fairledger.operators.similarity import may_be_similar, signature

    urls = [f"http{'s' * (i % 2)}://w{i % 7}.site{i % 11}.example.net/en/{i * 37}" for i in range(120)]
    sets = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, u string").select(
        "id", trigram_codes(F.col("u")).alias("items")).withColumn("bits", signature(F.col("items")))
    a, b = sets.toDF("a", "ia", "ba"), sets.toDF("b", "ib", "bb")
    seen = a.crossJoin(b).where("a < b").select(
        (set_similarity(F.col("ia"), F.col("ib")) >= 0.6).alias("similar"),
        may_be_similar(F.size("ia"), F.col("ba"), F.size("ib"), F.col("bb"), 0.6).alias("may"),
    ).groupBy("similar", "may").count().collect()
    n = {(r["similar"], r["may"]): r["count"] for r in seen}
    assert (True, False) not in n and n[(True, True)] > 0
    assert n[(False, False)] > n.get((False, True), 0)  # most others are not looked at


def test_few_sets_are_joined_by_many_tasks(spark):
    tasks = spark.sparkContext.defaultParallelism
    sets = spark.createDataFrame(
        [(i, [1, 2, 3, i + 10]) for i in range(200)], "id int, items array<long>").coalesce(1)
    pairs = similar_pairs(sets, [], "id", "items", 0.5)
    assert pairs.count() == 200 * 199 // 2
    assert len(set(r[0] for r in pairs.select(F.spark_partition_id()).distinct().collect())) >= tasks


@pytest.mark.parametrize("few", [0, 1, 1000])
def test_addresses_near_each_other_whatever_the_number_of_classes(spark, few):
    data = [(t, f"n{n}", f"{t}{n}-{i}", f"{i % 5} High Street {chr(97 + i)} Town{i % 3}")
            for t in "st" for n in range(2) for i in range(9)] + [("s", "n0", "s-none", "")]
    classes = spark.createDataFrame(
        data, "tenant_id string, leader_id string, class_id string, address string").withColumn(
        "project_id", F.lit("p"))
    alike = spark.createDataFrame(
        [(t, "p", a, b, 0.7) for t in "st" for a, b in (("n0", "n1"), ("n0", "n0"))],
        "tenant_id string, project_id string, a string, b string, name_similarity double")
    got = matching._near_addresses(alike, classes, 0.5, few)
    side = classes.where("address <> ''").select(
        "tenant_id", "leader_id", "class_id", trigram_codes(F.col("address")).alias("h"))
    x, y = side.toDF("tenant_id", "a", "x", "hx"), side.toDF("tenant_id", "b", "y", "hy")
    want = alike.join(x, ["tenant_id", "a"]).join(y, ["tenant_id", "b"]).where("a <> b or x < y").withColumn(
        "s", set_similarity(F.col("hx"), F.col("hy"))).where("s >= 0.5")

    def rows(df, s):
        return sorted((r["tenant_id"], *sorted((r["x"], r["y"])), round(r[s], 9)) for r in df.collect())

    assert rows(got, "address_similarity") == rows(want, "s") and want.count() > 50


def test_items_of_a_pair_are_intersected_once(spark):
    """Each use of a plain column in a condition or result would be worked out by itself."""
    def uses(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("array_intersect")

    sets = spark.createDataFrame([(i, [1, 2, 3, i + 10]) for i in range(9)], "id int, items array<long>")
    assert uses(similar_pairs(sets, [], "id", "items", 0.5)) == 1
    ids = "tenant_id string, project_id string, a string, b string, name_similarity double"
    classes = spark.createDataFrame(
        [("t", "p", f"n{i}", f"c{i}", "High Street") for i in range(3)],
        "tenant_id string, project_id string, leader_id string, class_id string, address string")
    near = matching._near_addresses(
        spark.createDataFrame([("t", "p", "n0", "n1", 0.7)], ids), classes, 0.5)
    assert uses(near) == 1 and near.count() == 1
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert near.rdd.getNumPartitions() >= tasks
