"""Duplicate candidates between business partners.

partners     (tenant_id, project_id, id, primary_name, ...)
identifiers  (tenant_id, business_partner_id, identifier_type, identifier_value, ...)
addresses    (tenant_id, business_partner_id, line1, city, postal_code, country_code, is_primary,
              created_at, id, ...)

Groups and pairs. Partners that share an identifier form a group, which is listed by its members and
their leader, the member with the smallest id: one row for each member but the leader. Partners with
one name and one address form a class and are listed in the same way; what holds for one pair of
members holds for all. Similar names are listed by their classes: all those with similar addresses,
and the leaders, see `class_pairs`. So the lists are linear in the partners, the classes and the
similar names, where all pairs would grow with the square of a group, and the most confident pair
between two names is always in them. `score_pairs` gives method, evidence and confidence of any pair
asked for, and the pairs that already have a row in the match table are asked for in every run.
`fuzzy_scores` and `fuzzy_matches` give all pairs of partners with similar names, unless they are asked
for the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairledger.functions import fixed as K
from fairledger.functions.text import (
    address_text, identifier_match_key, match_confidence, set_similarity, trigram_codes,
)
from fairledger.operators.similarity import LOOKED_UP, dealt, may_be_similar, signature, similar_pairs
from fairledger.plans.staging import stage
from fairledger.scope import PROJECT

PAIR = [*PROJECT, "business_partner_id", "candidate_business_partner_id"]
FEW = 64  # all pairs of two groups are compared where they are up to this many times their rows
SLOT = 256  # members of a class are paired in lists of about so many


def primary_addresses(addresses: DataFrame) -> DataFrame:
    """One address per partner: primary first, then the earliest, then the smallest id."""
    keep = ["line1", "city", "region", "postal_code", "country_code"]
    have = [c for c in keep if c in addresses.columns]
    best = F.min(F.struct(
        (~F.col("is_primary")).alias("rank"), "created_at", F.col("id").alias("address_id"), *have,
    )).alias("best")
    return addresses.groupBy("tenant_id", "business_partner_id").agg(best).select(
        "tenant_id", "business_partner_id", "best.address_id", *[f"best.{c}" for c in have]
    )


def _members(partners: DataFrame, identifiers: DataFrame) -> DataFrame:
    scope = partners.select("tenant_id", "project_id", F.col("id").alias("business_partner_id"))
    return (
        identifiers.join(scope, ["tenant_id", "business_partner_id"])
        .withColumn("match_key", identifier_match_key(F.col("identifier_value")))
        .where(F.col("match_key") != "")
        .groupBy(*PROJECT, "identifier_type", "match_key", "business_partner_id")
        .agg(F.min("identifier_value").alias("identifier_value"))
    )


def exact_groups(partners: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Members of every group of two or more partners that share an identifier."""
    key = [*PROJECT, "identifier_type", "match_key"]
    members = _members(partners, identifiers)
    groups = (
        members.groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min(F.struct("business_partner_id", "identifier_value")).alias("leader"),
        )
        .where("group_size > 1")
    )
    return members.join(stage(groups), key).select(
        *key, "business_partner_id", "identifier_value", "group_size",
        F.col("leader.business_partner_id").alias("leader_id"),
        F.col("leader.identifier_value").alias("leader_value"),
    )


def _linked(groups: DataFrame, key: list[str], id_col: str, carry: list[str]) -> DataFrame:
    """Pairs (id_a, id_b) of the leader of each group and its other members.

    `groups` has leader_<c> columns for the id and every carried column.
    """
    return groups.where(F.col(id_col) != F.col("leader_id")).select(
        *key, F.col("leader_id").alias("id_a"),
        *[F.col(f"leader_{c}").alias(f"{c}_a") for c in carry],
        F.col(id_col).alias("id_b"), *[F.col(c).alias(f"{c}_b") for c in carry],
    )


def _signal(kind: str, detail: Column, score: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), detail.alias("detail"), score.cast("double").alias("score")
    )


def _two_places(c: Column) -> Column:
    return F.format_string("%.2f", c)


def _exact_evidence(best: Column) -> Column:
    detail = F.concat(
        F.lit("Shared "), best.getField("identifier_type"), F.lit(' identifier "'),
        best.getField("identifier_value"), F.lit('"'),
    )
    return F.array(_signal("identifier_exact", detail, F.lit(1.0)))


def _fuzzy_evidence(name: Column, address: Column) -> Column:
    return F.array_compact(F.array(
        F.when(name.isNotNull(), _signal(
            "name_similarity",
            F.concat(F.lit("Name trigram similarity "), _two_places(name)), name,
        )),
        F.when(address.isNotNull(), _signal(
            "address_similarity",
            F.concat(F.lit("Primary-address trigram similarity "), _two_places(address)), address,
        )),
    ))


def _exact_links(groups: DataFrame) -> DataFrame:
    key = [*PROJECT, "identifier_type", "match_key"]
    linked = _linked(
        groups.withColumnRenamed("identifier_value", "value"), key, "business_partner_id", ["value"])
    best = F.min(F.struct(
        "identifier_type", "match_key", F.col("value_a").alias("identifier_value")
    )).alias("best")
    return (
        linked.groupBy(
            *PROJECT, F.col("id_a").alias("business_partner_id"),
            F.col("id_b").alias("candidate_business_partner_id"),
        )
        .agg(best)
        .select(
            *PAIR, F.lit("exact").alias("match_method"), F.lit(1.0).alias("confidence"),
            _exact_evidence(F.col("best")).alias("evidence"),
        )
    )


def exact_matches(
    partners: DataFrame, identifiers: DataFrame, asked: DataFrame | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Leader and member of every group with a shared identifier, and those pairs asked for that
    share one; of several shared identifiers the smallest (type, key) is cited. `groups` are those
    of `exact_groups`, where they are known already."""
    groups = stage(exact_groups(partners, identifiers)) if groups is None else groups
    links = _exact_links(groups)
    if asked is None:
        return links
    return links.unionByName(
        shared_identifiers(asked, groups).join(links.select(*PAIR), PAIR, "left_anti"))


def _named(partners: DataFrame, addresses: DataFrame) -> DataFrame:
    """Partners with their comparison name and the text of their address, '' for none."""
    line = address_text(
        F.col("line1"), F.col("city"), F.col("postal_code"), F.col("country_code"))
    first = primary_addresses(addresses).select(
        "tenant_id", F.col("business_partner_id").alias("id"), line.alias("address"))
    return partners.select(*PROJECT, "id", F.lower("primary_name").alias("name")).join(
        first, ["tenant_id", "id"], "left").withColumn("address", F.coalesce("address", F.lit("")))


def _codes(address: Column) -> Column:
    return F.when(address != "", trigram_codes(address))


CLASS = [*PROJECT, "name", "address"]


def name_classes(named: DataFrame) -> DataFrame:
    """Classes of partners with one name and one address, which no signal tells apart.

    class_id is the smallest id of the class, leader_id that of its name; `members` and `named_alike`
    count the partners of the class and of the name, `classes` the classes of the name. Names
    without a letter or digit are in no class, as they are similar to nothing.
    """
    classes = stage(named.where(F.regexp_count("name", F.lit(r"[\p{L}\p{N}]")) > 0).groupBy(*CLASS).agg(
        F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members")))
    names = classes.groupBy(*PROJECT, "name").agg(
        F.min("class_id").alias("leader_id"), F.count(F.lit(1)).alias("classes"),
        F.sum("members").alias("named_alike"),
        F.min(F.when(F.col("address") == "", F.col("class_id"))).alias("blank_id"),
    )
    return classes.join(stage(names), [*PROJECT, "name"])


def similar_names(classes: DataFrame, threshold: float = K.NAME_SIMILARITY) -> DataFrame:
    """(PROJECT, a, b, name_similarity): different names by their leaders, a < b, and each name of
    several classes with itself."""
    leaders = classes.where(F.col("class_id") == F.col("leader_id"))
    names = leaders.select(*PROJECT, "leader_id", trigram_codes(F.col("name")).alias("items"))
    itself = leaders.where("classes > 1").select(
        *PROJECT, F.col("leader_id").alias("a"), F.col("leader_id").alias("b"),
        F.lit(1.0).alias("name_similarity"))
    return similar_pairs(names, PROJECT, "leader_id", "items", threshold).withColumnRenamed(
        "similarity", "name_similarity").unionByName(itself)


def _looked_up(table: DataFrame, size: Column) -> DataFrame:
    """A written table to look items up in. Its files are far smaller than its rows in memory, from
    which Spark can't tell: where `size`, the bytes of a row, adds up to more, it is merged."""
    used = table.agg(F.sum(size)).first()[0] or 0
    return table if used <= LOOKED_UP else table.hint("merge")


def _near_addresses(
    alike: DataFrame, classes: DataFrame, least: float, few: int = FEW
) -> DataFrame:
    """Pairs of classes of two similar names, or of one, with an address similarity of `least`.

    Names with few classes have all their pairs compared, most of them by their signatures alone. For
    two names with many classes each, the join on trigrams runs within the pair of names. Only pairs
    across the two names count.
    """
    placed = stage(classes.where("address <> ''").select(
        *PROJECT, "leader_id", "class_id", _codes(F.col("address")).alias("items")
    ).where(F.size("items") > 0).withColumn("bits", signature(F.col("items"))))
    counts = placed.groupBy(*PROJECT, "leader_id").agg(F.count(F.lit(1)).alias("n"))
    sized = stage(alike.join(counts.toDF(*PROJECT, "a", "n_a"), [*PROJECT, "a"]).join(
        counts.toDF(*PROJECT, "b", "n_b"), [*PROJECT, "b"]))
    is_few = F.col("n_a") * F.col("n_b") <= few * (F.col("n_a") + F.col("n_b"))
    # few pairs of names make many pairs of classes: they are dealt out before they are joined
    placed = _looked_up(placed, 8 * F.size("items") + 200)
    near = _all_near(dealt(sized.where(is_few), "a", "b"), placed, least)
    many = sized.where(~is_few)
    return near if many.isEmpty() else near.unionByName(_joined_near(many, placed, least))


def _all_near(alike: DataFrame, placed: DataFrame, least: float) -> DataFrame:
    def side(mark: str, id_col: str) -> DataFrame:
        return placed.select(
            *PROJECT, F.col("leader_id").alias(mark), F.col("class_id").alias(id_col),
            F.size("items").alias(f"size_{id_col}"), F.col("bits").alias(f"bits_{id_col}"),
            F.col("items").alias(f"items_{id_col}"))

    x, y = [(F.col(f"size_{c}"), F.col(f"bits_{c}")) for c in "xy"]
    pairs = alike.join(side("a", "x"), [*PROJECT, "a"]).join(side("b", "y"), [*PROJECT, "b"]).where(
        ((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))) & may_be_similar(*x, *y, least))
    return _with_similarity(pairs).where(F.col("address_similarity") >= least).select(
        *PROJECT, "x", "y", "name_similarity", "address_similarity")


def _with_similarity(pairs: DataFrame) -> DataFrame:
    """Pairs with the address_similarity of items_x and items_y, null where one is null.

    What both have is a generated column, which is worked out once: a plain one would be worked out
    for each use of its size, in conditions and results.
    """
    both, x, y = F.size("common"), F.size("items_x"), F.size("items_y")
    return pairs.select("*", F.explode(F.array(F.array_intersect("items_x", "items_y"))).alias("common")).withColumn(
        "address_similarity", F.when(F.col("common").isNotNull(), F.when(
            (x > 0) & (y > 0), both / (x + y - both)).otherwise(F.lit(0.0)))).drop("common")


def _joined_near(alike: DataFrame, placed: DataFrame, least: float) -> DataFrame:
    scope = [*PROJECT, "a", "b", "name_similarity"]

    def side(mark: str, some: DataFrame) -> DataFrame:
        return some.join(placed.withColumnRenamed("leader_id", mark), [*PROJECT, mark]).select(
            *scope, F.concat(F.lit(mark), "class_id").alias("of"), "items")

    sides = side("a", alike).unionByName(side("b", alike.where("a <> b")))
    near = similar_pairs(sides, scope, "of", "items", least, left_id="of_a", right_id="of_b")
    mark = lambda c: F.substring(c, 1, 1)
    return near.where((F.col("a") == F.col("b")) | (mark("of_a") != mark("of_b"))).select(
        *PROJECT, F.expr("substr(of_a, 2)").alias("x"), F.expr("substr(of_b, 2)").alias("y"),
        "name_similarity", F.col("similarity").alias("address_similarity"))


def class_pairs(
    partners: DataFrame, addresses: DataFrame, threshold: float = K.NAME_SIMILARITY,
    least_address: float = K.ADDRESS_SIMILARITY,
) -> DataFrame:
    """(PAIR, name_similarity, address_similarity, members, candidate_members): pairs of classes, each
    by its smallest id, whose members all have these similarities among them.

    Listed are, for similar names and for a name with itself, all pairs of classes whose addresses
    are similar by `least_address`; a class without address and one class of the other name, which
    stands for all its classes, as without an address on both sides the name alone counts; and the
    leaders of both names, or the leader of a name and each of its other classes. So the list grows
    with classes and similar names, and no pair that is in none of its rows is more confident than
    `name_brackets` says.
    """
    return _class_pairs(stage(name_classes(_named(partners, addresses))), threshold, least_address)


def _class_pairs(classes: DataFrame, threshold: float, least_address: float) -> DataFrame:
    alike = stage(similar_names(classes, threshold))
    near = _near_addresses(alike, classes, least_address)
    names = classes.where(F.col("class_id") == F.col("leader_id"))
    across, within = alike.where("a <> b"), alike.where("a = b")
    blanks = names.where("blank_id is not null and blank_id <> leader_id")

    def blank(mark: str, other: str) -> DataFrame:
        of = blanks.select(*PROJECT, F.col("leader_id").alias(mark), F.col("blank_id").alias("x"))
        return across.join(of, [*PROJECT, mark]).select(
            *PROJECT, "x", F.col(other).alias("y"), "name_similarity")

    others = classes.where(F.col("class_id") != F.col("leader_id")).select(
        *PROJECT, F.col("leader_id").alias("x"), F.col("class_id").alias("y"))
    of_class = _looked_up(classes, 16 * F.length("address") + 200)  # as many items as there may be
    led = across.select(*PROJECT, F.col("a").alias("x"), F.col("b").alias("y"), "name_similarity").unionByName(
        within.withColumnRenamed("a", "x").join(others, [*PROJECT, "x"]).select(
            *PROJECT, "x", "y", "name_similarity"))
    # those with similar addresses are in `near` already
    rest = _with_similarity(
        _with_classes(led.unionByName(blank("a", "b")).unionByName(blank("b", "a")), of_class)
    ).where(F.col("address_similarity").isNull() | (F.col("address_similarity") < least_address))
    listed = _with_classes(near, classes, items=False).unionByName(rest.drop("items_x", "items_y"))
    swap = F.col("x") > F.col("y")
    return listed.select(
        *PROJECT, F.least("x", "y").alias("business_partner_id"),
        F.greatest("x", "y").alias("candidate_business_partner_id"),
        "name_similarity", "address_similarity",
        F.when(swap, F.col("members_y")).otherwise(F.col("members_x")).alias("members"),
        F.when(swap, F.col("members_x")).otherwise(F.col("members_y")).alias("candidate_members"),
    )


def _with_classes(pairs: DataFrame, classes: DataFrame, items: bool = True) -> DataFrame:
    for mark in "xy":
        of = classes.select(
            *PROJECT, F.col("class_id").alias(mark), F.col("members").alias(f"members_{mark}"),
            *([_codes(F.col("address")).alias(f"items_{mark}")] if items else []))
        pairs = pairs.join(of, [*PROJECT, mark])
    return pairs


def name_brackets(
    partners: DataFrame, addresses: DataFrame, threshold: float = K.NAME_SIMILARITY,
    least_address: float = K.ADDRESS_SIMILARITY,
) -> DataFrame:
    """One row for each two similar names, and each name with itself: a, b (their leaders),
    name_similarity, pairs (of their partners), and others_below.

    A pair of partners that no row of `class_pairs` speaks for is less confident than others_below.
    """
    classes = stage(name_classes(_named(partners, addresses)))
    names = classes.where(F.col("class_id") == F.col("leader_id")).select(
        *PROJECT, "leader_id", "named_alike")
    itself = classes.where(F.col("class_id") == F.col("leader_id")).where("classes = 1").select(
        *PROJECT, F.col("leader_id").alias("a"), F.col("leader_id").alias("b"),
        F.lit(1.0).alias("name_similarity"))
    alike = similar_names(classes, threshold).unionByName(itself)
    for mark in "ab":
        alike = alike.join(
            names.toDF(*PROJECT, mark, f"named_{mark}"), [*PROJECT, mark])
    return alike.select(
        *PROJECT, "a", "b", "name_similarity",
        F.when(F.col("a") == F.col("b"), F.expr("named_a * (named_a - 1) div 2")).otherwise(
            F.col("named_a") * F.col("named_b")).alias("pairs"),
        match_confidence(F.lit(False), F.col("name_similarity"), F.lit(least_address)).alias(
            "others_below"),
    ).where("pairs > 0")


def _address_similarity(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), set_similarity(a, b))


def _every_class_pair(classes: DataFrame, threshold: float) -> DataFrame:
    """(PROJECT, a, x, members_x, b, y, members_y, name_similarity, address_similarity): all classes of
    two similar names a and b or of one, by their addresses x and y, each class of several partners
    with itself, too. Classes go by name and address, which tell them apart where ids are repeated."""
    coded = stage(classes.select(*CLASS, "members", _codes(F.col("address")).alias("items")))
    held = _looked_up(coded, 8 * F.greatest(F.size("items"), F.lit(0)) + F.length("name") + 200)
    names = coded.select(*PROJECT, "name").distinct()
    alike = similar_pairs(
        names.withColumn("items", trigram_codes(F.col("name"))), PROJECT, "name", "items", threshold,
    ).withColumnRenamed("similarity", "name_similarity").unionByName(names.select(
        *PROJECT, F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("name_similarity")))
    # few pairs of names make many pairs of classes: they are dealt out before they are joined
    pairs = dealt(alike, "a", "b")
    for mark, of in ("ax", "by"):
        pairs = pairs.join(held.select(
            *PROJECT, F.col("name").alias(mark), F.col("address").alias(of),
            F.col("members").alias(f"members_{of}"), F.col("items").alias(f"items_{of}")), [*PROJECT, mark])
    pairs = pairs.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")) | (
        (F.col("x") == F.col("y")) & (F.col("members_x") > 1)))
    return _with_similarity(pairs).drop("items_x", "items_y")


def _slots(members: Column) -> Column:
    return F.ceil(members / SLOT)


def _partner_pairs(pairs: DataFrame, named: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs of partners of the given pairs of classes, with the scores of these.

    The members of a class are listed by about `SLOT`, and two lists at a time meet: what is sent is a
    small part of the pairs, no list grows with its class, and one large class is many pairs of lists.
    """
    slot = F.pmod(F.xxhash64("id"), _slots(F.col("members")))
    # grouping columns are never null here: a null name is in no class
    lists = stage(named.join(classes.select(*CLASS, "members"), CLASS).where("id is not null").groupBy(
        *CLASS, slot.alias("slot")).agg(F.collect_list("id").alias("ids")))
    held = _looked_up(
        lists, 50 * F.size("ids") + F.length("name") + F.length("address") + 200)
    for of in "xy":
        pairs = pairs.withColumn(f"slot_{of}", F.explode(F.sequence(
            F.lit(0).cast("long"), _slots(F.col(f"members_{of}")) - 1)))
    one = (F.col("a") == F.col("b")) & (F.col("x") == F.col("y"))
    pairs = dealt(
        pairs.where(~one | (F.col("slot_x") <= F.col("slot_y"))), "a", "x", "slot_x", "b", "y", "slot_y")
    for mark, of in ("ax", "by"):
        pairs = pairs.join(held.select(
            *PROJECT, F.col("name").alias(mark), F.col("address").alias(of),
            F.col("slot").alias(f"slot_{of}"), F.col("ids").alias(f"ids_{of}")),
            [*PROJECT, mark, of, f"slot_{of}"])
    score = ["name_similarity", "address_similarity"]
    within = one & (F.col("slot_x") == F.col("slot_y"))
    pairs = pairs.select(*PROJECT, *score, within.alias("within"), "ids_y", F.explode("ids_x").alias("p"))
    pairs = pairs.select(*PROJECT, *score, "within", "p", F.explode("ids_y").alias("q"))
    return pairs.where(F.when(F.col("within"), F.col("p") < F.col("q")).otherwise(F.col("p") != F.col("q"))).select(
        *PROJECT, F.least("p", "q").alias("business_partner_id"),
        F.greatest("p", "q").alias("candidate_business_partner_id"), *score)


def fuzzy_scores(
    partners: DataFrame, addresses: DataFrame, threshold: float = K.NAME_SIMILARITY,
    least_address: float | None = None,
) -> DataFrame:
    """(PAIR, name_similarity, address_similarity) of all pairs of partners with similar names.

    With `least_address` only the pairs of `class_pairs`, and of the smallest id and each other member
    of a class. All pairs grow with the square of the partners that are named alike.
    """
    named = _named(partners, addresses)
    classes = stage(name_classes(named))
    if least_address is None:
        return _partner_pairs(_every_class_pair(classes, threshold), named, classes)
    score = ["name_similarity", "address_similarity"]
    # grouping columns are never null here: a null name is in no class
    same = named.join(classes.where("members > 1"), CLASS).where(F.col("id") != F.col("class_id")).select(
        *PROJECT, F.col("class_id").alias("business_partner_id"),
        F.col("id").alias("candidate_business_partner_id"), F.lit(1.0).alias("name_similarity"),
        F.when(F.col("address") != "", _address_similarity(
            _codes(F.col("address")), _codes(F.col("address")))).alias("address_similarity"))
    return same.unionByName(
        _class_pairs(classes, threshold, least_address).select(*PAIR, *score))


def _as_fuzzy(scores: DataFrame) -> DataFrame:
    name, address = F.col("name_similarity"), F.col("address_similarity")
    return scores.select(
        *PAIR, F.lit("fuzzy").alias("match_method"),
        match_confidence(F.lit(False), name, address).alias("confidence"),
        _fuzzy_evidence(name, address).alias("evidence"),
    )


def fuzzy_matches(
    partners: DataFrame, addresses: DataFrame, threshold: float = K.NAME_SIMILARITY,
    least_address: float | None = None,
) -> DataFrame:
    """All pairs of partners with similar names; with `least_address` the list by classes."""
    return _as_fuzzy(fuzzy_scores(partners, addresses, threshold, least_address))


def overlay(exact: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """Both lists as one; a pair found by both keeps its exact row."""
    left = exact.select(*PAIR, F.struct("match_method", "confidence", "evidence").alias("e"))
    right = fuzzy.select(*PAIR, F.struct("match_method", "confidence", "evidence").alias("f"))
    return left.join(right, PAIR, "full_outer").select(*PAIR, F.coalesce("e", "f").alias("m")).select(
        *PAIR, "m.match_method", "m.confidence", "m.evidence"
    )


def shared_identifiers(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Exact rows of those given pairs that share an identifier, through membership alone."""
    key = ["identifier_type", "match_key"]
    a = groups.select(*PROJECT, "business_partner_id", *key, "identifier_value")
    b = groups.select(
        *PROJECT, F.col("business_partner_id").alias("candidate_business_partner_id"), *key
    )
    best = F.min(F.struct(*key, "identifier_value")).alias("best")
    return (
        pairs.select(*PAIR)
        .join(a, [*PROJECT, "business_partner_id"])
        .join(b, [*PROJECT, "candidate_business_partner_id", *key])
        .groupBy(*PAIR)
        .agg(best)
        .select(
            *PAIR, F.lit("exact").alias("match_method"), F.lit(1.0).alias("confidence"),
            _exact_evidence(F.col("best")).alias("evidence"),
        )
    )


def all_matches(
    partners: DataFrame, identifiers: DataFrame, addresses: DataFrame,
    threshold: float = K.NAME_SIMILARITY, asked: DataFrame | None = None,
) -> DataFrame:
    """Exact and fuzzy candidates of all projects, and those among the pairs asked for.

    The fuzzy ones are listed by classes. A pair that was found by its name and shares an identifier is an exact one, as in `overlay`.
    """
    fuzzy = stage(fuzzy_matches(partners, addresses, threshold, K.ADDRESS_SIMILARITY))
    groups = stage(exact_groups(partners, identifiers))
    found = overlay(exact_matches(partners, identifiers, fuzzy.select(*PAIR), groups), fuzzy)
    if asked is None:
        return found
    found = stage(found)
    more = asked.select(*PAIR).distinct().join(found.select(*PAIR), PAIR, "left_anti")
    return found.unionByName(score_pairs(more, partners, identifiers, addresses, threshold, groups))


def score_pairs(
    pairs: DataFrame, partners: DataFrame, identifiers: DataFrame, addresses: DataFrame,
    threshold: float = K.NAME_SIMILARITY, groups: DataFrame | None = None,
) -> DataFrame:
    """Candidates among the pairs asked for, whatever the size of the groups they come from."""
    named = _named(partners, addresses).select(
        *PROJECT, "id", _codes(F.col("address")).alias("address"),
        trigram_codes(F.col("name")).alias("items"),
    )

    def side(id_col: str, mark: str) -> DataFrame:
        return named.select(
            *PROJECT, F.col("id").alias(id_col), F.col("items").alias(f"items_{mark}"),
            F.col("address").alias(f"address_{mark}"),
        )

    scored = (
        pairs.select(*PAIR)
        .join(side("business_partner_id", "a"), [*PROJECT, "business_partner_id"])
        .join(
            side("candidate_business_partner_id", "b"),
            [*PROJECT, "candidate_business_partner_id"],
        )
        .select(
            *PAIR,
            set_similarity(F.col("items_a"), F.col("items_b")).alias("name_similarity"),
            _address_similarity(F.col("address_a"), F.col("address_b")).alias(
                "address_similarity"
            ),
        )
        .where(F.col("name_similarity") >= threshold)
    )
    exact = shared_identifiers(pairs, exact_groups(partners, identifiers) if groups is None else groups)
    return overlay(exact, _as_fuzzy(scored))


def pending(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates without a row yet, or whose row still needs review."""
    decided = existing.where(F.col("decision") != "needs_review").select(*PAIR)
    return candidates.join(decided, PAIR, "left_anti")


def ambiguous(matches: DataFrame) -> DataFrame:
    low, high = K.AMBIGUOUS
    return matches.where(
        (F.col("match_method") == "fuzzy")
        & (F.col("confidence") >= low) & (F.col("confidence") < high)
    )


OPINION = ["ai_recommendation", "ai_confidence", "ai_reasoning", "ai_model_version"]


def refresh(
    existing: DataFrame, candidates: DataFrame, opinions: DataFrame | None = None
) -> DataFrame:
    """New snapshot of the match table.

    New pairs enter as needs_review, undecided pairs take the new values, decided pairs and pairs
    that are no longer found stay as they are.
    """
    fresh = candidates
    if opinions is not None:
        fresh = fresh.join(opinions.select(*PAIR, *OPINION), PAIR, "left")
    values = ["match_method", "confidence", "evidence"]
    typed = {"ai_confidence": "double"}
    for c in OPINION:
        none = F.lit(None).cast(typed.get(c, "string"))
        fresh = fresh if c in fresh.columns else fresh.withColumn(c, none)
        existing = existing if c in existing.columns else existing.withColumn(c, none)
    values += OPINION
    old = existing.select(
        *PAIR, F.struct(*values).alias("old"), "decision", "decided_by", "decided_at"
    )
    new = fresh.select(*PAIR, F.struct(*values).alias("new"))
    undecided = F.coalesce("decision", F.lit("needs_review")) == "needs_review"
    kept = F.when(undecided & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("old"))
    return (
        old.join(new, PAIR, "full_outer")
        .withColumn("kept", kept)
        .select(
            *PAIR, "kept.*", F.coalesce("decision", F.lit("needs_review")).alias("decision"),
            "decided_by", "decided_at",
        )
    )


def run_summary(
    candidates: DataFrame, existing: DataFrame, opinions: DataFrame | None = None
) -> DataFrame:
    """Per project: candidates found, new or refreshed, skipped as decided, with an opinion."""
    decided = existing.where(F.col("decision") != "needs_review").select(
        *PAIR, F.lit(1).alias("decided")
    )
    marked = candidates.select(*PAIR).join(decided, PAIR, "left")
    if opinions is None:
        marked = marked.withColumn("ai_recommendation", F.lit(None).cast("string"))
    else:
        marked = marked.join(opinions.select(*PAIR, "ai_recommendation"), PAIR, "left")
    return marked.groupBy(*PROJECT).agg(
        F.count(F.lit(1)).alias("candidates_found"),
        F.count_if(F.col("decided").isNull()).alias("new_or_refreshed"),
        F.count("decided").alias("skipped_already_decided"),
        F.count("ai_recommendation").alias("adjudicated"),
    )


def match_list(matches: DataFrame, partners: DataFrame, decision: str | None = None) -> DataFrame:
    """Matches with both names, most confident first; ids settle ties."""
    if decision is not None:
        if decision not in K.DECISIONS:
            raise ValueError(f"decision must be one of {', '.join(K.DECISIONS)}")
        matches = matches.where(F.col("decision") == decision)
    for id_col, name in (
        ("business_partner_id", "business_partner_name"),
        ("candidate_business_partner_id", "candidate_business_partner_name"),
    ):
        names = partners.select(
            "tenant_id", F.col("id").alias(id_col), F.col("primary_name").alias(name)
        )
        matches = matches.join(names, ["tenant_id", id_col])
    return matches.orderBy(F.desc("confidence"), *PAIR)
