"""Records of one company into one account.

Records are linked by website domain, and by normalised name (or legal name) and city.
Linking is transitive, but groups that own different domains never merge. Without such a
conflict, groups are the connected components of the keys, found by pointers to the least
record id. Components that hold two domains or more need the ordered rule: domains join first, then
names in record order, refusing unions of groups with different domains. That rule, too, is rounds
of joins (`ordered_labels`), so no component goes through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W
from ..sources.records import SITE
from .staging import staged


def keyed(records: DataFrame) -> DataFrame:
    """record_id, domain, keys: the record's link keys in order (domain, then name and legal name with city)."""
    city = T.normalize_name("address.city")
    name_key = lambda n: F.when(T.normalize_name(n) != "", F.concat(F.lit("n:"), T.normalize_name(n), F.lit("\n"), city))
    domain = W.domain_of("website")
    keys = F.array_compact(F.array(F.concat(F.lit("d:"), domain), name_key("name"), name_key("legal_name")))
    return records.select("record_id", domain.alias("domain"), keys.alias("keys"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for edges (a, b): the least id reachable. Pointers are doubled each round and staged between rounds."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("near"))
        hop = label.join(near, "id").select("id", F.least("root", "near").alias("mid"), F.col("root").alias("old"))
        far = label.select(F.col("id").alias("mid"), F.col("root").alias("far"))
        new = staged(hop.join(far, "mid").select("id", F.least("mid", "far").alias("root"), "old"), "labels")
        if new.filter("root <> old").isEmpty():
            return new.select("id", "root")
        label = new.select("id", "root")


def ordered_labels(free: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of nodes without a domain, by the ordered rule; a label is a domain's node, or the node that leads a group without one.

    free: node. edges: a, b (nodes) and w, their place in the order, which no two share. Taken in that order, an edge joins two groups
    unless both own a domain. That is a minimum spanning forest in which all domains count as joined from the start: an edge between
    two groups that own one would close a ring. So it needs no order of work: in each round every group without a domain takes its
    first edge out, chains of such choices are followed by doubling pointers, and the groups are at least halved.
    """
    owned = lambda c: F.col(c).startswith("d:")
    label = staged(free.select("node", F.col("node").alias("label")), "order-labels")
    left = staged(edges.filter((F.col("a") != F.col("b")) & ~(owned("a") & owned("b"))).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w")), "order-edges")
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o"), "w"), F.struct(F.col("b").alias("c"), F.col("a").alias("o"), "w"))).alias("e")).select("e.*")
        first = ends.filter(~owned("c")).groupBy("c").agg(F.min_by("o", "w").alias("o"))
        back = first.select(F.col("c").alias("bc"), F.col("o").alias("bo"))
        both = first.join(back, (F.col("o") == F.col("bc")) & (F.col("bo") == F.col("c")), "left")  # two that chose each other: the lesser leads
        to = staged(both.select("c", F.when(F.col("bc").isNotNull() & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("to")), "order-pointers")
        while True:
            far = to.select(F.col("c").alias("fc"), F.col("to").alias("far"))
            new = staged(to.join(far, F.col("to") == F.col("fc"), "left").select("c", F.coalesce("far", "to").alias("to"), F.col("to").alias("old")), "order-pointers")
            to = new.select("c", "to")
            if new.filter("to <> old").isEmpty():
                break

        def moved(df: DataFrame, at: str, to: DataFrame = to) -> DataFrame:
            return df.join(to.select(F.col("c").alias("mc"), F.col("to").alias("mt")), F.col(at) == F.col("mc"), "left").withColumn(at, F.coalesce("mt", at)).drop("mc", "mt")

        label = staged(moved(label, "label"), "order-labels")
        left = moved(moved(left, "a"), "b").filter((F.col("a") != F.col("b")) & ~(owned("a") & owned("b")))
        left = staged(left.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w")), "order-edges")
    return label


def groups(records: DataFrame) -> DataFrame:
    """(record_id, group_id): group_id is the group's least record id. Record ids must be unique.

    Components of all keys that hold one domain at most are groups. The others go by the ordered rule: records of a domain
    are one node, then names join nodes in record order.
    """
    k = staged(keyed(records), "keys")
    keys = k.select("record_id", F.explode("keys").alias("key"))
    star = keys.groupBy("key").agg(F.min("record_id").alias("first"))
    edges = keys.join(star, "key").filter("record_id <> first").select(F.col("first").alias("a"), F.col("record_id").alias("b"))
    found = components(edges).select(F.col("id").alias("record_id"), "root")
    all_of = staged(k.join(found, "record_id", "left").withColumn("root", F.coalesce("root", "record_id")), "rooted")
    torn = all_of.groupBy("root").agg(F.min("domain").alias("lo"), F.max("domain").alias("hi")).filter("lo <> hi").select("root")
    plain = all_of.join(torn, "root", "left_anti").select("record_id", F.col("root").alias("group_id"))
    node = F.coalesce(F.concat(F.lit("d:"), "domain"), F.concat(F.lit("r:"), "record_id"))
    mixed = staged(all_of.join(torn, "root", "left_semi").select("record_id", node.alias("node"), "keys"), "torn")
    names = mixed.select("record_id", "node", F.posexplode("keys").alias("at", "key")).filter(F.col("key").startswith("n:"))
    firsts = names.groupBy("key").agg(F.min_by("node", "record_id").alias("first"))
    tied = names.join(firsts, "key").select(F.col("first").alias("a"), F.col("node").alias("b"), F.struct("record_id", "at").alias("w"))
    labels = ordered_labels(mixed.filter(F.col("node").startswith("r:")).select("node"), tied).withColumnRenamed("node", "free")
    labelled = staged(mixed.join(labels, F.col("node") == F.col("free"), "left").select("record_id", F.coalesce("label", "node").alias("label")), "labelled")
    least = labelled.groupBy("label").agg(F.min("record_id").alias("group_id"))
    return plain.unionByName(labelled.join(least, "label").select("record_id", "group_id"))


def accounts(records: DataFrame) -> DataFrame:
    """One row a group: members with a website come first, then by record id, and fill what is missing.

    The shortest spelling of the first member's normalised name names the account, and the name it
    displaces is the legal name unless there is one. Categories of a record are added if no earlier
    record had them. The site is the first with text, else the last.
    """
    has = {c.lower() for c in records.columns}
    r = records if "site" in has else records.withColumn("site", F.lit(None).cast(SITE))
    members = r.join(groups(records), "record_id")
    order = Window.partitionBy("group_id").orderBy(F.col("website").isNull(), "record_id")
    members = members.withColumn("ord", F.row_number().over(order))
    seen = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    part = lambda c: F.min_by(F.col(f"address.{c}"), F.when(F.coalesce(F.col(f"address.{c}"), F.lit("")) != "", F.col("ord"))).alias(c)
    text = F.coalesce(F.col("site.text"), F.lit("")) != ""
    one = members.groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "record_id", "source", "name", "legal_name", "categories", "evidence"))).alias("m"),
        seen("website").alias("website"), seen("phone").alias("phone"), seen("coords").alias("coords"), F.max("employees").alias("employees"),
        *[part(c) for c in ("street", "city", "region", "postal_code", "country")],
        F.coalesce(F.min_by("site", F.when(text, F.col("ord"))), F.max_by("site", F.when(F.col("site").isNotNull(), F.col("ord")))).alias("site"),
    )

    def absorb(a, x):
        plainer = (T.normalize_name(x["name"]) == T.normalize_name(a["name"])) & (F.length(x["name"]) < F.length(a["name"]))
        legal = F.when(plainer, F.coalesce(a["legal"], a["name"])).otherwise(a["legal"])
        new = F.filter(x["categories"], lambda c: ~F.array_contains(a["cats"], c))
        return F.struct(F.when(plainer, x["name"]).otherwise(a["name"]).alias("name"), F.coalesce(legal, x["legal_name"]).alias("legal"), F.concat(a["cats"], new).alias("cats"))

    first = F.col("m")[0]
    start = F.struct(first["name"].alias("name"), first["legal_name"].alias("legal"), F.array().cast("array<string>").alias("cats"))
    one = one.withColumn("f", F.aggregate("m", start, absorb))
    domain = W.domain_of("website")
    city_state = F.concat_ws("-", F.nullif(T.slug(T.normalize_name("f.name")), F.lit("")), F.nullif(T.slug("city"), F.lit("")), F.nullif(F.lower("region"), F.lit("")))
    return one.select(
        T.slug(F.coalesce(domain, city_state)).alias("account_id"), F.col("f.name").alias("name"), F.col("f.legal").alias("legal_name"), "website", domain.alias("domain"),
        F.struct("street", "city", "region", "postal_code", "country").alias("address"), "phone", F.col("f.cats").alias("categories"),
        F.array_distinct("m.source").alias("sources"), F.col("m.record_id").alias("record_ids"), F.flatten("m.evidence").alias("evidence"), "coords", "employees", "site",
    )

