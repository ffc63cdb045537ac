"""Resolution against a sequential model of the rule, in any order of the records."""

import random

from firmscope.operators import resolve
from firmscope.sources.records import RECORD

WORDS = ["Alpha", "Beta", "Gamma"]


def records(seed, n=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        site = r.choice([None, None, f"https://www.d{r.randrange(8)}.example/x", f"d{r.randrange(8)}.example"])
        name = r.choice(WORDS) + " " + str(r.randrange(5)) + r.choice(["", ", Inc.", " LLC"])
        legal = r.choice([None, None, r.choice(WORDS) + " " + str(r.randrange(5)) + " Corp"])
        city = r.choice([None, "Salem", "Reno"])
        out.append((f"s:{i:03d}", r.choice("ab"), name, legal, site, (None, city, r.choice([None, "OR"]), None, None), r.choice([None, "1"]), r.sample(["x", "y", "y", "z"], 2), [], None, r.choice([None, i])))
    return out


def norm(name):
    return " ".join(w for w in name.replace(",", " ").replace(".", " ").lower().split() if w not in ("inc", "llc", "corp"))


def host(url):
    return None if not url else url.removeprefix("https://").removeprefix("www.").split("/")[0]


def model(rows):
    rows = sorted(rows, key=lambda r: r[0])
    group = {r[0]: {r[0]} for r in rows}
    dom = {r[0]: host(r[4]) for r in rows}

    def own(ids):
        return {dom[i] for i in ids if dom[i]}

    def join(a, b):
        ga, gb = group[a], group[b]
        if ga is gb or len(own(ga) | own(gb)) > 1:
            return
        ga |= gb
        for i in gb:
            group[i] = ga

    first = {}
    for r in rows:
        if host(r[4]):
            join(first.setdefault(host(r[4]), r[0]), r[0])
    first = {}
    for r in rows:
        for n in (r[2], r[3]):
            if n:
                join(first.setdefault((norm(n), (r[5][1] or "").lower()), r[0]), r[0])
    return {i: min(g) for i, g in group.items()}


def test_groups_equal_the_sequential_rule(spark):
    for seed in range(4):
        rows = records(seed)
        want = model(rows)
        random.Random(seed).shuffle(rows)
        got = {r.record_id: r.group_id for r in resolve.groups(spark.createDataFrame(rows, RECORD)).collect()}
        assert got == want


def test_rounds_follow_long_chains(spark):
    """Records in one long line of shared names, few of them with a domain, in an order that makes groups meet late."""
    r = random.Random(5)
    order = list(range(120))
    r.shuffle(order)
    rows = []
    for k, i in enumerate(order):
        site = f"d{i % 3}.example" if i % 17 == 0 else None
        rows.append((f"s:{k:03d}", "a", f"Link {i}", f"Link {i + 1}", site, (None, None, None, None, None), None, [], [], None, None))
    want = model(rows)
    got = {x.record_id: x.group_id for x in resolve.groups(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == want and len(set(want.values())) == 3


def fold(members):
    a = dict(name=members[0][2], legal=members[0][3], cats=[], site=members[0][4], phone=None, emp=None, city=None)
    for m in members:
        if norm(m[2]) == norm(a["name"]) and len(m[2]) < len(a["name"]):
            a["legal"], a["name"] = a["legal"] or a["name"], m[2]
        a["cats"] += [c for c in m[7] if c not in a["cats"]]
        a["legal"] = a["legal"] or m[3]
        a["phone"] = a["phone"] or m[6]
        a["city"] = a["city"] or m[5][1]
        a["emp"] = m[10] if a["emp"] is None else max(a["emp"], m[10] or 0)
    return a


def test_accounts_fold_in_order(spark):
    rows = records(9)
    got = {tuple(r.record_ids): r for r in resolve.accounts(spark.createDataFrame(rows, RECORD)).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(model(rows)[r[0]], []).append(r)
    assert len(got) == len(groups)
    for members in groups.values():
        members.sort(key=lambda r: (r[4] is None, r[0]))
        a, r = fold(members), got[tuple(m[0] for m in members)]
        assert (r.name, r.legal_name, r.categories, r.website, r.phone, r.employees, r.address.city) == (a["name"], a["legal"], a["cats"], a["site"], a["phone"], a["emp"], a["city"])


def test_empty(spark):
    assert resolve.accounts(spark.createDataFrame([], RECORD)).count() == 0
