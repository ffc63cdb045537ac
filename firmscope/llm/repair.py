"""Repair of damaged conversations: the cheapest edits that give each a legal sequence of roles.

A conversation's rows become symbols: whose turn it is (system, user, assistant, other) and
whether the row has to go or is cut off. What a run of symbols does to the roles so far is a
4 x 4 transfer matrix in the (min, +) semiring over the states START, SYSTEM, USER and ASSISTANT;
an entry holds the cost and, as a rope, the edits. Re-Pair finds the pairs of symbols that stand
together most often in all conversations, and each rule's matrix is worked out once, from the
matrices of its two parts. A conversation is then the product of the few symbols left of it.

Ties. Of edits with equal cost the least in ASCII order is asked for. Two ropes over the same rows
from one state end in a row's letter, and as the letters decide the roles, ropes into different states
differ before one of them ends. So a row of the matrix needs only the order of its four ropes, and the
order of a product's ropes follows from the orders of its factors: no rope is spelled out to compare it.

Scale. Long conversations are cut into blocks of rows. Blocks are evaluated side by side; what goes
through one task in order is a block's 16 entries, not its rows, and the digest of the repaired text,
which is sequential by definition and is taken from sorted rows as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rank_in_group, stage

BLOCK_ROWS = 1024
START, SYSTEM, USER, ASSISTANT = range(4)
COSTS = {"K": 0, "I": 2, "R": 2, "D": 3}
CUT_OFF = 1
#: Symbols: role's initial, capital if the row is cut off; - for a row that has to go. Rules get characters from RULES on.
SYMBOLS, RULES = "suaxSUAX-", 0x4E00
BLANK = r"\x20\x09-\x0D"


# ---------------------------------------------------------------- damage and faults


def damage(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text; nulls read as one space) after the damage that their key's checksum names.

    Checksum modulo 20: 0 drops the row, 1 empties its text, 2 takes full stops, exclamation and
    question marks out, 3 repeats it, 4 makes the user its speaker.
    """
    space = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.where("kind <> 0").withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("kind")


def find_faults(rows: DataFrame) -> DataFrame:
    """Adds `pos` (rows of a conversation from 0 by turn, those without one first; ties by role and text) and `fault`.

    blank: no character but white space; duplicate: role and text stood in an earlier row;
    truncated: the last character isn't a full stop, exclamation or question mark. The first that holds counts; else null.
    """
    placed = rank_in_group(rows, ["conv_id"], "turn", ["role", "text"], "pos")
    placed = stage(placed.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), "repair-rows")
    again = placed.groupBy(F.col("conv_id").alias("a_conv"), F.col("digest").alias("a_digest")).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    found = placed.join(again.where("n > 1"), F.col("conv_id").eqNullSafe(F.col("a_conv")) & (F.col("digest") == F.col("a_digest")), "left")
    fault = (
        F.when(~F.col("text").rlike(f"[^{BLANK}]"), "blank").when(F.col("first") < F.col("pos"), "duplicate").when(~F.col("text").rlike(rf"[.!?][{BLANK}]*\z"), "truncated")
    )
    return found.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "pos", "fault")


def initial(role: Column) -> Column:
    """s, u or a; x for any other role."""
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def symbol(role: Column, fault: Column) -> Column:
    own = initial(role)
    return F.when(fault.isin("blank", "duplicate"), "-").when(fault == "truncated", F.upper(own)).otherwise(own)


def in_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """One row a block of at most `block_rows` rows: its symbols and initials as strings, and its counts."""
    one = F.struct("pos", symbol(F.col("role"), F.col("fault")).alias("s"), initial(F.col("role")).alias("i"), "turn")
    count = lambda kind: F.count_if(F.coalesce(F.col("fault") == kind, F.lit(False))).alias(kind)
    blocks = rows.groupBy("conv_id", F.floor(F.col("pos") / block_rows).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(one)).alias("rows"), count("blank"), count("duplicate"), count("truncated")
    )
    initials = F.array_join("rows.i", "")
    legal = F.regexp_count(initials, F.lit("(?=su|ua|au)"))
    turns = F.array_distinct(F.filter("rows.turn", lambda t: t.isNotNull()))
    return blocks.select(
        "conv_id", "block", "blank", "duplicate", "truncated",
        F.array_join("rows.s", "").alias("symbols"),
        F.substring(initials, 1, 1).alias("first_initial"), F.substring(initials, -1, 1).alias("last_initial"),
        (F.size("rows") - 1 - legal).cast("long").alias("illegal"),
        F.array_min(turns).alias("first_turn"), F.array_max(turns).alias("last_turn"), F.size(turns).cast("long").alias("turns"),
    )


# ---------------------------------------------------------------- grammar


def learn_rules(blocks: DataFrame, most: int = 160, a_round: int = 32) -> list[tuple[str, str]]:
    """Re-Pair over all blocks' symbols: (pair, the character that stands for it), parts before what they are part of.

    Pairs are counted in all blocks by Spark. A round takes the most frequent ones that can't overlap
    each other (no symbol is both the first of one and the second of another), so that a round of
    counting serves many rules. Rules only shorten the work: without any, the results are the same.
    """
    rules: list[tuple[str, str]] = []
    short = F.col("symbols")
    while len(rules) < most:
        pairs = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))
        counts = blocks.select(short.alias("s")).where(F.length("s") > 1).select(F.explode(pairs).alias("pair")).groupBy("pair").count().where("count > 1")
        best = counts.orderBy(F.desc("count"), "pair").limit(4 * a_round).collect()
        firsts: set[str] = set()
        seconds: set[str] = set()
        chosen = []
        for a, b in [r["pair"] for r in best]:
            if len(chosen) == a_round or len(rules) + len(chosen) == most:
                break
            if a in seconds or b in firsts or (a == b and (a in firsts or b in seconds)):
                continue
            if a == b and (firsts or seconds):  # a run of one symbol overlaps itself, so it gets a round of its own
                continue
            firsts.add(a), seconds.add(b), chosen.append(a + b)
            if a == b:
                break
        if not chosen:
            break
        for pair in chosen:
            rules.append((pair, chr(RULES + len(rules))))
            short = F.replace(short, F.lit(rules[-1][0]), F.lit(rules[-1][1]))
    return rules


# ---------------------------------------------------------------- transfer matrices

#: An entry: cost, place of its rope among those of its row, rope (a string, or two ropes); None where there's no way.
Entry = tuple[int, int, object] | None
Matrix = list[list[Entry]]

_AFTER = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}


def _due(state: int) -> str:
    """Who speaks next."""
    return "a" if state == USER else "u"


def _ranked(row: list[tuple[int, object, object] | None]) -> list[Entry]:
    """Entries (cost, what orders the ropes, rope) with the ropes' places."""
    order = sorted(e[1] for e in row if e)
    return [e and (e[0], order.index(e[1]), e[2]) for e in row]


def symbol_matrix(sym: str) -> Matrix:
    """What one row does, after any insertions before it."""
    matrix = []
    for start in range(4):
        best: list[tuple[int, str, str] | None] = [None] * 4
        state, before = start, ""
        for _ in range(3):  # more insertions come back to the same states
            ways = [(state, "D", COSTS["D"])]
            if sym != "-":
                extra = CUT_OFF if sym.isupper() else 0
                ways.append((_AFTER[_due(state), state], "R", COSTS["R"] + extra))
                if (sym.lower(), state) in _AFTER:
                    ways.append((_AFTER[sym.lower(), state], "K", COSTS["K"] + extra))
            for to, letter, cost in ways:
                way = (cost + COSTS["I"] * len(before), before + letter, before + letter)
                if best[to] is None or way < best[to]:
                    best[to] = way
            state, before = _AFTER[_due(state), state], before + "I"
        matrix.append(_ranked(best))
    return matrix


def product(a: Matrix, b: Matrix) -> Matrix:
    """First a, then b."""
    out = []
    for row in a:
        best: list[tuple[int, tuple[int, int], object] | None] = [None] * 4
        for mid, one in enumerate(row):
            if one is None:
                continue
            for to, two in enumerate(b[mid]):
                if two is None:
                    continue
                cost, order = one[0] + two[0], (one[1], two[1])
                if best[to] is None or (cost, order) < best[to][:2]:
                    best[to] = (cost, order, (one[2], two[2]))
        out.append(_ranked(best))
    return out


def spelled(rope: object) -> str:
    """A rope's letters."""
    letters, left = [], [rope]
    while left:
        part = left.pop()
        if isinstance(part, str):
            letters.append(part)
        else:
            left += [part[1], part[0]]
    return "".join(letters)


def rule_matrices(rules: list[tuple[str, str]]) -> dict[str, Matrix]:
    """One matrix a symbol and a rule, bottom up."""
    known = {s: symbol_matrix(s) for s in SYMBOLS}
    for pair, name in rules:
        known[name] = product(known[pair[0]], known[pair[1]])
    return known


class Evaluator:
    """Matrices of symbol strings; those met lately are kept, as many conversations share one."""

    def __init__(self, rules: list[tuple[str, str]], keep: int = 20_000):
        self.rules, self.known = rules, rule_matrices(rules)
        self.entries = lru_cache(keep)(self._entries)

    def matrix(self, symbols: str) -> Matrix:
        for pair, name in self.rules:
            symbols = symbols.replace(pair, name)
        parts = [self.known[s] for s in symbols]
        while len(parts) > 1:
            parts = [product(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def _entries(self, symbols: str) -> tuple[list[int | None], list[int | None], list[str | None]]:
        flat = [e for row in self.matrix(symbols) for e in row]
        return [e and e[0] for e in flat], [e and e[1] for e in flat], [e and spelled(e[2]) for e in flat]


def evaluated(blocks: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds each block's 16 entries: costs, orders, audits (null where there's no way)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluate = Evaluator(rules)
        for batch in batches:
            found = [evaluate.entries(s) for s in batch.column("symbols").to_pylist()]
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()))
            more = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "costs", "orders", "audits"])

    return blocks.mapInArrow(run, _ddl(blocks) + ", costs array<long>, orders array<int>, audits array<string>")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


# ---------------------------------------------------------------- the way through a conversation


def _steps(symbols: str, audit: str, state: int) -> tuple[list[str], str, int]:
    """Of each row who speaks before it (inserted), then K, D, or U or A for a new role; those inserted behind the last; the state."""
    steps, before, at = [], "", 0
    for letter in audit:
        if letter == "I":
            before += _due(state)
            state = _AFTER[_due(state), state]
            continue
        own = symbols[at].lower()
        if letter == "R":
            own = _due(state)
        if letter != "D":
            state = _AFTER[own, state]
        steps.append(before + (own.upper() if letter == "R" else letter))
        before, at = "", at + 1
    return steps, before, state


class _Way:
    """The blocks of one conversation in their order: costs and backward pointers by state, and counts."""

    def __init__(self) -> None:
        self.now: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self.blocks: list[tuple[dict, list[int]]] = []
        self.total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.first_turn = self.last_turn = None
        self.last_initial = ""

    def add(self, b: dict) -> None:
        best: list[tuple[int, tuple[int, int], int] | None] = [None] * 4
        for state, had in enumerate(self.now):
            if had is None:
                continue
            for to in range(4):
                at = 4 * state + to
                if b["costs"][at] is not None:
                    way = (had[0] + b["costs"][at], (had[1], b["orders"][at]), state)
                    if best[to] is None or way < best[to]:
                        best[to] = way
        order = sorted(e[1] for e in best if e)
        self.now = [e and (e[0], order.index(e[1])) for e in best]
        self.blocks.append(({"block": b["block"], "symbols": b["symbols"], "audits": b["audits"]}, [e[2] if e else -1 for e in best]))
        for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
            self.total[k] += b[k]
        if self.last_initial and self.last_initial + b["first_initial"] not in ("su", "ua", "au"):
            self.total["illegal"] += 1
        self.last_initial = b["last_initial"]
        if b["first_turn"] is not None:
            if self.last_turn == b["first_turn"]:
                self.total["turns"] -= 1
            self.first_turn = b["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = b["last_turn"]

    def done(self, conv_id: object) -> Iterator[dict]:
        """A row a block; the last carries what holds for the whole conversation."""
        behind = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
        ends = [(had[0] + COSTS["I"] * behind[s], had[1], s) for s, had in enumerate(self.now) if had]
        cost, _, state = min(ends)
        tail = "I" * behind[state]
        chosen = []
        for block, back in reversed(self.blocks):
            start = back[state]
            chosen.append((block, start, block["audits"][4 * start + state]))
            state = start
        chosen.reverse()
        whole = "".join(a for _, _, a in chosen) + tail
        for i, (block, start, audit) in enumerate(chosen):
            last = i + 1 == len(chosen)
            steps, after, _ = _steps(block["symbols"], audit + tail * last, start)
            row = {"conv_id": conv_id, "block": block["block"], "steps": steps, "after": after, "total": None}
            if last:
                turns = self.total.pop("turns")
                gaps = self.last_turn - self.first_turn + 1 - turns if self.first_turn is not None else 0
                row["total"] = {"gaps": gaps, **self.total, "cost": cost, "audit": whole}
            yield row


_TOTAL = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def cheapest_ways(entries: DataFrame) -> DataFrame:
    """Of each block the edits that are part of its conversation's cheapest way, and on its last block the totals.

    A conversation's blocks come by one after another; only entries do, no texts.
    """
    conv = entries.schema["conv_id"].dataType.simpleString()
    total = pa.struct([*[(c, pa.int64()) for c in _TOTAL], ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        kind = None
        way, of, began = _Way(), None, False
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for b in batch.to_pylist():
                if began and b["conv_id"] != of:
                    out += way.done(of)
                    way = _Way()
                of, began = b["conv_id"], True
                way.add(b)
            if len(out) > 5000:
                yield _rows(out, kind)
                out = []
        if began:
            out += way.done(of)
            yield _rows(out, kind)

    def _rows(out: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        schema = pa.schema([("conv_id", kind), ("block", pa.int64()), ("steps", pa.list_(pa.string())), ("after", pa.string()), ("total", total)])
        return pa.RecordBatch.from_pylist(out, schema)

    ordered = entries.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    fields = ", ".join(f"{c}: long" for c in _TOTAL)
    return ordered.mapInArrow(run, f"conv_id {conv}, block long, steps array<string>, after string, total struct<{fields}, audit: string>")


# ---------------------------------------------------------------- results


def repaired_rows(rows: DataFrame, ways: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repaired conversations: conv_id, pos and part (their order), role, text, edit (K, R or I)."""
    name = lambda c: F.when(c == "u", "user").otherwise("assistant")
    w = ways.withColumnRenamed("conv_id", "w_conv").withColumnRenamed("block", "w_block")
    block = F.floor(rows["pos"] / block_rows).cast("long")
    joined = rows.join(w, rows["conv_id"].eqNullSafe(w["w_conv"]) & (block == w["w_block"]))
    at = (F.col("pos") % block_rows).cast("int")
    step = F.col("step")
    joined = joined.select("conv_id", "pos", "role", "text", F.get("steps", at).alias("step"), F.when(at == F.size("steps") - 1, F.col("after")).otherwise("").alias("after"))
    said = lambda role, text, edit: F.struct(role.alias("role"), text.alias("text"), F.lit(edit).alias("edit"))
    inserted = lambda who: F.transform(F.filter(F.split(who, ""), lambda c: c != ""), lambda c: said(name(c), F.lit(""), "I"))
    act = F.substring(step, -1, 1)
    own = F.when(act == "K", F.array(said(F.col("role"), F.col("text"), "K"))).when(act == "D", F.array().cast("array<struct<role:string,text:string,edit:string>>"))
    own = own.otherwise(F.array(said(name(F.lower(act)), F.col("text"), "R")))
    every = F.concat(inserted(F.expr("substring(step, 1, length(step) - 1)")), own, inserted(F.col("after")))
    return joined.select("conv_id", "pos", F.posexplode(every).alias("part", "said")).select("conv_id", "pos", "part", "said.*")


def text_digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's `role:text` lines, taken as the sorted rows stream by."""
    conv = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, digest, kind = None, None, None
        out: list[tuple] = []
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if digest is None or conv_id != of:
                    if digest is not None:
                        out.append((of, digest.hexdigest()))
                    of, digest = conv_id, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out])], ["conv_id", "repaired_sha256"])
                out = []
        if digest is not None:
            out.append((of, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out])], ["conv_id", "repaired_sha256"])

    lines = repaired.select("conv_id", "pos", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "part").select("conv_id", "line")
    return ordered.mapInArrow(run, f"conv_id {conv}, repaired_sha256 string")


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Repairs conversations (conv_id, turn, role, text, without nulls in role and text).

    Returns the repaired rows and a row a conversation with its totals: gaps, blank, duplicate, truncated, illegal, cost, audit.
    A conversation without rows isn't among them; an empty table gives none.
    """
    marked = stage(find_faults(rows), "repair-faults")
    blocks = stage(in_blocks(marked, block_rows), "repair-blocks")
    ways = stage(cheapest_ways(evaluated(blocks, learn_rules(blocks))), "repair-ways")
    totals = ways.where(F.col("total").isNotNull()).select("conv_id", "total.*")
    return repaired_rows(marked, ways, block_rows), totals


def repair_report(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Damage and repair of all conversations: one row for each conv_id of the table.

    Null roles, texts, and null parts of the damage key read as one space; a null conv_id is a conversation of its own.
    A role that doesn't begin with s, u or a can't be kept. Rows of one turn stand by role and text, repeated rows
    side by side. A conversation that lost all rows has zeros, an empty audit and the digest of the empty string.
    """
    repaired, totals = repair(damage(conversations), block_rows)
    digests = text_digests(repaired)
    out = conversations.select("conv_id").distinct()
    for part in (totals, digests):
        p = part.withColumnRenamed("conv_id", "p_conv")
        out = out.join(p, out["conv_id"].eqNullSafe(p["p_conv"]), "left").drop("p_conv")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
