"""Conversation structure repair by generalised LR parsing with edits.

The roles of a conversation are a sentence of a small grammar. An LR table is built from its productions; a
parse is a stack of its states. Repair follows all parses at once: each row may be kept (if its role can
be shifted), given another role, or deleted, and before a row empty turns may be inserted, at a cost
each. Stacks share their lower parts, and as this grammar is left-recursive their depth is bounded, so the
tops that can occur are a short list; parses whose stacks are equal merge into the one of the least
(cost, audit), the audit being the initials of its edits. At equal cost no audit of equal stacks is the
beginning of another, as the rest could only be insertions, so what follows never turns the order.

Rows are sorted over all tasks and cut into segments. A segment is parsed from every stack that could
stand before it, which gives a table from stack to stack, and a conversation's tables are folded in two
levels (segments of a task, tasks). So no conversation has to be in one task; equal sequences of turns are
parsed once per task. Last, the texts stream by in order, with the audit ahead of them, to be hashed; a
conversation's hash is one stream by its nature, and holds one row at a time.

Defined results: nulls in the key, role and text are one space; a null ``conv_id`` is a conversation; rows of
one turn are ordered by role and text. A conversation without rows has the empty repair. An empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbalance.llm.common import SPACE, TASK_BITS, cut, in_order

#: Role initials of a good conversation: nothing, or turns of user and assistant, perhaps after a system row.
GRAMMAR = (("conversation", ()), ("conversation", ("turns",)), ("conversation", ("s", "turns")), ("turns", ("u", "a")), ("turns", ("turns", "u", "a")))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A segment is what has equal ``at`` above these bits: at most 1,024 rows.
SEGMENT_BITS = 10
GOOD, BLANK, DUPLICATE, CUT_OFF = 0, 1, 2, 3

Stack = tuple[int, ...]
Best = dict[int, tuple[int, str]]


def lr_table(grammar: Sequence[tuple[str, tuple[str, ...]]]) -> tuple[dict, dict]:
    """SLR(1) table: (shift and goto by state and symbol, production to reduce by state and terminal); "$" ends."""
    rules = [("", (grammar[0][0],)), *grammar]
    inner = {head for head, _ in rules}

    def closed(items: set) -> frozenset:
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            if dot < len(rules[rule][1]):
                new = {(k, 0) for k, (head, _) in enumerate(rules) if head == rules[rule][1][dot]} - items
                items |= new
                todo += new
        return frozenset(items)

    # what can follow: terminals only, as no inner symbol but the first has an empty form and that one is last
    first: dict[str, set] = {h: set() for h in inner}
    follow: dict[str, set] = {h: set() for h in inner}
    follow[""].add("$")
    grown = True
    while grown:
        before = sum(map(len, first.values())) + sum(map(len, follow.values()))
        for head, body in rules:
            if body:
                first[head] |= first[body[0]] if body[0] in inner else {body[0]}
            for here, after in zip(body, [*body[1:], None], strict=False):
                if here in inner:
                    follow[here] |= follow[head] if after is None else first[after] if after in inner else {after}
        grown = before != sum(map(len, first.values())) + sum(map(len, follow.values()))

    states, moves, reduces = [closed({(0, 0)})], {}, {}
    for at, items in enumerate(states):
        for symbol in sorted({rules[k][1][dot] for k, dot in items if dot < len(rules[k][1])}):
            to = closed({(k, dot + 1) for k, dot in items if dot < len(rules[k][1]) and rules[k][1][dot] == symbol})
            if to not in states:
                states.append(to)
            moves[at, symbol] = states.index(to)
        for k, dot in items:
            if dot == len(rules[k][1]):
                reduces.update({(at, t): (len(rules[k][1]), rules[k][0]) for t in follow[rules[k][0]]})
    return moves, reduces


def stacks(grammar: Sequence[tuple[str, tuple[str, ...]]] = GRAMMAR) -> tuple[list[dict[str, int]], set[int]]:
    """(per stack the stack after each terminal that can be shifted, stacks at which a sentence may end).

    Number 0 is the stack of an empty sentence; numbers are the same in every process. A grammar whose stacks aren't bounded has no such list.
    """
    moves, reduces = lr_table(grammar)
    terminals = sorted({x for _, body in grammar for x in body} - {head for head, _ in grammar})

    def reduced(stack: Stack, ahead: str) -> Stack:
        while (stack[-1], ahead) in reduces:
            size, head = reduces[stack[-1], ahead]
            stack = stack[:len(stack) - size]
            if head == "":
                return ()
            stack = (*stack, moves[stack[-1], head])
        return stack

    found, table, ends = [(0,)], [], set()
    for number, stack in enumerate(found):
        after = {}
        for t in terminals:
            top = reduced(stack, t)
            if (top[-1], t) in moves:
                to = (*top, moves[top[-1], t])
                if to not in found:
                    found.append(to)
                after[t] = found.index(to)
        table.append(after)
        if reduced(stack, "$") == ():
            ends.add(number)
    return table, ends


_TABLE, _ENDS = stacks()


def _put(best: Best, stack: int, cost: int, audit: str) -> bool:
    if stack in best and best[stack] <= (cost, audit):
        return False
    best[stack] = (cost, audit)
    return True


def _with_insertions(best: Best) -> Best:
    """The stacks that inserted turns lead to as well."""
    todo = list(best)
    while todo:
        stack = todo.pop()
        cost, audit = best[stack]
        for role in ROLES:
            to = _TABLE[stack].get(role)
            if to is not None and _put(best, to, cost + INSERT, audit + "I"):
                todo.append(to)
    return best


def parsed(best: Best, rows: str) -> Best:
    """The stacks after ``rows``, two characters each: role initial and fault."""
    best = _with_insertions(dict(best))
    for initial, fault in zip(rows[::2], map(int, rows[1::2]), strict=True):
        after: Best = {}
        extra = TRUNCATED if fault == CUT_OFF else 0
        for stack, (cost, audit) in best.items():
            _put(after, stack, cost + DELETE, audit + "D")
            if fault in (GOOD, CUT_OFF):
                if (to := _TABLE[stack].get(initial)) is not None:
                    _put(after, to, cost + extra, audit + "K")
                for role in ROLES:
                    if (to := _TABLE[stack].get(role)) is not None:
                        _put(after, to, cost + REROLE + extra, audit + "R")
        best = _with_insertions(after)
    return best


@lru_cache(maxsize=4096)
def transfer(rows: str) -> tuple[tuple[int, int, int, str], ...]:
    """(stack before, stack after, cost, audit) of a segment."""
    return tuple((start, end, *cost) for start in range(len(_TABLE)) for end, cost in parsed({start: (0, "")}, rows).items())


def folded(tables: Sequence[Sequence[tuple[int, int, int, str]]]) -> list[tuple[int, int, int, str]]:
    """One table for segments that follow each other."""
    now: dict[int, Best] = {start: {start: (0, "")} for start in range(len(_TABLE))}
    for table in tables:
        after: dict[int, Best] = {start: {} for start in now}
        for mid, end, cost, audit in table:
            for start, best in now.items():
                if mid in best:
                    _put(after[start], end, best[mid][0] + cost, best[mid][1] + audit)
        now = after
    return [(start, end, *cost) for start, best in now.items() for end, cost in best.items()]


_FACTS = (("n", 0), ("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT_OFF))
_PART = "conv_id long, task long, at long, first string, last string, illegal long, blank long, duplicate long, truncated long, moves array<struct<a: int, b: int, c: long, d: string>>"
_PART_TYPE = pa.schema([("conv_id", pa.int64()), ("task", pa.int64()), ("at", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                        ("moves", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("c", pa.int64()), ("d", pa.string())])))])


def _illegal(one: str, other: str) -> bool:
    return one + other not in ("su", "ua", "au")


def _moves(table: Sequence[tuple[int, int, int, str]]) -> list[dict]:
    return [dict(zip("abcd", x, strict=True)) for x in table]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation and segment; rows come sorted by ``at`` within each segment."""
    held: list | None = None

    def part(rows: list) -> dict:
        conv_id, at = rows[0][:2]
        initials, faults = [r[2] for r in rows], [r[3] for r in rows]
        code = "".join((i if i in ("s", "u", "a") else "-") + str(f) for i, f in zip(initials, faults, strict=True))
        return {"conv_id": conv_id, "task": at >> TASK_BITS, "at": at, "first": initials[0], "last": initials[-1],
                "illegal": sum(map(_illegal, initials, initials[1:])), **{name: faults.count(f) for name, f in _FACTS[1:]}, "moves": _moves(transfer(code))}

    for batch in batches:
        out = []
        for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "at", "initial", "fault")), strict=True):
            if held and (held[0][0], held[0][1] >> SEGMENT_BITS) == (row[0], row[1] >> SEGMENT_BITS):
                held.append(row)
                continue
            if held:
                out.append(part(held))
            held = [row]
        yield pa.RecordBatch.from_pylist(out, schema=_PART_TYPE)
    if held:
        yield pa.RecordBatch.from_pylist([part(held)], schema=_PART_TYPE)


def _joined(parts: pa.Table) -> pa.Table:
    """The parts of one conversation, or of one task's share of it, as one part."""
    parts = parts.sort_by("at").to_pylist()
    whole = {**parts[0], "last": parts[-1]["last"], **{c: sum(p[c] for p in parts) for c in ("illegal", "blank", "duplicate", "truncated")}}
    whole["illegal"] += sum(_illegal(p["last"], q["first"]) for p, q in zip(parts, parts[1:], strict=False))
    whole["moves"] = _moves(folded([[tuple(m.values()) for m in p["moves"]] for p in parts]))
    return pa.Table.from_pylist([whole], schema=_PART_TYPE)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's audit comes before its rows; only one row is held at a time."""
    head: dict | None = None
    state: dict = {}

    def begin(row: dict) -> None:
        state.update(stack=0, edits=iter(row["audit"]), digest=hashlib.sha256(), empty=True)

    def add(role: str, text: str) -> None:
        state["stack"] = _TABLE[state["stack"]][role[:1]]
        state["digest"].update(("" if state["empty"] else "\n").encode() + f"{role}:{text}".encode())
        state["empty"] = False

    def made() -> str:
        return next(ROLES[r] for r in _TABLE[state["stack"]] if r in ROLES)

    def take(row: dict) -> None:
        for edit in state["edits"]:
            if edit == "I":
                add(made(), "")
                continue
            if edit != "D":
                add(row["role"] if edit == "K" else made(), row["text"])
            return

    def end() -> dict:
        for _ in state["edits"]:  # insertions after the last row
            add(made(), "")
        return {**head, "repaired_sha256": state["digest"].hexdigest()}

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in names])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["audit"] is None:
                take(row)
                continue
            if head is not None:
                out.append(end())
            head = {c: row[c] for c in names[:-1]}
            begin(row)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if head is not None:
        yield pa.RecordBatch.from_pylist([end()], schema=schema)


def damaged(conversations: DataFrame, kind: Column) -> DataFrame:
    """Rows as ``kind`` damages them: 0 is lost, 1 loses its text, 2 its sentence ends, 3 comes twice, 4 becomes the
    user's. Lost rows are marked, not left out."""
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), (kind == 0).alias("lost"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("kind"))
    return rows.select("conv_id", "turn", "lost", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def repair(rows: DataFrame) -> DataFrame:
    """Per ``conv_id`` of ``rows(conv_id, turn, lost, role, text)``: gaps, faults, cost, audit and the hash of its repair.
    Rows that are ``lost`` only tell that their conversation exists."""
    turns = rows.groupBy("conv_id", "turn").agg(F.bool_and("lost").alias("lost"))
    kept = F.when(~F.col("lost"), F.col("turn"))
    spans = turns.groupBy("conv_id").agg(F.coalesce(F.max(kept) - F.min(kept) + 1 - F.count(kept), F.lit(0)).alias("gaps"))

    there = rows.where("not lost").select("conv_id", "turn", "role", "text", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"))
    ordered = in_order(there, F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("same"))
    bare = F.rtrim("text", F.lit(SPACE.decode()))
    own = cut(ordered.select("conv_id", "at", F.substring("role", 1, 1).alias("initial"), "same", (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended")))
    firsts = own.groupBy("conv_id", "same").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_conv"), F.col("same").alias("_same"), "first")
    seen = own.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("same") == F.col("_same")), "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("at") > F.col("first"), DUPLICATE).when(~F.col("ended"), CUT_OFF).otherwise(GOOD)
    thin = seen.select("conv_id", "at", "initial", fault.alias("fault"), F.shiftright("at", SEGMENT_BITS).alias("segment"))
    parts = cut(thin.repartition("segment").sortWithinPartitions("at").mapInArrow(_segments, _PART))

    several = parts.groupBy(F.col("conv_id").alias("_conv")).agg(F.count("*").alias("n")).where("n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    shares = parts.join(several, same, "left_semi").groupBy("conv_id", "task").applyInArrow(_joined, _PART)
    wholes = parts.join(several, same, "left_anti").unionByName(shares.groupBy("conv_id").applyInArrow(_joined, _PART))

    closing = F.filter("moves", lambda m: (m.a == 0) & m.b.isin(sorted(_ENDS)))
    best = F.array_min(F.transform(closing, lambda m: F.struct(m.c.alias("cost"), m.d.alias("audit"))))
    facts = [F.col(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    found = wholes.select(F.col("conv_id").alias("_conv"), *facts, best.alias("best"))
    heads = spans.join(found, same, "left").select(
        "conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "gaps",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(name) for c, name in zip(facts, ("blank", "duplicate", "truncated", "illegal"), strict=True)],
        F.coalesce("best.cost", F.lit(0)).alias("cost"), F.coalesce("best.audit", F.lit("")).alias("audit"))
    both = heads.unionByName(ordered.select("conv_id", "at", "role", "text"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "at").mapInArrow(
        _hashed, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
