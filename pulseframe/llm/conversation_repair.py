"""Conversation structure repair by a persistent audit DP.

A conversation's rows are read in order of their turns. Each is kept, given the role user or assistant, or deleted, and
rows without text may be inserted, so that role initials read ``(s?(ua)+)?`` at least cost. The audit is the string of the edits' initials; among
audits of one cost the ASCII-least counts.

The DP goes row by row over the four states of that pattern. Its audits are linked nodes that share their prefixes. A node has its ancestors at
distances of powers of two and a rolling hash of its string; two audits of one cost are compared at the end of their longest common
prefix, which is found by descending over ancestors of equal hash. Nodes are interned by (parent, edit), so that equal strings are one
node: a hash that agrees for two different nodes is a collision and counts as different.

Rows of a conversation are cut into blocks. A block gives, for each pair of states, the best audit from one to the other. Audits of
one block consume the same rows and end with one of them, so none is a proper prefix of another, and blocks compose by
cost and by the order of their audits. So a conversation of any length is shared by tasks, as its rows lie in several
range partitions, and nodes are held for one block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a block of the DP.
BLOCK_ROWS = 4_096
#: Edits and their costs; a row that is truncated and stays costs more.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: States: nothing yet, behind s, behind u, behind a; from each the state behind an initial. Accepted: nothing, behind a.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
START, AFTER_A = 0, 3
#: The initials that a row of a conversation can be followed by.
LEGAL_PAIRS = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}

#: The characters of [\\x20\\x09-\\x0D].
WHITE = " \t\n\x0b\f\r"
HEAD = 64
MODULUS, BASE = (1 << 61) - 1, 1_000_003

COUNTS = ("blank", "duplicate", "truncated", "illegal")
PARTS = "conv_id long, whole boolean, place array<long>, least long, most long, turns long, first_turn long, last_turn long, first string, last string, rows long, blank long, duplicate long, truncated long, illegal long, cost array<long>, audit array<string>"
AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Trie:
    """Audits as linked nodes; node 0 is the empty one."""

    def __init__(self) -> None:
        self.up: list[list[int]] = [[]]
        self.edit, self.depth, self.hash = [""], [0], [0]
        self.child: dict[tuple[int, str], int] = {}

    def add(self, parent: int, edits: str) -> int:
        for edit in edits:
            node = self.child.get((parent, edit))
            if node is None:
                node = self.child[parent, edit] = len(self.edit)
                ancestors, k = [parent], 0
                while k < len(self.up[ancestors[k]]):
                    ancestors.append(self.up[ancestors[k]][k])
                    k += 1
                self.up.append(ancestors)
                self.edit.append(edit)
                self.depth.append(self.depth[parent] + 1)
                self.hash.append((self.hash[parent] * BASE + ord(edit)) % MODULUS)
            parent = node
        return parent

    def lift(self, node: int, depth: int) -> int:
        """The ancestor of ``node`` at ``depth``."""
        up = self.depth[node] - depth
        k = 0
        while up:
            if up & 1:
                node = self.up[node][k]
            up >>= 1
            k += 1
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two strings are equal: by hash, and then by node, since equal strings are one node."""
        return self.hash[a] == self.hash[b] and a == b

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` is before that of ``b``: they are compared behind their longest common prefix."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, depth), self.lift(b, depth)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and not self.same(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.edit[x] < self.edit[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))


#: From each state: (state, inserts) that up to two inserted rows lead to, none included.
INSERTS = tuple(tuple({s: 0, **{t: 1 for t in [NEXT[s][c] for c in "ua" if c in NEXT[s]]}, **{NEXT[t][d]: 2 for t in [NEXT[s][c] for c in "ua" if c in NEXT[s]] for d in "ua" if d in NEXT[t] and NEXT[t][d] not in (s, t)}}.items()) for s in range(4))


@lru_cache(maxsize=1 << 17)
def row_steps(code: str) -> tuple[tuple[int, int, int, str], ...]:
    """All (state, state, cost, edits) of inserting before a row and editing it. ``code``: initial and fault (b blank or duplicate, t truncated, - none)."""
    initial, fault = code[:-1], code[-1]
    stay = TRUNCATED_COST if fault == "t" else 0
    found = []
    for s in range(4):
        for t, n in INSERTS[s]:
            found.append((s, t, n * INSERT_COST + DELETE_COST, INSERT * n + DELETE))
            if fault != "b":
                if initial in NEXT[t]:
                    found.append((s, NEXT[t][initial], n * INSERT_COST + stay, INSERT * n + KEEP))
                found += [(s, NEXT[t][c], n * INSERT_COST + REROLE_COST + stay, INSERT * n + REROLE) for c in "ua" if c in NEXT[t]]
    return tuple(found)


Best = dict[tuple[int, int], tuple[int, str]]


def block_audits(codes: tuple[str, ...], starts: tuple[int, ...] = (0, 1, 2, 3)) -> Best:
    """(cost, audit) of the best way from each of ``starts`` to each state through a block of rows."""
    trie = Trie()
    held: dict[tuple[int, int], tuple[int, int]] = {(s, s): (0, 0) for s in starts}
    for code in codes:
        now: dict[tuple[int, int], tuple[int, int]] = {}
        steps = row_steps(code)
        for (begin, s), (cost, node) in held.items():
            for at, to, more, edits in steps:
                if at != s:
                    continue
                best = now.get((begin, to))
                if best is None or cost + more < best[0]:
                    now[begin, to] = (cost + more, trie.add(node, edits))
                elif cost + more == best[0]:
                    other = trie.add(node, edits)
                    if other != best[1] and trie.less(other, best[1]):
                        now[begin, to] = (best[0], other)
        held = now
    return {k: (cost, trie.text(node)) for k, (cost, node) in held.items()}


@lru_cache(maxsize=1 << 15)
def short_audits(codes: tuple[str, ...]) -> tuple[int, str]:
    """Cost and audit of a whole short conversation; patterns of rows repeat, so they are remembered."""
    return composed([block_audits(codes, (START,))])


def composed(blocks: list[Best]) -> tuple[int, str]:
    """Cost and audit of blocks one after the other: by cost, then by the order of the audits so far, then by the block's own."""
    held: dict[int, tuple[int, int, tuple]] = {START: (0, 0, ())}
    for block in blocks:
        order = {text: i for i, text in enumerate(sorted({text for _, text in block.values()}))}
        found: dict[int, tuple[int, int, int, tuple]] = {}
        for (s, t), (cost, text) in block.items():
            if s in held:
                before, rank, way = held[s]
                new = (before + cost, rank, order[text], (way, text))
                if t not in found or new[:3] < found[t][:3]:
                    found[t] = new
        ranks = {pair: i for i, pair in enumerate(sorted({x[1:3] for x in found.values()}))}
        held = {t: (cost, ranks[a, b], way) for t, (cost, a, b, way) in found.items()}
    ends = [(cost + n * INSERT_COST, rank, n, way) for s, (cost, rank, way) in held.items() for t, n in INSERTS[s] if t in (START, AFTER_A)]
    cost, _, n, way = min(ends, key=lambda x: x[:3])
    texts = [INSERT * n]
    while way:
        way, text = way
        texts.append(text)
    return cost, "".join(reversed(texts))


@dataclass
class Stretch:
    """What neighbouring rows of one conversation add up to."""

    least: int | None = None
    most: int | None = None
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first: str | None = None
    last: str | None = None
    rows: int = 0
    counts: list[int] = field(default_factory=lambda: [0] * len(COUNTS))
    codes: list[str] = field(default_factory=list)
    blocks: list[Best] = field(default_factory=list)

    def add(self, turn: int | None, initial: str, fault: str, times: int) -> None:
        """``times`` equal rows; of those that are not blank all but the first are duplicates."""
        for i in range(times):
            own = "duplicate" if i and fault not in ("blank", "duplicate") else fault
            if own:
                self.counts[COUNTS.index(own)] += 1
            if self.last is not None and self.last + initial not in LEGAL_PAIRS:
                self.counts[3] += 1
            self.last = initial
            self.codes.append(initial + ("b" if own in ("blank", "duplicate") else "t" if own else "-"))
            if len(self.codes) == BLOCK_ROWS:
                self.close()
        self.rows += times
        if self.first is None:
            self.first, self.first_turn = initial, turn
        if turn is not None:
            self.least = turn if self.least is None else min(turn, self.least)
            self.most = turn if self.most is None else max(turn, self.most)
            self.turns += turn != self.last_turn
        self.last_turn = turn

    def close(self, starts: tuple[int, ...] = (0, 1, 2, 3)) -> None:
        if self.codes:
            self.blocks.append(block_audits(tuple(self.codes), starts))
            self.codes = []

    def repaired(self) -> tuple[int, str]:
        if not self.blocks and len(self.codes) <= 64:
            return short_audits(tuple(self.codes))
        self.close()
        return composed(self.blocks)

    def follow(self, other: Stretch) -> None:
        """Append the stretch behind this one."""
        if not other.rows:
            return
        if self.rows:
            self.counts[3] += self.last + other.first not in LEGAL_PAIRS
            self.turns -= other.first_turn is not None and other.first_turn == self.last_turn
        else:
            self.first, self.first_turn = other.first, other.first_turn
        self.least = min((x for x in (self.least, other.least) if x is not None), default=None)
        self.most = max((x for x in (self.most, other.most) if x is not None), default=None)
        self.turns += other.turns
        self.rows += other.rows
        self.last, self.last_turn = other.last, other.last_turn
        self.counts = [a + b for a, b in zip(self.counts, other.counts, strict=True)]
        self.blocks += other.blocks

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


def ordered(rows: DataFrame) -> list[Column]:
    """A conversation's order: turn (nulls first), role, and the text by its front and its digest."""
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest")]


def named(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, copies, and the front and digest of the text; null role and text are one space."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"),
        (F.lit(1) if copies is None else copies).cast("int").alias("copies"),
        F.substring(text, 1, HEAD).alias("head"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def damage(conversations: DataFrame) -> DataFrame:
    """The rows damaged by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space), in the form of :func:`named`.

    0 drops a row (0 copies), 1 empties its text, 2 takes ``[.!?]`` from it, 3 repeats it (2 copies), 4 makes its role user.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("long").cast("string"), space) for c in ("conv_id", "turn")))
    case = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    damaged = conversations.select(
        "conv_id",
        "turn",
        F.when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"),
    )
    return named(damaged, F.col("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """One row for each conversation, turn, role and text with the number of its copies and its first fault; texts themselves stay behind.

    Equal rows are summed before anything else, so that any number of copies is one row. Rows of 0 copies are kept, as their conversation is to have a result.
    """
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    faulty = F.when(body == "", "blank").when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated")
    key = ["conv_id", "turn", "role", "head", "digest"]
    slim = rows.select(*key, "copies", faulty.alias("fault")).groupBy(*key).agg(F.sum("copies").alias("copies"), F.first("fault").alias("fault"))
    slim = materialize(slim, "repair-rows")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = slim.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(turn).alias("first"))
    again = materialize(again.where("n > 1").select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first"), "repair-repeats")
    met = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    late = (F.col("fault").isNull() | (F.col("fault") == "truncated")) & F.col("first").isNotNull() & ~turn.eqNullSafe(F.col("first"))
    return slim.join(again, met, "left").select(*key, F.col("copies"), F.when(late, "duplicate").otherwise(F.col("fault")).alias("fault"))


def _parts(partition: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Results of the conversations inside a partition, and the blocks of its first and last one, which may go on in another."""

    def blocks(conv: int | None, own: Stretch) -> Iterator[tuple]:
        own.close()
        for i, block in enumerate(own.blocks or [{(s, s): (0, "") for s in range(4)}]):
            pairs = [block.get((s, t)) for s in range(4) for t in range(4)]
            rest = own if i == 0 else Stretch()
            yield (conv, False, [partition, i], rest.least, rest.most, rest.turns, rest.first_turn, rest.last_turn, rest.first, rest.last, rest.rows, *rest.counts, [x and x[0] for x in pairs], [x and x[1] for x in pairs])

    def whole(conv: int | None, own: Stretch) -> tuple:
        cost, audit = own.repaired()
        return (conv, True, [partition], own.least, own.most, own.turns, own.first_turn, own.last_turn, own.first, own.last, own.rows, *own.counts, [cost], [audit])

    now, own, first = None, None, True
    for batch in batches:
        for conv, turn, initial, fault, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own is None or conv != now:
                if own is not None:
                    if first:
                        yield from blocks(now, own)
                    else:
                        yield whole(now, own)
                    first = False
                now, own = conv, Stretch()
            if copies:
                own.add(turn, initial, fault, copies)
    if own is not None:
        yield from blocks(now, own)


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [f.split(" ") for f in PARTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _put_together(table: pa.Table) -> pa.Table:
    """One conversation from its blocks, in order of partitions and of blocks within them."""
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    total = Stretch()
    for r in rows:
        block = {(i // 4, i % 4): (c, a) for i, (c, a) in enumerate(zip(r["cost"], r["audit"], strict=True)) if c is not None}
        own = Stretch(r["least"], r["most"], r["turns"], r["first_turn"], r["last_turn"], r["first"], r["last"], r["rows"], [r[c] for c in COUNTS])
        total.follow(own)
        total.blocks.append(block)
    cost, audit = composed(total.blocks)
    return pa.table({"conv_id": pa.array([rows[0]["conv_id"]], pa.int64()), "gaps": [total.gaps()], **{c: [n] for c, n in zip(COUNTS, total.counts, strict=True)}, "cost": [cost], "audit": [audit]})


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of ``rows`` (in the form of :func:`named`).

    One sort by range of (conv_id, turn, role, text), so that a long conversation is shared by tasks; only conversations at the edges of a
    partition leave it as blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for x in _parts(TaskContext.get().partitionId(), batches):
            held.append(x)
            if len(held) == 1000:
                yield _frame(held)
                held = []
        if held:
            yield _frame(held)

    slim = materialize(judged(rows), "repair-judged")
    in_order = slim.repartitionByRange(*ordered(slim)).sortWithinPartitions(*ordered(slim))
    slim_columns = in_order.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", F.col("copies").cast("long"))
    parts = materialize(slim_columns.mapInArrow(run, PARTS), "repair-parts")
    gaps = F.when(F.col("least").isNull(), F.lit(0)).otherwise(F.col("most") - F.col("least") + 1 - F.col("turns"))
    whole = parts.where("whole").select("conv_id", gaps.cast("long").alias("gaps"), *COUNTS, F.col("cost")[0].alias("cost"), F.col("audit")[0].alias("audit"))
    return whole.unionByName(parts.where("not whole").groupBy("conv_id").applyInArrow(_put_together, AUDITS))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str, str]]]]:
    """For each conversation its audit row and its repaired rows (edit, role, text), read from sorted batches without holding a conversation."""
    stream = ((dict(zip(batch.schema.names, row, strict=True))) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    head = next(stream, None)

    def repaired(audit: str, last: list[dict | None]) -> Iterator[tuple[str, str, str]]:
        after, state, row, left = iter(audit), START, None, 0

        def put(initial: str) -> str:
            nonlocal state
            state = NEXT[state][initial]
            return ROLES[initial]

        for edit in after:
            if edit == INSERT:
                yield edit, put("a" if state == 2 else "u"), ""
                continue
            while not left:
                row = next(stream)
                left = row["copies"]
            left -= 1
            if edit == KEEP:
                state = NEXT[state][row["role"][:1]]
                yield edit, row["role"], row["text"]
            elif edit == REROLE:
                yield edit, put("a" if state == 2 else "u"), row["text"]
        last[0] = next(stream, None)
        while last[0] is not None and last[0]["side"]:
            last[0] = next(stream, None)

    while head is not None:
        last: list[dict | None] = [None]
        own = repaired(head["audit"], last)
        yield head, own
        for _ in own:
            pass
        head = last[0]


def _with_audits(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """Each conversation's audit row and then its rows in order, a conversation in one partition."""
    rest = [c for c in audited.columns if c != "conv_id"]
    kinds = dict(audited.dtypes)
    own = rows.select("conv_id", F.lit(1).alias("side"), "turn", "role", "head", "digest", "copies", "text", *(F.lit(None).cast(kinds[c]).alias(c) for c in rest))
    none = {"turn": "long", "role": "string", "head": "string", "digest": "binary", "copies": "int", "text": "string"}
    first = audited.select("conv_id", F.lit(0).alias("side"), *(F.lit(None).cast(k).alias(c) for c, k in none.items()), *rest)
    conv, *order = ordered(rows)
    both = first.unionByName(own).repartition("conv_id").sortWithinPartitions(conv, "side", *order)
    return both.drop("head", "digest", "turn")


def repaired_rows(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role, text of the repaired conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, edited in _edited(batches):
            held, place = [], 0
            for edit, role, text in edited:
                held.append((head["conv_id"], place, edit, role, text))
                place += 1
                if len(held) == 256:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], schema)

    names = ["conv_id", "place", "edit", "role", "text"]
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), *((c, pa.string()) for c in names[2:])])
    return _with_audits(rows, audited).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (from :func:`damage` or :func:`named`): its faults, cheapest audit and the digest of the repaired rows.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of ``role:text`` lines). Null role and text are one space; a null conv_id is a conversation of its
    own, null turns come first. Rows of one turn are ordered by role, then text (its first 64 characters, then its SHA-256), so equal rows are neighbours; which of them came first
    makes no difference. A role is judged by its first character; an empty role fits nowhere and is deleted or given another. A conversation
    whose rows are all gone has zeros, an empty audit and the digest of the empty string; an empty table gives an empty result; other columns are not looked at.
    Faults, audits and repaired rows are shared by tasks within a conversation; the digest of one conversation is a single SHA-256 and so
    one pass over its texts in one task, which streams them.
    """
    audited = materialize(audits(rows), "repair-audits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for head, edited in _edited(batches):
            digest = hashlib.sha256()
            for i, (_, role, text) in enumerate(edited):
                digest.update(f"\n{role}:{text}".encode() if i else f"{role}:{text}".encode())
            held.append([head[c] for c in names] + [digest.hexdigest()])
            if len(held) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=[*names, "repaired_sha256"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=[*names, "repaired_sha256"])

    names = [f.split(" ")[0] for f in AUDITS.split(", ")]
    kinds = [pa.int64()] * (len(names) - 1) + [pa.string()] * 2
    return _with_audits(rows, audited).mapInArrow(run, AUDITS + ", repaired_sha256 string")
