"""Cheapest repair of a conversation into ``(system? (user assistant)+)?``, by divide and conquer.

Rows are kept, given another role, deleted or come after inserted empty ones. Which roles may follow is one of four
states: nothing yet, after system, after user, after assistant. A state and the initials of the edits determine every
role, so the initials (the audit) are the repair.

A conversation is halved: costs from the front to each state, and from each state to the end, meet in the middle. Among
the states with the least sum the one with the ASCII-least audit before it is crossed; then both halves are solved
between fixed states. Costs are four numbers at a time, so memory is one byte a row for what a row is, and one for its
edit. Inserts are counted with the row that follows them. Hence every audit of a half ends with its last row's edit,
no audit is the beginning of another one, and comparing what comes before the middle is enough; ranks of the four
audits are carried along with their costs.

Cases: null roles and texts are one space, as are null ids and turns in the damage's key. Rows of one turn are ordered
by role and text. Rows without ``conv_id`` are one conversation. A role counts by its first character; roles that
start with another one than s, u or a can only be changed or deleted. A conversation of which no row is left has
zeros, an empty audit and the digest of the empty string. No rows, no result; other columns are left aside.

A conversation is streamed through one task in the order of its turns, because its digest is a chain; texts are held
up to ``HELD_BYTES``. What is longer is streamed again, behind its audit.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import map_arrow, slices, written

SPACES = " \t\n\x0b\x0c\r"
KEPT, REROLED, DELETED, INSERTED = "K", "R", "D", "I"
COST = {KEPT: 0, REROLED: 2, DELETED: 3, INSERTED: 2}
# State after a role's initial, by the state before it: nothing yet, after s, after u, after a.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
# The initial that an inserted or changed role has.
WANTED = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
# Faults of a row: none, must be deleted, costs one more unless deleted.
SOUND, DOOMED, CUT = 0, 1, 2
INITIALS = "sua"
FAR = 1 << 60
# What is missing at the end, by state.
TAIL = ("", INSERTED * 2, INSERTED, "")
END = tuple(COST[INSERTED] * len(t) for t in TAIL)
# Texts of a conversation that are kept until its edits are known; and audits that are remembered.
HELD_BYTES = 16 << 20
REMEMBERED = 1 << 14

REPAIRED = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def kind(initial: str, fault: int) -> int:
    """What matters of a row for its edits, as one byte."""
    return (INITIALS.find(initial) if initial in INITIALS and initial else 3) * 3 + fault


def _moves(of: int) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, initials) of a row and the inserts before it.

    A delete never follows an insert: the other way round costs as much and its audit is less.
    """
    initial, fault = ("s", "u", "a", "?")[of // 3], of % 3
    out = [(s, s, COST[DELETED], DELETED) for s in range(4)]
    for s in range(4):
        if fault == DOOMED:
            break
        at, cost, edits = s, int(fault == CUT), ""
        for _ in range(3):
            if initial in AFTER[at]:
                out.append((s, AFTER[at][initial], cost + COST[KEPT], edits + KEPT))
            out.append((s, AFTER[at][WANTED[at]], cost + COST[REROLED], edits + REROLED))
            at, cost, edits = AFTER[at][WANTED[at]], cost + COST[INSERTED], edits + INSERTED
    return out


MOVES = [_moves(k) for k in range(12)]


def forward(kinds: bytes, lo: int, hi: int, state: int) -> tuple[list[int], list[int]]:
    """Least costs from a state before row ``lo`` to each state before row ``hi``, and the ranks of their audits."""
    costs, ranks = [FAR] * 4, [0] * 4
    costs[state] = 0
    for i in range(lo, hi):
        best = [(FAR, 0, "")] * 4
        for s, t, c, edits in MOVES[kinds[i]]:
            if costs[s] < FAR:
                reached = (costs[s] + c, ranks[s], edits)
                if reached < best[t]:
                    best[t] = reached
        costs = [b[0] for b in best]
        order = sorted(range(4), key=lambda t: best[t][1:])
        for rank, t in enumerate(order):
            ranks[t] = rank
    return costs, ranks


def backward(kinds: bytes, lo: int, hi: int, after: list[int]) -> list[int]:
    """Least costs from each state before row ``lo``, given those before row ``hi``."""
    for i in range(hi - 1, lo - 1, -1):
        costs = [FAR] * 4
        for s, t, c, _ in MOVES[kinds[i]]:
            if after[t] + c < costs[s]:
                costs[s] = after[t] + c
        after = costs
    return after


def _between(kinds: bytes, lo: int, hi: int, state: int, after: list[int], audit: list[str]) -> int:
    """Append the edits of rows ``lo`` to ``hi``; returns the state they end in."""
    if hi - lo == 1:
        _, edits, end = min((c + after[t], edits, t) for s, t, c, edits in MOVES[kinds[lo]] if s == state)
        audit.append(edits)
        return end
    middle = (lo + hi) // 2
    costs, ranks = forward(kinds, lo, middle, state)
    rest = backward(kinds, middle, hi, after)
    crossing = min(range(4), key=lambda s: (costs[s] + rest[s], ranks[s]))
    fixed = [FAR] * 4
    fixed[crossing] = 0
    _between(kinds, lo, middle, state, fixed, audit)
    return _between(kinds, middle, hi, crossing, after, audit)


def audit_of(kinds: bytes) -> str:
    """The ASCII-least audit among the cheapest repairs of rows of these kinds."""
    audit: list[str] = []
    state = _between(kinds, 0, len(kinds), 0, list(END), audit) if kinds else 0
    return "".join(audit) + TAIL[state]


def cost_of(audit: str, kinds: bytes) -> int:
    """What an audit costs."""
    edits = audit.replace(INSERTED, "")
    cut = sum(e != DELETED and k % 3 == CUT for e, k in zip(edits, kinds))
    return sum(COST[e] * audit.count(e) for e in COST) + cut


class Repaired:
    """Digest of a repaired conversation whose rows come one after another."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.empty = audit, 0, 0, True
        self.digest = hashlib.sha256()

    def _add(self, role: str, initial: str, text: str) -> None:
        self.digest.update((("" if self.empty else "\n") + role + ":" + text).encode())
        self.empty, self.state = False, AFTER[self.state][initial]

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == INSERTED:
            wanted = WANTED[self.state]
            self._add(NAMES[wanted], wanted, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit, wanted = self.audit[self.at], WANTED[self.state]
        self.at += 1
        if edit == KEPT:
            self._add(role, role[:1], text)
        elif edit == REROLED:
            self._add(NAMES[wanted], wanted, text)

    def hexdigest(self) -> str:
        self._insert()
        return self.digest.hexdigest()


class _Conversation:
    """What is known of a conversation while its rows pass."""

    def __init__(self):
        self.kinds, self.seen, self.rows, self.held = bytearray(), set(), [], 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.first = self.last = self.before = None
        self.turns = 0

    def row(self, turn: int | None, role: str, text: str, held_bytes: int) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        initial, said = role[:1], text.rstrip(SPACES)
        if self.before is not None:
            self.counts["illegal"] += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        name = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        fault = "blank" if not said else "duplicate" if name in self.seen else "truncated" if said[-1] not in ".!?" else None
        self.seen.add(name)
        if fault:
            self.counts[fault] += 1
        self.kinds.append(kind(initial, SOUND if fault is None else CUT if fault == "truncated" else DOOMED))
        if self.rows is not None:
            self.held += len(text) + 64
            self.rows.append((role, text))
            if self.held > held_bytes:
                self.rows = None

    def result(self, conv_id: int | None, audits: dict[bytes, str]) -> tuple:
        kinds = bytes(self.kinds)
        audit = audits.get(kinds)
        if audit is None:
            audit = audit_of(kinds)
            if len(audits) < REMEMBERED and len(kinds) <= 64:
                audits[kinds] = audit
        digest = None
        if self.rows is not None:
            repaired = Repaired(audit)
            for role, text in self.rows:
                repaired.row(role, text)
            digest = repaired.hexdigest()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (conv_id, gaps, *self.counts.values(), cost_of(audit, kinds), audit, digest)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in REPAIRED.split(", ")]
    types = [pa.string() if f.endswith("string") else pa.int64() for f in REPAIRED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _conversations(batches):
    """Rows of a task, conversation after conversation; ``false`` for rows of before the damage that are gone."""
    for batch in slices(batches):
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "gone", "turn", "role", "text")))


def _judge(held_bytes: int):
    def judge(batches):
        audits: dict[bytes, str] = {}
        current, seen, out = None, None, []
        for conv_id, gone, turn, role, text in _conversations(batches):
            if current is None or conv_id != seen:
                if current is not None:
                    out.append(current.result(seen, audits))
                current, seen = _Conversation(), conv_id
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
            if not gone:
                current.row(turn, role, text, held_bytes)
        if current is not None:
            out.append(current.result(seen, audits))
            yield _batch(out)

    return judge


def _digests(batches):
    """The audit of a conversation comes as its first row."""
    repaired = seen = None
    for conv_id, gone, _, role, text in _conversations(batches):
        if gone is None:
            if repaired is not None:
                yield _digest(seen, repaired)
            repaired, seen = Repaired(text), conv_id
        elif not gone:
            repaired.row(role, text)
    if repaired is not None:
        yield _digest(seen, repaired)


def _digest(conv_id: int | None, repaired: Repaired) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([conv_id], pa.int64()), pa.array([repaired.hexdigest()])], ["conv_id", "long_sha256"])


def _in_order(rows: DataFrame) -> DataFrame:
    """Each conversation in one partition, nulls of ``gone`` and ``turn`` first."""
    return rows.select("conv_id", "gone", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "gone", "turn", "role", "text")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows as a careless export would leave them: some gone, emptied, without ends of sentences, twice, or as user.

    Dropped rows stay, marked ``gone``, so that their conversations are still known.
    """
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    harm = F.crc32(key) % 20
    return (
        turns.select(
            F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), harm.alias("harm"),
            F.coalesce(F.col("role").cast("string"), one).alias("role"), F.coalesce(F.col("text").cast("string"), one).alias("text"),
        )
        .withColumn("copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "conv_id", (F.col("harm") == 0).alias("gone"), "turn",
            F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
            F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        )
    )


def repaired(rows: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Rows (conv_id, gone, turn, role, text) -> faults, cheapest edits and repaired digest of every conversation."""
    judged = written(map_arrow(_in_order(rows), _judge(held_bytes), REPAIRED), "repaired")
    long = judged.where("repaired_sha256 is null").select("conv_id", "audit")
    if long.isEmpty():
        return judged
    known = long.select(F.col("conv_id").alias("known"))
    again = rows.select("conv_id", "gone", "turn", "role", "text").join(known, F.col("conv_id").eqNullSafe(F.col("known")), "left_semi")
    first = long.select("conv_id", F.lit(None).cast("boolean").alias("gone"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    digests = map_arrow(_in_order(again.unionByName(first)), _digests, "conv_id bigint, long_sha256 string").withColumnRenamed("conv_id", "known")
    return judged.join(digests, F.col("conv_id").eqNullSafe(F.col("known")), "left").select(
        *(c for c in judged.columns if c != "repaired_sha256"), F.coalesce("repaired_sha256", "long_sha256").alias("repaired_sha256")
    )
