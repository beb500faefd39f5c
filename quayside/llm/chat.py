"""Conversations as training windows of bounded size.

Turns are marked by control strings. Inside a text, the same strings are broken by a backslash after their first
character, and so are strings that already look broken, so that the text comes back exactly.

A conversation is cut at turns only. Prefix sums of the turns' tokens (marks included) tell how many turns fit
into a window: a window holds the system turn the conversation starts with, some turns of the window before it as
history, and as many new turns as the budget allows, at least one. Only texts of new assistant turns are targets;
repeated ones are masked, so each is learned once.

Rows are brought together by conversation and sorted by turn; a task streams over them and holds the turns of one
window and its history, not of a conversation.

Cases. Null texts and null roles are empty. Turns come in the order of turn, role, text; nulls first; repeated
rows are turns of their own. Rows with a null ``conv_id`` are one conversation. A single turn beyond the budget
makes a window beyond the budget (``n_tokens`` tells). An empty table has no windows.
"""

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import map_arrow

START, END = "<s>", "</s>"
# role -> the strings before and after its texts; other roles are written out between OTHER and SAYS.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "[/ANS]")}
OTHER, SAYS, OTHER_END = "[ROLE]", "[SAYS]", "[/ROLE]"
CONTROL = (START, END, OTHER, SAYS, OTHER_END, *(m for pair in MARKS.values() for m in pair))

_BODIES = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_WHOLE = re.compile(rf"([<\[])(\\*)({_BODIES})")
_BROKEN = re.compile(rf"([<\[])\\(\\*)({_BODIES})")
_MARK = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))

BUDGET = 512
# Of the turns before a window, so many at most are repeated, and so many tokens at most.
HISTORY_TURNS, HISTORY_TOKENS = 2, 128

WINDOW = (
    "conv_id bigint, window int, first_turn bigint, n_repeated int, n_tokens bigint, text string, "
    "targets array<struct<first:int,last:int>>"
)


def escape(text: str) -> str:
    return _WHOLE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _BROKEN.sub(r"\1\2\3", text)


def written_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its escaped text starts and ends."""
    body = escape(text)
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER + escape(role) + SAYS, OTHER_END
    return before + body + after, len(before), len(before) + len(body)


def read_turns(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of every turn of a window."""
    named = {m[0]: (role, m[1]) for role, m in MARKS.items()}
    at = len(START)
    while not text.startswith(END, at):
        mark = _MARK.match(text, at)
        start = mark.end()
        if mark[0] == OTHER:
            says = text.index(SAYS, start)
            role, after, start = unescape(text[start:says]), OTHER_END, says + len(SAYS)
        else:
            role, after = named[mark[0]]
        end = text.index(after, start)
        yield role, unescape(text[start:end]), start, end
        at = end + len(after)


class Turn:
    __slots__ = ("index", "role", "shown", "first", "last", "tokens")

    def __init__(self, index: int, role: str, text: str, count):
        self.index, self.role = index, role
        self.shown, self.first, self.last = written_turn(role, text)
        self.tokens = count(self.shown)


def window_row(conv_id, number: int, system: Turn | None, history: list[Turn], new: list[Turn], base: int) -> tuple:
    shown, targets, at = [START], [], len(START)
    repeated = ([system] if system else []) + history
    for turn, fresh in [*((t, False) for t in repeated), *((t, True) for t in new)]:
        shown.append(turn.shown)
        if fresh and turn.role == "assistant" and turn.last > turn.first:
            targets.append({"first": at + turn.first, "last": at + turn.last})
        at += len(turn.shown)
    tokens = base + sum(t.tokens for t in repeated + new)
    return conv_id, number, new[0].index, len(repeated), tokens, "".join(shown) + END, targets


class Windows:
    """The windows of one conversation, turn by turn. Holds the system turn, the history and one window."""

    def __init__(self, conv_id, base: int, budget: int, history_turns: int, history_tokens: int):
        self.conv_id, self.base, self.budget = conv_id, base, budget
        self.history_turns, self.history_tokens = history_turns, history_tokens
        self.system: Turn | None = None
        self.history: list[Turn] = []
        self.new: list[Turn] = []
        self.prefix = [0]  # sums of the tokens of the new turns
        self.number = 0

    def _room(self) -> int:
        kept = (self.system.tokens if self.system and self.number else 0) + sum(t.tokens for t in self.history)
        return self.budget - self.base - kept

    def add(self, turn: Turn) -> Iterator[tuple]:
        if self.new and self.prefix[-1] + turn.tokens > self._room():
            yield self._close()
            # History gives way before a turn that would not fit beside it.
            while self.history and turn.tokens > self._room():
                self.history.pop(0)
        self.new.append(turn)
        self.prefix.append(self.prefix[-1] + turn.tokens)

    def _close(self) -> tuple:
        system = self.system if self.number else None
        row = window_row(self.conv_id, self.number, system, self.history, self.new, self.base)
        if not self.number and self.new[0].role == "system":
            self.system = self.new[0]
        history: list[Turn] = []
        room = self.history_tokens
        for turn in reversed([*self.history, *self.new]):
            if turn is self.system or len(history) == self.history_turns or turn.tokens > room:
                break
            history.insert(0, turn)
            room -= turn.tokens
        self.number, self.history, self.new, self.prefix = self.number + 1, history, [], [0]
        return row

    def end(self) -> Iterator[tuple]:
        if self.new:
            yield self._close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    kinds.append(pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
    names = ["conv_id", "window", "first_turn", "n_repeated", "n_tokens", "text", "targets"]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def in_order(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation in one task, one after another."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def chat_windows(
    conversations: DataFrame,
    tokenizer_json: str,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
) -> DataFrame:
    """Turns (conv_id, turn, role, text) -> windows; ``targets`` are the spans of ``text`` to learn from.

    ``tokenizer_json`` is the text of a tokenizers file, by which turns are measured. Rows of the result are
    in order within a conversation, in one partition.
    """

    def run(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        tokenizer.encode_special_tokens = True

        def counts(texts: list[str]) -> list[int]:
            return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

        base = sum(counts([START, END]))
        current, index = None, 0
        for batch in batches:
            ids, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            for some in range(0, len(ids), 256):
                out: list[tuple] = []
                part = range(some, min(some + 256, len(ids)))
                tokens = counts([written_turn(roles[k], texts[k])[0] for k in part])
                for k, n in zip(part, tokens, strict=True):
                    if current is None or current.conv_id != ids[k]:
                        if current is not None:
                            out.extend(current.end())
                        current, index = Windows(ids[k], base, budget, history_turns, history_tokens), 0
                    out.extend(current.add(Turn(index, roles[k], texts[k], lambda _, n=n: n)))
                    index += 1
                yield _batch(out)
        if current is not None:
            yield _batch(list(current.end()))

    return map_arrow(in_order(conversations), run, WINDOW)


DIGEST = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, n_windows bigint, n_repeated bigint, most_tokens bigint"
)


def read_back(windows: DataFrame) -> DataFrame:
    """Windows, in order within their conversation -> digests of the turns and of the text under the loss mask."""

    def digests(rows: Iterable[dict]) -> Iterator[tuple]:
        seen, row = object(), None
        for w in rows:
            if w["conv_id"] != seen:
                if row:
                    yield finished(row)
                seen = w["conv_id"]
                row = [seen, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0, 0]
            for k, (role, text, _, _) in enumerate(read_turns(w["text"])):
                if k >= w["n_repeated"]:
                    row[1] += 1
                    row[2].update(f"{role}\n{text}\n".encode())
            for span in w["targets"]:
                learned = unescape(w["text"][span["first"] : span["last"]])
                row[3] += len(learned)
                row[4].update(learned.encode())
            row[5] += len(w["text"])
            row[6] += 1
            row[7] += w["n_repeated"]
            row[8] = max(row[8], w["n_tokens"])
        if row:
            yield finished(row)

    def finished(row: list) -> tuple:
        return tuple(v.hexdigest() if hasattr(v, "hexdigest") else v for v in row)

    def run(batches):
        names = [c.split()[0] for c in DIGEST.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGEST.split(", ")]
        out: list[tuple] = []

        def batch():
            columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for row in digests(w for b in batches for k in range(0, len(b), 256) for w in b.slice(k, 256).to_pylist()):
            out.append(row)
            if len(out) == 1000:
                yield batch()
                out.clear()
        yield batch()

    return map_arrow(windows, run, DIGEST)
