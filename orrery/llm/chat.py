"""Chat formatting in budgeted windows that end at turns.

Prefix sums of the turns' tokens choose the spans: a span takes as many turns as the budget allows. Every span after the
first repeats the conversation's opening system turn and as much of the latest history as the history budget allows, whole
turns only. What is repeated is context: the loss mask covers each assistant text once.

Turns are marked `<|im_start|>role`, a line break, the text, `<|im_end|>` and a line break. In texts and roles a backslash
is put behind the `<` or `[` that begins a control string, also if backslashes already stand there; taking one away again
gives the original. In a role a line break is written `%0A` and a percent sign `%25`.

Turns are dealt by conversation and read in order of turn, role and text; a task holds the turns of one window and its
history, never a whole conversation, however long it is.

Edge cases: a null role or text counts as empty, null conversation ids form one conversation, null turns come first,
repeated rows are turns of their own. A single turn beyond the budget gets a window of its own and isn't cut; no other
window exceeds the budget. The system turn is left out where it and the window's first turn together would. No rows give
no windows. Columns other than the four are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What never appears unescaped inside a text: these templates' markers.
CONTROL = (START, END, "<|im_sep|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<|startoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "<unk>", "<pad>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[SYS]", "[/SYS]")
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(?=\\*(?:{_TAILS}))")
_UNESCAPE = re.compile(rf"([<\[])\\(?=\\*(?:{_TAILS}))")
_TURN = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", re.S)
BUDGET, HISTORY = 1024, 256
WINDOWS = "conv_id long, window long, n_context int, text string, loss array<struct<start:int,end:int>>, n_tokens long"
TURN_COLUMNS = ("conv_id", "turn", "role", "text")


def escape(text: str) -> str:
    """The text without control strings."""
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    """What `escape` was given."""
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def turn_tokens(text: str) -> Column:
    """Tokens of a turn: words and single marks, and four for its markers."""
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))) + 4


def _format(turns: list[tuple[str, str, int]], n_context: int) -> tuple[str, list[dict]]:
    """The text of the turns and the places of the assistant texts behind the first `n_context`, in code points."""
    pieces, loss, at = [], [], 0
    for i, (role, text, _) in enumerate(turns):
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant" and i >= n_context:
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        pieces += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(pieces), loss


class _Windows:
    """The windows of one conversation, turn by turn."""

    def __init__(self, conv_id: int | None, budget: int, history: int) -> None:
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: list[tuple[str, str, int]] = []
        self.recent: deque[tuple[str, str, int]] = deque()
        self.recent_tokens = 0
        self.context: list[tuple[str, str, int]] = []
        self.turns: list[tuple[str, str, int]] = []
        self.begun_at, self.number, self.seen = 0, 0, 0

    def add(self, role: str, text: str, tokens: int, upto: int) -> Iterator[tuple]:
        """Takes a turn; upto: the prefix sum of tokens with it. Gives a window that the turn doesn't fit in."""
        turn = role, text, tokens
        if self.turns and sum(t[2] for t in self.context) + upto - self.begun_at > self.budget:
            yield self.close()
            self._open(tokens, upto)
        self.turns.append(turn)
        if not self.seen and role == "system":
            self.system = [turn]
        else:
            self.recent.append(turn)
            self.recent_tokens += tokens
            while self.recent and self.recent_tokens > self.history:
                self.recent_tokens -= self.recent.popleft()[2]
        self.seen += 1

    def _open(self, tokens: int, upto: int) -> None:
        system = self.system if tokens + sum(t[2] for t in self.system) <= self.budget else []
        left = self.budget - tokens - sum(t[2] for t in system)
        context, used = [], 0
        for turn in reversed(self.recent):
            if used + turn[2] > left:
                break
            context.append(turn)
            used += turn[2]
        self.context, self.turns, self.begun_at = system + context[::-1], [], upto - tokens

    def close(self) -> tuple:
        text, loss = _format(self.context + self.turns, len(self.context))
        window = self.conv_id, self.number, len(self.context), text, loss, sum(t[2] for t in self.context + self.turns)
        self.number += 1
        return window


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row a window: conversation, number, how many turns repeat earlier ones, text, and the loss mask's places in it."""
    order = [F.col("turn"), F.col("role"), F.col("text")]
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", turn_tokens("text"))
    spans = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("upto", F.sum("tokens").over(spans)).sortWithinPartitions("conv_id", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            out = []
            for conv_id, _, role, text, tokens, upto in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or current.conv_id != conv_id:
                    out += [current.close()] if current else []
                    current = _Windows(conv_id, budget, history)
                out += current.add(role, text, tokens, upto)
            if out:
                yield _batch(out)
        if current:
            yield _batch([current.close()])

    return turns.mapInArrow(run, WINDOWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "window", "n_context", "text", "loss", "n_tokens"])


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a window: roles and texts as they were."""
    return [(unescape_role(role), unescape(body)) for role, body in _TURN.findall(text)]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its windows alone: all turns once, and what the loss mask covers."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None

        def closed(s: dict) -> tuple:
            return s["conv_id"], s["n_turns"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["windows"]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            out = []
            for conv_id, _, n_context, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state["conv_id"] != conv_id:
                    out += [closed(state)] if state else []
                    state = {"conv_id": conv_id, "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "windows": 0}
                for role, body in parse(text)[n_context:]:
                    state["n_turns"] += 1
                    state["turns"].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    covered = unescape(text[span["start"] : span["end"]])
                    state["loss_chars"] += len(covered)
                    state["loss"].update(covered.encode())
                state["chars"] += len(text)
                state["windows"] += 1
            if out:
                yield made(out)
        if state:
            yield made([closed(state)])

    dealt = formatted.select("conv_id", "window", "n_context", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(run, schema)
