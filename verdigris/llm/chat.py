"""Chat formatting: conversations as token-budgeted, turn-aligned training windows with a loss mask."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from verdigris.llm.bpe import Codec
from verdigris.llm.common import slices

#: Control strings of the template. Fixed values.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
#: A control string that is part of a text, with any number of backslashes after its first character.
_CONTROL = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\]|<SYS>>|</SYS>>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?s>|/?INST\]|<SYS>>|</SYS>>)")
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(CLOSE) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    """One more backslash after the first character of each control string: no control string is left, nothing is lost."""
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted, len(BEGIN))]


class _Turn:
    __slots__ = ("role", "text", "tokens")

    def __init__(self, role: str, text: str, tokens: int):
        self.role, self.text, self.tokens = role, text, tokens


class _Conversation:
    """Cuts one conversation into windows as its turns stream by; holds one window and the history that may repeat."""

    def __init__(self, key: object, budget: int, history: int):
        self.key, self.budget, self.history = key, budget, history
        self.system: _Turn | None = None
        self.past: list[_Turn] = []  # turns before the open window that still fit the history
        self.sums: list[int] = [0]  # prefix sums of their tokens
        self.lead: list[_Turn] = []
        self.fresh: list[_Turn] = []
        self.used = 0
        self.number = 0
        self.seen = 0

    def add(self, turn: _Turn) -> dict | None:
        """Takes the next turn; the window that it closes, if any."""
        closed = None
        if self.fresh and self.used + turn.tokens > self.budget:
            closed = self.close()
            fixed = self.system.tokens if self.system else 0
            room = min(self.history, max(0, self.budget - fixed - turn.tokens))
            first = bisect_left(self.sums, self.sums[-1] - room)
            repeated = self.past[first:]
            self.lead = ([self.system] if self.system else []) + repeated
            self.used = fixed + self.sums[-1] - self.sums[first]
        if not self.seen and turn.role == "system":
            self.system = turn
        self.seen += 1
        self.fresh.append(turn)
        self.used += turn.tokens
        return closed

    def close(self) -> dict:
        parts, loss, at = [BEGIN], [], len(BEGIN)
        for place, turn in enumerate(self.lead + self.fresh):
            head = OPEN + turn.role + CLOSE
            at += len(head)
            if place >= len(self.lead) and turn.role == "assistant":
                loss.append({"start": at, "end": at + len(turn.text)})
            parts += [head, turn.text, END]
            at += len(turn.text) + len(END)
        row = {
            "window": self.number, "text": "".join(parts), "loss": loss, "n_turns": len(self.lead) + len(self.fresh),
            "repeated": len(self.lead), "tokens": self.used,
        }
        for turn in self.fresh:
            if turn is not self.system:
                self.past.append(turn)
                self.sums.append(self.sums[-1] + turn.tokens)
        keep = bisect_left(self.sums, self.sums[-1] - self.history)
        self.past, self.sums = self.past[keep:], [one - self.sums[keep] for one in self.sums[keep:]]
        self.lead, self.fresh, self.used = [], [], 0
        self.number += 1
        return row


_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_WINDOW = "window long, text string, loss array<struct<start:long,end:long>>, n_turns long, repeated long, tokens long"


def windows(turns: DataFrame, path: str, pattern: str, budget: int = 1024, history: int = 256, key: str = "conv_id") -> DataFrame:
    """Windows of every conversation: key, ``window`` (from 0), ``text``, ``loss``, ``n_turns``, ``repeated``, ``tokens``.

    ``turns`` has the key, ``turn``, ``role`` and ``text``; other columns play no part. Turns come by ``turn``, ties by role
    and text; repeated rows are turns each; null roles and texts are empty, a null key is a conversation of its own. Every
    turn is new in exactly one window. A window holds ``budget`` tokens of the rank file at most, a longer turn stands alone
    with the system turn: texts are never cut. After the first window, the system turn (if the conversation opens with one)
    and the latest whole turns of at most ``history`` tokens are repeated; ``repeated`` counts these leading turns. ``loss``
    has the code-point spans of the new assistant texts in ``text``, none of the repeated ones. An empty table has no windows.

    Tokens are counted before the shuffle. A conversation is then streamed through one task in order, which holds one
    window and the history, however long the conversation is. Rows stay arranged by key and window.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in slices(batches, "text"):
            roles = [escape(role or "") for role in batch.column("role").to_pylist()]
            texts = [escape(text or "") for text in batch.column("text").to_pylist()]
            tokens = [len(codec.encode(OPEN + role + CLOSE + text + END)) for role, text in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("turn"), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(tokens, pa.int64())],
                names=[key, "turn", "role", "text", "tokens"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[object, dict]] = []
        size = 0
        now: _Conversation | None = None
        for batch in slices(batches, "text"):
            columns = [batch.column(name).to_pylist() for name in (key, "role", "text", "tokens")]
            for one, role, text, tokens in zip(*columns, strict=True):
                if now is None or now.key != one:
                    if now is not None:
                        out.append((now.key, now.close()))
                    now = _Conversation(one, budget, history)
                row = now.add(_Turn(role, text, tokens))
                if row:
                    out.append((one, row))
                    size += len(row["text"])
            if size > 1 << 20 or len(out) > 1000:
                yield rows(out)
                out, size = [], 0
        if now is not None:
            out.append((now.key, now.close()))
        if out:
            yield rows(out)

    def rows(found: list[tuple[object, dict]]) -> pa.RecordBatch:
        names = ["window", "text", "loss", "n_turns", "repeated", "tokens"]
        kinds = [pa.int64(), pa.string(), _LOSS, pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array([one for one, _ in found], key_type), *(pa.array([row[n] for _, row in found], k) for n, k in zip(names, kinds, strict=True))],
            names=[key, *names],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    picked = turns.select(key, "turn", "role", "text")
    key_type = to_arrow_type(picked.schema[key].dataType)
    key_name, turn_name = picked.schema[key].dataType.simpleString(), picked.schema["turn"].dataType.simpleString()
    counted = picked.mapInArrow(count, f"`{key}` {key_name}, turn {turn_name}, role string, text string, tokens long")
    arranged = counted.repartition(key).sortWithinPartitions(key, "turn", "role", "text")
    return arranged.mapInArrow(cut, f"`{key}` {key_name}, {_WINDOW}")


def read_back(found: DataFrame, key: str = "conv_id", arranged: bool = False) -> DataFrame:
    """Per conversation, from the windows' own texts and masks: ``n_turns``, ``turns_sha256`` (role, newline, text, newline of
    each new turn), ``loss_chars`` and ``loss_sha256`` (unescaped texts under the mask), ``formatted_chars``.

    ``arranged`` says that the rows come as ``windows`` gives them; else they are arranged by key and window first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started, done = None, False, []
        turns = loss = None
        n = chars = formatted = 0

        def finished() -> tuple:
            return now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        for batch in slices(batches, "text"):
            columns = [batch.column(name).to_pylist() for name in (key, "text", "loss", "repeated")]
            for one, text, spans, repeated in zip(*columns, strict=True):
                if not started or one != now:
                    if started:
                        done.append(finished())
                    now, started, turns, loss, n, chars, formatted = one, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, said in parse(text)[repeated:]:
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for span in spans:
                    learned = unescape(text[span["start"] : span["end"]])
                    loss.update(learned.encode())
                    chars += len(learned)
                formatted += len(text)
            if len(done) > 1000:
                yield rows(done)
                done = []
        if started:
            done.append(finished())
        if done:
            yield rows(done)

    def rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array([row[at] for row in done], kind) for at, kind in enumerate(kinds)],
            names=[key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    schema: StructType = found.schema
    key_type = to_arrow_type(schema[key].dataType)
    ordered = found if arranged else found.repartition(key).sortWithinPartitions(key, "window")
    return ordered.select(key, "text", "loss", "repeated").mapInArrow(
        run,
        f"`{key}` {schema[key].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )


def conversation(spark, key: int, texts: list[tuple[str, str]]) -> DataFrame:
    """A stated conversation as rows (conv_id, turn, role, text)."""
    return spark.createDataFrame(
        [(key, turn, role, text) for turn, (role, text) in enumerate(texts)], "conv_id long, turn long, role string, text string"
    )
