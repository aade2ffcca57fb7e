"""Streams with custom state: state machines, stale results, deadlines, limits, circuits.

All processors work one key at a time in event order. Given a ``lateness``, rows wait in the key's state until the
watermark has passed them, so that they are applied in event order however they were dealt over batches; rows that come
when later ones have been applied already are given back marked ``late`` and change nothing. What waits is bounded by the
lateness. The last stretch of a stream, as long as the lateness, waits for rows to come.

Without a ``lateness`` rows are applied at once: in event order within a batch, so the batches must arrive in order. The
state of a key is a few numbers or strings.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from verdigris.operators.circuit import COOLDOWN_SECONDS, FAILURE_THRESHOLD, after_attempt
from verdigris.operators.windows import LOGIN_ATTEMPTS, LOGIN_WINDOW_SECONDS

# States and moves of a review.
REVIEW_PATH = ("queued", "planning", "reviewing", "aggregating", "completed")
REVIEW_MOVES = {
    "queued": ("planning", "failed", "cancelled"),
    "planning": ("reviewing", "completed", "failed", "cancelled"),
    "reviewing": ("aggregating", "failed", "cancelled"),
    "aggregating": ("completed", "failed", "cancelled"),
    "completed": ("queued",),
    "failed": ("queued",),
    "cancelled": (),
}

# What each action makes of a finding, and from which states it may start (None: any).
FINDING_ACTIONS = {
    "found": ("active", (None,)),
    "found_again": ("reopened", ("fixed_pending_revalidation", "fixed_verified")),
    "candidate": ("candidate_ready", ("active", "reopened", "candidate_ready")),
    "fix": ("fixed_pending_revalidation", ("active", "reopened", "candidate_ready")),
    "not_found": ("fixed_verified", ("fixed_pending_revalidation",)),
    "accept": ("accepted_risk", ("active", "reopened", "candidate_ready", "deferred")),
    "defer": ("deferred", ("active", "reopened", "candidate_ready")),
    "dismiss": ("dismissed", ("active", "reopened", "candidate_ready", "deferred")),
    "reopen": ("reopened", ("fixed_pending_revalidation", "fixed_verified", "accepted_risk", "deferred", "dismissed")),
}
DEADLINE_SECONDS = 60


def _records(rows: pd.DataFrame) -> list[dict]:
    names = list(rows.columns)
    return [dict(zip(names, values)) for values in zip(*(rows[name].tolist() for name in names))]


def _moment(row: dict) -> tuple[int, int]:
    return row["at"], row["sequence"]


class InOrder(StatefulProcessor):
    """Feeds the rows of a key to ``apply`` in event order and keeps what it returns as the key's state.

    Rows that can't be applied at once lie in a map of the state as sorted blocks, by the moment of a block's first row, so that
    no more than one chunk of input or the blocks that overlap are in memory, and a block costs a few calls to the state,
    however many rows it has. The watermark releases whole slots of event time. One timer per key wakes it for the first slot
    or for what ``due`` asks for.
    """

    state_schema = "value string"
    output_names: list[str] = []
    #: Whether rows wait for the watermark, and whether there are timers at all.
    waits = False
    timed = False
    #: Whether a key has moments of its own to wake up at, see ``due``.
    expires = False
    slot_millis = 60_000
    block_rows = 256
    frame_rows = 10_000
    #: The moment of the first row that was left waiting, of those that the current call has seen.
    earliest: int | None = None

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)
        self.blocks = handle.getMapState("blocks", "at bigint, sequence bigint, copy bigint", "rows string")
        self.released = handle.getValueState("released", "slot bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def apply(self, state: tuple | None, row: dict) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def due(self, state: tuple | None) -> int | None:
        """The watermark (milliseconds) at which ``expire`` is to be called, if no row comes before."""
        return None

    def expire(self, state: tuple) -> tuple[tuple | None, list[tuple]]:
        return state, []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.earliest = None
        first, second = next(rows), None if self.waits else next(rows, None)
        if not self.waits and second is None:
            yield from self._apply(key, sorted(_records(first), key=_moment))
        else:
            released = self.released.get() if self.waits else None
            for chunk in chain((first,) if second is None else (first, second), rows):
                yield from self._put(key, chunk, released[0] * 1000 * self.slot_millis if released else None)
            if not self.waits:
                yield from self._apply(key, self._waiting(None))
        if self.waits:  # what waited before has set the timer already, and rows that wait change no state
            self._wake([self._known_timer(), self._slot_end()])
        elif self.timed:
            self._wake([self.due(self.state.get())])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.earliest = None
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.waits:
            end = watermark // self.slot_millis
            yield from self._apply(key, self._waiting(end * 1000 * self.slot_millis))
            self.released.update((end,))
        if self.expires:
            state = self.state.get()
            due = self.due(state)
            if due is not None and due <= watermark:
                state, out = self.expire(state)
                self._keep(state)
                yield self.frame(key, out)
        due = self.due(self.state.get()) if self.expires else None
        self._wake([self._slot_end(), due], expiredTimerInfo.getExpiryTimeInMs())

    def _apply(self, key, rows: Iterable[dict]) -> Iterator[pd.DataFrame]:
        state = self.state.get()
        out: list[tuple] = []
        for row in rows:
            state, emitted = self.apply(state, row)
            out.extend(emitted)
            if len(out) >= self.frame_rows:
                yield self.frame(key, out)
                out = []
        self._keep(state)
        if out:
            yield self.frame(key, out)

    def _put(self, key, rows: pd.DataFrame, released: int | None) -> Iterator[pd.DataFrame]:
        """Rows wait in blocks; those from before ``released`` (microseconds) are given back."""
        held = sorted(_records(rows), key=_moment)
        if released is not None and held[0]["at"] < released:
            yield self.frame(key, [(row["sequence"],) for row in held if row["at"] < released], late=True)
            held = [row for row in held if row["at"] >= released]
        self._hold(held, self.block_rows)

    def _hold(self, rows: list[dict], size: int) -> None:
        """Keeps rows, which are in event order, as blocks of that size."""
        if rows:
            self._left(rows[0]["at"])
        for start in range(0, len(rows), size):
            block = rows[start : start + size]
            place = (*_moment(block[0]), 0)
            while self.blocks.containsKey(place):  # several blocks may begin with equal rows
                place = (*place[:2], place[2] + 1)
            self.blocks.updateValue(place, (json.dumps(block, default=str),))

    def _waiting(self, end: int | None) -> Iterator[dict]:
        """The rows before ``end`` (microseconds; all of them, if there is none) in event order; they are forgotten.

        Blocks are opened as their first rows come up, so that only blocks that overlap are in memory. What a block holds from
        ``end`` on is kept in blocks a quarter as long, so that a row is read again a few times at most.
        """
        opened: list[tuple] = []
        for number, place in enumerate(sorted(tuple(one) for one in self.blocks.keys())):
            if end is not None and place[0] >= end:
                self._left(place[0])
                break
            while opened and opened[0][0] < place[:2]:
                yield heappop(opened)[-1]
            block = json.loads(self.blocks.getValue(place)[0])
            self.blocks.removeKey(place)
            before = len(block) if end is None else bisect_left(block, end, key=lambda row: row["at"])
            for at, row in enumerate(block[:before]):
                heappush(opened, (_moment(row), number, at, row))
            self._hold(block[before:], -(-len(block) // 4))
        while opened:
            yield heappop(opened)[-1]

    def _keep(self, state: tuple | None) -> None:
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)

    def _left(self, at: int) -> None:
        self.earliest = at if self.earliest is None else min(self.earliest, at)

    def _slot_end(self) -> int | None:
        """The watermark (milliseconds) that releases the first row left waiting."""
        return None if self.earliest is None else (int(self.earliest) // (1000 * self.slot_millis) + 1) * self.slot_millis

    def _known_timer(self) -> int | None:
        held = self.timer.get()
        return held[0] if held else None

    def _wake(self, moments: list[int | None], fired: int | None = None) -> None:
        """Sets the key's one timer to the first of the moments. It is kept as a number, since lists of timers and blocks cost more calls."""
        wanted, known = min((one for one in moments if one is not None), default=None), self._known_timer()
        if wanted == known and known != fired:
            return
        if known is not None and known != fired:
            self.handle.deleteTimer(known)
        if wanted is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(wanted)
            self.timer.update((wanted,))

    def frame(self, key, out: list[tuple], late: bool = False) -> pd.DataFrame:
        names = self.output_names
        if late:  # the key and the sequence are all that is said of a late row
            rows = pd.DataFrame([(*key, *item) for item in out], columns=[*names[: len(key)], "sequence"]).reindex(columns=names).astype(object)
            rows = rows.where(rows.notna(), None)
        else:
            rows = pd.DataFrame([(*key, *item) for item in out], columns=names)
        return rows.assign(late=late) if self.waits else rows

    def close(self) -> None:
        pass


class ReviewMachine(InOrder):
    """Moves of a review. State: its status. Refused moves are kept as such in the output."""

    output_names = ["review_id", "sequence", "from_status", "to_status", "accepted"]

    def apply(self, state, row):
        status = state[0] if state else "queued"
        wanted = row["to_status"]
        accepted = wanted in REVIEW_MOVES[status]
        return ((wanted if accepted else status,), [(row["sequence"], status, wanted, accepted)])


class FindingLifecycle(InOrder):
    """State of a finding after each action that applies to it."""

    output_names = ["review_id", "finding_id", "sequence", "state"]

    def apply(self, state, row):
        current = state[0] if state else None
        action = "found_again" if row["action"] == "found" and current in FINDING_ACTIONS["found_again"][1] else row["action"]
        target, sources = FINDING_ACTIONS[action]
        if current not in sources:
            return state, []
        return (target,), [(row["sequence"], target)]


class CurrentAttempt(InOrder):
    """Refuses results of attempts that are no longer the running one. State: attempt, running."""

    state_schema = "attempt bigint, running boolean"
    output_names = ["review_id", "sequence", "attempt", "applied"]

    def apply(self, state, row):
        if row["kind"] == "start":
            return (int(row["attempt"]), True), []
        if row["kind"] == "stop":
            return ((state[0], False) if state else None), []
        applied = state is not None and state[1] and state[0] == row["attempt"]
        return ((state[0], False) if applied else state), [(row["sequence"], row["attempt"], bool(applied))]


class Deadlines(InOrder):
    """Reports a start that nothing followed in time, once. State: sequence of the start, its deadline.

    With ``restart`` every row starts the clock anew (time to live since the last activity); otherwise only
    ``start`` rows do and any other row ends it.
    """

    state_schema = "sequence bigint, deadline bigint"
    output_names = ["review_id", "sequence", "expired_at"]
    expires = True

    def __init__(self, seconds: int, restart: bool = False) -> None:
        self.micros = seconds * 1_000_000
        self.restart = restart

    def apply(self, state, row):
        late = [(state[0], state[1])] if state and row["at"] > state[1] else []
        starts = self.restart or row["kind"] == "start"
        return ((int(row["sequence"]), int(row["at"]) + self.micros) if starts else None), late

    def due(self, state):
        return None if state is None else -(-state[1] // 1000)

    def expire(self, state):
        return None, [(state[0], state[1])]


class RateLimiter(InOrder):
    """Whether an attempt is allowed given recent failures. State: times of those failures since the last success."""

    state_schema = "failures array<bigint>"
    output_names = ["username", "source", "sequence", "recent_failures", "allowed"]

    def __init__(self, allowed: int, window_seconds: int) -> None:
        self.allowed = allowed
        self.micros = window_seconds * 1_000_000

    def apply(self, state, row):
        recent = [at for at in (state[0] if state else []) if at > row["at"] - self.micros]
        verdict = (row["sequence"], len(recent), len(recent) < self.allowed)
        return ([] if row["succeeded"] else [*recent, int(row["at"])],), [verdict]


class Circuit(InOrder):
    """Failure streak and circuit state of an endpoint after each attempt."""

    state_schema = "streak int, opened bigint"
    output_names = ["endpoint", "sequence", "streak", "circuit_open"]

    def __init__(self, threshold: int, cooldown_seconds: int) -> None:
        self.threshold = threshold
        self.cooldown = cooldown_seconds * 1_000_000

    def apply(self, state, row):
        streak, opened = (state[0], state[1]) if state else (0, None)
        streak, opened = after_attempt(streak, opened, int(row["at"]), row["outcome"], self.threshold, self.cooldown)
        return (streak, opened), [(row["sequence"], streak, opened is not None)]


def _process(stream: DataFrame, keys: list[str], processor: InOrder, output: str, lateness: str | None, timed: bool = False) -> DataFrame:
    if lateness is not None:
        # Spark would drop late rows by itself if the column of the watermark came along; the processor tells them instead.
        stream = stream.withWatermark("ts", lateness).drop("ts")
        processor.waits, output = True, f"{output}, late boolean"
    processor.timed = timed or processor.waits
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=output,
        outputMode="Append",
        timeMode="eventTime" if processor.timed else "none",
    )


def review_state_machine(stream: DataFrame, lateness: str | None = None) -> DataFrame:
    """Accepted and refused moves. ``stream``: review_id, sequence, at (microseconds), to_status; with a lateness also ``ts``."""
    output = "review_id bigint, sequence bigint, from_status string, to_status string, accepted boolean"
    return _process(stream, ["review_id"], ReviewMachine(), output, lateness)


def finding_lifecycle(stream: DataFrame, lateness: str | None = None) -> DataFrame:
    """Every state change of every finding. ``stream``: review_id, finding_id, sequence, at, action; with a lateness also ``ts``."""
    output = "review_id bigint, finding_id bigint, sequence bigint, state string"
    return _process(stream, ["review_id", "finding_id"], FindingLifecycle(), output, lateness)


def drop_stale_attempts(stream: DataFrame, lateness: str | None = None) -> DataFrame:
    """Results with whether they were applied. ``stream``: review_id, sequence, at, kind (start, result, stop), attempt; with a
    lateness also ``ts``."""
    output = "review_id bigint, sequence bigint, attempt bigint, applied boolean"
    return _process(stream, ["review_id"], CurrentAttempt(), output, lateness)


def deadline_monitor(stream: DataFrame, seconds: int = DEADLINE_SECONDS, lateness: str | None = None) -> DataFrame:
    """Starts that ran out of time. ``stream``: review_id, sequence, at, kind, ts; ``ts`` has a watermark unless a lateness is given."""
    output = "review_id bigint, sequence bigint, expired_at bigint"
    return _process(stream, ["review_id"], Deadlines(seconds), output, lateness, timed=True)


def expire_by_ttl(stream: DataFrame, seconds: int, lateness: str | None = None) -> DataFrame:
    """Keys without activity for ``seconds``. ``stream`` as in ``deadline_monitor``."""
    output = "review_id bigint, sequence bigint, expired_at bigint"
    return _process(stream, ["review_id"], Deadlines(seconds, restart=True), output, lateness, timed=True)


def stream_rate_limit(
    stream: DataFrame, allowed: int = LOGIN_ATTEMPTS, window_seconds: int = LOGIN_WINDOW_SECONDS, lateness: str | None = None
) -> DataFrame:
    """Verdict per attempt, the username's case ignored. ``stream``: username, source, sequence, at, succeeded; with a lateness
    also ``ts``."""
    output = "username string, source bigint, sequence bigint, recent_failures int, allowed boolean"
    cased = stream.withColumn("username", F.lower("username"))
    return _process(cased, ["username", "source"], RateLimiter(allowed, window_seconds), output, lateness)


def stream_circuit(
    stream: DataFrame, threshold: int = FAILURE_THRESHOLD, cooldown_seconds: int = COOLDOWN_SECONDS, lateness: str | None = None
) -> DataFrame:
    """Streak and circuit per attempt. ``stream``: endpoint, sequence, at, outcome; with a lateness also ``ts``."""
    output = "endpoint bigint, sequence bigint, streak int, circuit_open boolean"
    return _process(stream, ["endpoint"], Circuit(threshold, cooldown_seconds), output, lateness)
