"""Repair of conversations whose roles must read (s?(ua)+)?, by alignment with the alternating string.

A conversation's turns, in order, are kept, given another role, deleted or joined by inserted empty
turns, at the least cost. Blank and repeated turns must go; a turn that breaks off costs extra where
it stays. The turns are aligned with each feasible length of the alternating string (an s leads the
odd lengths) by Wagner-Fischer tables. The string's end is the same for all lengths, so one table of
suffixes, and one for what stands before a kept s, serve them all. A plain walk gives a first cost;
cells that can't be on a path within it (by the deletions and insertions they need at least) are
outside the band. Each cheapest length is traced back to its audit, the letters of the edits (D, I,
K, R) in order, and the smallest audit is taken; an audit names the repaired roles by itself.

Where a band would hold over `most_cells` cells (thousands of turns that hardly alternate), the same
costs are kept per phase of the grammar in place of per length, with the same audit.

Turns stream by in order: what is held of a conversation is a letter and a digest for each turn, never its texts.

Defined cases: NULL roles and texts are one blank each. Turns of one number stand in the order of role and
text; NULL numbers come first. NULL conv_ids are one conversation. Roles count by their first letter, case included. Repeated rows are
duplicates. Extra columns aren't read; an empty table gives no row. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, BROKEN = 3, 4, 3, 3
NEVER = 1 << 40
LEGAL = ("su", "ua", "au")


def _walked(turns: str) -> int:
    """What one walk costs above the base: every turn kept or given the role that is due."""
    cost, due, begun = 0, "u", False
    for k, c in enumerate(turns.lower()):
        if k == 0 and c == "s":
            continue
        cost += REROLE * (c != due)
        due, begun = ("a" if due == "u" else "u"), True
    if due == "a":
        cost += INSERT
    if turns[:1] in ("s", "S") and not begun:
        cost += 2 * INSERT
    return cost


def _bands(turns: str, most: int) -> list[tuple[int, int]]:
    """Lengths left of the string, but for an s, that a path within `most` can have before each turn and after the last."""
    s = int("s" in turns.lower())
    n, broken = len(turns), np.cumsum([0, *[c.isupper() for c in reversed(turns)]])[::-1]
    out = []
    for i in range(n + 1):
        t = int(broken[i])  # broken turns cost less to delete
        gone = most // (DELETE - BROKEN) if most <= t * (DELETE - BROKEN) else t + (most - t * (DELETE - BROKEN)) // DELETE
        out.append((max(0, n - i - gone - s), n - i + most // INSERT))
    return out


class _Table:
    """Costs of suffixes: turns i and later against the last r letters of the string, within the band."""

    def __init__(self, turns: str, bands: list[tuple[int, int]]):
        self.bands, self.drop = bands, [DELETE - BROKEN if c.isupper() else DELETE for c in turns]
        n, low = len(turns), turns.lower()
        self.rows: list[np.ndarray] = [np.zeros(0, np.int64)] * (n + 1)
        self.led: list[np.ndarray] | None = [np.zeros(0, np.int64)] * (n + 1) if "s" in low else None
        r = np.arange(bands[n][0], bands[n][1] + 1)
        self.rows[n] = INSERT * r
        if self.led is not None:
            self.led[n] = np.full(len(r), NEVER)
        for i in range(n - 1, -1, -1):
            r = np.arange(bands[i][0], bands[i][1] + 1)
            other = np.where(low[i] == np.where(r % 2 == 0, "u", "a"), 0, REROLE)
            best = np.minimum(self.drop[i] + self._shifted(self.rows, i, 0), np.where(r > 0, other + self._shifted(self.rows, i, 1), NEVER))
            self.rows[i] = np.minimum(np.minimum.accumulate(best - INSERT * r) + INSERT * r, NEVER)
            if self.led is not None:
                kept = self._shifted(self.rows, i, 0) if low[i] == "s" else np.full(len(r), NEVER)
                self.led[i] = np.minimum(np.where((r % 2 == 0) & (r > 0), kept, NEVER), self.drop[i] + self._shifted(self.led, i, 0))

    def _shifted(self, rows: list[np.ndarray], i: int, by: int) -> np.ndarray:
        """Row i + 1 at the places of row i less `by`."""
        (a, b), (c, d) = self.bands[i], self.bands[i + 1]
        out = np.full(b - a + 1, NEVER)
        begin, end = max(a - by, c), min(b - by, d)
        if begin <= end:
            out[begin + by - a : end + by - a + 1] = rows[i + 1][begin - c : end - c + 1]
        return out

    def at(self, rows: list[np.ndarray], i: int, r: int) -> int:
        a, b = self.bands[i]
        return int(rows[i][r - a]) if a <= r <= b else NEVER

    def ends(self) -> list[tuple[int, bool, int]]:
        """Cost, whether an s leads, and the length after it."""
        a, b = self.bands[0]
        out = [(self.at(self.rows, 0, r), False, r) for r in range(a + a % 2, b + 1, 2)]
        return out + ([(self.at(self.led, 0, r), True, r) for r in range(max(2, a + a % 2), b + 1, 2)] if self.led is not None else [])

    def trace(self, low: str, forced: list[int], led: bool, r: int) -> str:
        """The smallest audit of this length: at every step the first letter that a cheapest path can have."""
        i, n, out = 0, len(low), ["D" * forced[0]]
        while i < n or r:
            rows = self.led if led else self.rows
            now = self.at(rows, i, r)
            if i < n and self.drop[i] + self.at(rows, i + 1, r) == now:
                step = "D"
            elif not led and r and INSERT + self.at(rows, i, r - 1) == now:
                step = "I"
            elif led:
                step, led = "K", False
            else:
                step = "K" if low[i] == ("a" if r % 2 else "u") else "R"
                r -= 1
            r -= step == "I"
            i += step != "I"
            out.append(step + "D" * forced[i] if step != "I" else step)
        return "".join(out)


#: Phases: nothing yet, after an s, user due (may end), assistant due. Phase and letter to the next phase.
_NEXT = {(0, "s"): 1, (0, "u"): 3, (1, "u"): 3, (2, "u"): 3, (3, "a"): 2}
_END = (0, 2 * INSERT, 0, INSERT)


def _by_phase(turns: str, forced: list[int]) -> tuple[int, str]:
    """Cost above the base and the smallest audit, by phases of the grammar."""
    low, n = turns.lower(), len(turns)
    drop = [DELETE - BROKEN if c.isupper() else DELETE for c in turns]
    due = {p: c for (p, c) in _NEXT if c != "s"}
    cost = [list(_END)]
    for i in range(n - 1, -1, -1):
        after, now = cost[-1], []
        for p in range(4):
            best = min(drop[i] + after[p], (0 if low[i] == due[p] else REROLE) + after[_NEXT[p, due[p]]])
            now.append(min(best, after[1]) if p == 0 and low[i] == "s" else best)
        for _ in range(2):
            now = [min(now[p], INSERT + now[_NEXT[p, due[p]]]) for p in range(4)]
        cost.append(now)
    cost.reverse()
    i, p, out = 0, 0, ["D" * forced[0]]
    while i < n or cost[i][p]:
        now, to = cost[i][p], _NEXT[p, due[p]]
        if i < n and drop[i] + cost[i + 1][p] == now:
            step = "D"
        elif INSERT + cost[i][to] == now:
            step, p = "I", to
        elif low[i] == due[p] and cost[i + 1][to] == now:
            step, p = "K", to
        elif p == 0 and low[i] == "s" and cost[i + 1][1] == now:
            step, p = "K", 1
        else:
            step, p = "R", to
        i += step != "I"
        out.append(step + "D" * forced[i] if step != "I" else step)
    return cost[0][0], "".join(out)


def aligned(turns: str, most_cells: int = 1 << 23) -> tuple[int, str]:
    """Cost and audit of turns, a letter each: x must go; s, u, a, o (any other) by role, in capitals if broken off."""
    stay = [k for k, c in enumerate(turns) if c != "x"]
    sound = "".join(turns[k] for k in stay)
    forced = np.diff([-1, *stay, len(turns)]) - 1
    base = DELETE * int(forced.sum()) + BROKEN * sum(c.isupper() for c in sound)
    bands = _bands(sound, _walked(sound))
    if sum(b - a + 1 for a, b in bands) > most_cells:
        cost, audit = _by_phase(sound, forced.tolist())
        return base + cost, audit
    table = _Table(sound, bands)
    ends = table.ends()
    least = min(ends)[0]
    return base + least, min(table.trace(sound.lower(), forced.tolist(), led, r) for c, led, r in ends if c == least)


_aligned = lru_cache(1 << 16)(aligned)


class _Seen:
    """What is held of a conversation."""

    def __init__(self) -> None:
        self.letters: list[str] = []
        self.digests: set[bytes] = set()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.low = self.high = self.last_turn = self.last_role = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last_turn:
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
            self.turns += 1
        initial, body = role[:1], text.strip(SPACE)
        if self.last_role is not None and self.last_role + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.last_role = initial
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(errors="surrogatepass"), digest_size=16).digest()
        fault = "blank" if not body else "duplicate" if key in self.digests else "truncated" if body[-1] not in ".!?" else None
        self.digests.add(key)
        if fault:
            self.counts[fault] += 1
        letter = initial if initial in ("s", "u", "a") else "o"
        self.letters.append("x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)

    def result(self) -> dict:
        turns = "".join(self.letters)
        cost, audit = _aligned(turns) if len(turns) <= 64 else aligned(turns)
        return {"gaps": self.high - self.low + 1 - self.turns if self.turns else 0, **self.counts, "cost": cost, "audit": audit}


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, dict]]:
    """conv_id, whether it is another than before, and the row."""
    before: object = _streamed
    for b in batches:
        for row in b.to_pylist():
            yield (now := row["conv_id"]), now != before or before is _streamed, row
            before = now


def _in_batches(rows: Iterator[dict], schema: pa.Schema, at_once: int = 4096, characters: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r.get("text") or "")
        if len(held) >= at_once or size >= characters:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _mapping(made: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], fields: list[tuple[str, pa.DataType]]):
    """Arrow function that gives made's rows; the column conv_id keeps its type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        if (first := next(batches, None)) is None:
            return
        schema = pa.schema([("conv_id", first.schema.field("conv_id").type), *fields])
        yield from _in_batches(made(_put_back(first, batches)), schema)

    return run


def _put_back(first, rest):
    yield first
    yield from rest


def _auditing(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    conv, seen = None, None
    for now, new, row in _streamed(batches):
        if new:
            if seen:
                yield {"conv_id": conv, **seen.result()}
            conv, seen = now, _Seen()
        seen.add(row["turn"], row["role"], row["text"])
    if seen:
        yield {"conv_id": conv, **seen.result()}


def _repairing(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Of each conversation its audit comes first, then its turns."""
    audit, at, place, length, conv = "", 0, 0, 0, None

    def due() -> str:
        return "user" if (place + length) % 2 == 0 else "assistant"

    def inserted() -> Iterator[dict]:
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            yield {"conv_id": conv, "place": place, "role": due(), "text": "", "edit": "I"}
            at, place = at + 1, place + 1

    for now, _, row in _streamed(batches):
        if row["audit"] is not None:
            conv, audit, at, place = now, row["audit"], 0, 0
            length = len(audit) - audit.count("D")
            yield from inserted()
            continue
        edit = audit[at]
        at += 1
        if edit != "D":
            yield {"conv_id": conv, "place": place, "role": row["role"] if edit == "K" else due(), "text": row["text"], "edit": edit}
            place += 1
        yield from inserted()


def _digesting(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    conv, digest = None, None
    for now, new, row in _streamed(batches):
        if new:
            if digest:
                yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}
            conv, digest = now, hashlib.sha256()
        digest.update(f"{'' if new else chr(10)}{row['role']}:{row['text']}".encode(errors="surrogatepass"))
    if digest:
        yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}


def _in_order(rows: DataFrame, *order: Column | str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role and text of every row; NULL roles and texts are one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by a hash of their place: in 20, one is dropped, emptied, robbed of its ends, repeated and made the user's."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(F.col("_f") == 1, F.lit("")).when(F.col("_f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_f") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("_f") == 0, 0).when(F.col("_f") == 3, 2).otherwise(1)
    copies = F.explode(F.array_repeat(F.lit(0), times)).alias("_c")
    return turns.withColumn("_f", fault).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("_c")


def audits(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, counts of faults, illegal neighbours, cost and audit of every conversation of turns (as turns_of gives them)."""
    fields = [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in AUDIT.split(", ")]
    rows = _in_order(turns.select("conv_id", "turn", "role", "text"), F.asc_nulls_first("turn"), "role", "text")
    return rows.mapInArrow(_mapping(_auditing, fields), f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {AUDIT}")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text and edit (K, R or I) of every turn after the repair that `audits` found."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    heads = found.select("conv_id", none("turn", "long"), none("role", "string"), none("text", "string"), "audit")
    rows = heads.unionByName(turns.select("conv_id", "turn", "role", "text", none("audit", "string")))
    rows = _in_order(rows, F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "text")
    fields = [("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
    return rows.mapInArrow(_mapping(_repairing, fields), f"conv_id {kind}, place long, role string, text string, edit string")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of `role:text` lines by place."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _in_order(rows.select("conv_id", "place", "role", "text"), "place").mapInArrow(_mapping(_digesting, [("repaired_sha256", pa.string())]), f"conv_id {kind}, repaired_sha256 string")


def report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Audit and digest of every conv_id of conversations, also of those that lost all turns."""
    found = stored(audits(turns), "audits")
    ids = conversations.select("conv_id").distinct().withColumnRenamed("conv_id", "_id")
    same = F.col("_id").eqNullSafe(F.col("conv_id"))
    out = ids.join(found, same, "left").drop("conv_id").join(digests(repaired(turns, found)), same, "left").drop("conv_id")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))
    return out.select(F.col("_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), digest.alias("repaired_sha256"))
