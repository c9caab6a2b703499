"""Structure repair of conversations by cost layers (operator 13).

Roles of a repaired conversation form ``(s?(ua)+)?`` by their initials.  For a conversation's turns and each
cost, a bitset says from which states of that grammar the turns behind a place can be brought to an end at
just that cost, as approximate pattern matchers keep a bitset of states for each number of errors.  Layers
are added until the first one that holds the beginning: its number is the least cost.  Walking forward
through the layers, the least letter whose bit is set at each place gives the least audit.

How it is spread:

1. Equal rows of a turn are one row with a count, so a turn repeated any number of times is one.  What moves
   is narrow: a turn, a digest of role and text, an initial, a fault.
2. Rows are range-partitioned by conversation and turn, packed into segments of at most ``SEGMENT`` rows, and
   stored.  A conversation inside one segment is repaired there.  Those that go on in other segments, and
   only these, are repaired in steps: a segment's costs from each state to each, a chain of these by
   conversation, and then each segment's own walk.
3. Texts move once, by conversation, to meet the edits of their turns in order; a digest of the repaired text
   is made as they stream by, so no conversation is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import only, stored

#: Rows of a segment at most.
SEGMENT = 4096
#: States: at the beginning, after s, after u, after a.  The last and the first may end.
BEGIN, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (0, None, None, 0)
#: The state that user or assistant leads to, whichever may come next, and which of them that is.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
NAMES = ("user", "user", "assistant", "user")
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Symbols of rows: 0 must go, else 1 + initial (s, u, a, other) + 4 where the text is truncated.
MUST_GO = 0
S, U, A, OTHER = range(4)
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[S, U] = _LEGAL[U, A] = _LEGAL[A, U] = True


def _keeps(symbol: int) -> tuple[int | None, ...]:
    """The state that keeping a row leads to from each state; None where it may not be kept."""
    if symbol == MUST_GO:
        return (None,) * 4
    initial = (symbol - 1) % 4
    return {S: (AFTER_S, None, None, None), U: (AFTER_U, AFTER_U, None, AFTER_U), A: (None, None, AFTER_A, None), OTHER: (None,) * 4}[initial]


_KEEPS = [_keeps(x) for x in range(9)]
_STEPS = []  # by symbol: (keep by state, cost of keep, whether it may be re-roled, cost of that)
for _x in range(9):
    _more = TRUNCATED if _x > 4 else 0
    _STEPS.append((_KEEPS[_x], _more, _x != MUST_GO, REROLE + _more))


def _before(to: tuple[int | None, ...]) -> list[int]:
    """For each bitset of states, the bitset of those that ``to`` leads from into it."""
    return [sum(1 << q for q in range(4) if to[q] is not None and bits >> to[q] & 1) for bits in range(16)]


_BEFORE_KEEP = [_before(k) for k in _KEEPS]
_BEFORE_NEXT = _before(NEXT)


class Layers:
    """Bitsets of states by cost and place for the symbols of a segment, from its end.

    ``ends``: for each state the cost of what is behind the segment, None where there is no way on.
    ``inside[c]`` has for places the bitset of states from which all that is left costs c at least: bit q of
    place i is state q before row i.  A bit is in the layer of its least cost only, so a layer is small and
    all layers together have no more than four bits for each row.
    """

    def __init__(self, symbols: bytes, ends: tuple[int | None, ...], tail: bool):
        self.symbols, self.ends, self.tail = symbols, ends, tail
        self.inside: list[dict[int, int]] = []
        self._done = bytearray(len(symbols) + 1)
        self._next: dict[int, dict[int, int]] = {}  # by cost, what edits of the layers so far lead to
        for q, cost in enumerate(ends):
            if cost is not None:
                self._lead(cost, len(symbols), 1 << q)

    def _lead(self, cost: int, place: int, bits: int) -> None:
        at = self._next.setdefault(cost, {})
        at[place] = at.get(place, 0) | bits

    def _bits(self, cost: int, place: int) -> int:
        return self.inside[cost].get(place, 0) if 0 <= cost < len(self.inside) else 0

    def add(self) -> None:
        """The layer of the next cost."""
        c, n, layer = len(self.inside), len(self.symbols), {}
        self.inside.append(layer)
        todo = list(self._next.pop(c, {}).items())
        while todo:
            place, bits = todo.pop()
            new = bits & ~self._done[place]
            if not new:
                continue
            self._done[place] |= new
            layer[place] = layer.get(place, 0) | new
            moved = _BEFORE_NEXT[new]
            if moved and (place < n or self.tail):  # insert in front of each row, and behind the last of a conversation
                self._lead(c + INSERT, place, moved)
            if not place:
                continue
            keep, cost, rerole, rerole_cost = _STEPS[self.symbols[place - 1]]
            self._lead(c + DELETE, place - 1, new)
            if rerole and moved:
                self._lead(c + rerole_cost, place - 1, moved)
            if kept := _BEFORE_KEEP[self.symbols[place - 1]][new]:
                if cost:
                    self._lead(c + cost, place - 1, kept)
                else:
                    todo.append((place - 1, kept))

    def first(self, state: int) -> int | None:
        """The first layer that holds ``state`` at the beginning; None where none does."""
        while not self._done[0] >> state & 1:
            if not self._next:
                return None
            self.add()
        return next(c for c, layer in enumerate(self.inside) if layer.get(0, 0) >> state & 1)

    def walk(self, state: int, cost: int) -> tuple[list[str], list[int], int]:
        """(letters by row, those behind the last as one more; the states before each row; the last state)."""
        letters, states, place, n = [""], [state], 0, len(self.symbols)
        while True:
            symbol = self.symbols[place] if place < n else MUST_GO
            keep, keep_cost, rerole, rerole_cost = _STEPS[symbol]
            if place == n and self.ends[state] == cost:
                return letters, states, state
            if place < n and self._bits(cost - DELETE, place + 1) >> state & 1:
                letter, to, spent = "D", state, DELETE
            elif (place < n or self.tail) and self._bits(cost - INSERT, place) >> NEXT[state] & 1:
                letters[-1] += "I"
                state, cost = NEXT[state], cost - INSERT
                continue
            elif keep[state] is not None and self._bits(cost - keep_cost, place + 1) >> keep[state] & 1:
                letter, to, spent = "K", keep[state], keep_cost
            else:
                letter, to, spent = "R", NEXT[state], rerole_cost
            letters[-1] += letter
            letters.append("")
            state, cost, place = to, cost - spent, place + 1
            states.append(state)


_seen: dict[bytes, tuple[int, list[str], list[int]]] = {}


def repair(symbols: bytes) -> tuple[int, list[str], list[int]]:
    """(cost, letters by row and behind the last, states before each row) of a whole conversation."""
    found = _seen.get(symbols)
    if found is None:
        layers = Layers(symbols, ENDS, True)
        cost = layers.first(BEGIN)
        letters, states, _ = layers.walk(BEGIN, cost)
        found = (cost, letters, states)
        if len(symbols) <= 16:  # short ones come again and again
            if len(_seen) > 1 << 16:
                _seen.clear()
            _seen[symbols] = found
    return found


def transfer(symbols: bytes) -> list[int]:
    """Least costs of a segment's turns from state to state, 16 numbers, -1 where there is no way."""
    out = [-1] * 16
    for to in range(4):
        layers = Layers(symbols, tuple(0 if q == to else None for q in range(4)), False)
        for q in range(4):
            c = layers.first(q)
            out[4 * q + to] = -1 if c is None else c
    return out


# --- rows ------------------------------------------------------------------------------------------


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(OTHER)


def _truncated(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"[.!?][\x20\x09-\x0D]*\z"))


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(_ck, _turn, _role, _text, _m) after damage: ``_m`` says how many rows a row stands for, 1 or 2."""
    own = only(rows, conv_col, turn_col, role_col, text_col)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    own = own.select(_key(F.col(conv_col)).alias("_ck"), F.col(turn_col).cast("long").alias("_turn"), blank(role_col).alias("_role"), blank(text_col).alias("_text"), fate.alias("_fate")).where("_fate > 0")
    text = F.when(F.col("_fate") == 1, F.lit("")).when(F.col("_fate") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    role = F.when(F.col("_fate") == 4, F.lit("user")).otherwise(F.col("_role"))
    return own.select("_ck", "_turn", role.alias("_role"), text.alias("_text"), F.when(F.col("_fate") == 3, 2).otherwise(1).cast("long").alias("_m"))


def _key(conv: Column) -> Column:
    """A conversation's key as a string that is never null and tells a null from any value."""
    return F.when(conv.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), conv.cast("string")))


def undamaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows as they are, nulls as one space, in the form of ``damaged``: to repair real conversations."""
    own = only(rows, conv_col, turn_col, role_col, text_col)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return own.select(_key(F.col(conv_col)).alias("_ck"), F.col(turn_col).cast("long").alias("_turn"), blank(role_col).alias("_role"), blank(text_col).alias("_text"), F.lit(1).cast("long").alias("_m"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), F.col("_role"), F.col("_text")), 256))


def turns(rows: DataFrame) -> DataFrame:
    """(_ck, _turn, _d, _m, _symbol, _initial, _blank, _again): one narrow row for all equal rows of a turn, in
    the form that ``damaged`` gives.  ``_again``: an earlier turn has the same role and text."""
    narrow = rows.select("_ck", "_turn", _digest().alias("_d"), _initial(F.col("_role")).alias("_initial"), (~F.rlike("_text", F.lit(r"[^\x20\x09-\x0D]"))).alias("_blank"), _truncated(F.col("_text")).alias("_cut"), "_m")
    one = narrow.groupBy("_ck", "_turn", "_d").agg(F.sum("_m").alias("_m"), *[F.any_value(c).alias(c) for c in ("_initial", "_blank", "_cut")])
    one = stored(one, "turns")
    # what a conversation says in several turns; a join of two plain shuffles is one that adaptive execution may split
    place = F.struct(F.col("_turn").isNotNull().alias("k"), F.col("_turn").alias("t"))
    many = one.where(~F.col("_blank")).groupBy("_ck", "_d").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    many = stored(many.select("_ck", "_d", "_first"), "repeated")
    both = one.join(many, ["_ck", "_d"], "left").withColumn("_again", F.coalesce(F.col("_first") < place, F.lit(False)))
    symbol = F.when(F.col("_blank") | F.col("_again"), MUST_GO).otherwise(1 + F.col("_initial") + F.when(F.col("_cut"), 4).otherwise(0))
    return both.select("_ck", "_turn", "_d", "_m", symbol.alias("_symbol"), "_initial", "_blank", "_again")


_SEGMENT = "_ck string, _part int, _seq bigint, _whole boolean, _turns array<bigint>, _ds array<binary>, _ms array<bigint>, _symbols binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint, _distinct bigint, _low bigint, _high bigint, _head int, _tail int, _last bigint"
_NAMES = [c.split(" ")[0] for c in _SEGMENT.split(", ")]
_ORDER = ["_ck", "_turn", "_d"]


def _pack(table: pa.Table, size: int, part: int, seq: int, fresh: bool, done: bool) -> pa.RecordBatch:
    """Segments of sorted rows; the first is whole if ``fresh``, the last if ``done``: nothing of its
    conversation is elsewhere."""
    n = len(table)
    key = table.column("_ck").to_numpy(zero_copy_only=False)
    new = np.r_[True, key[1:] != key[:-1]]
    conv = np.cumsum(new) - 1
    at = np.arange(n) - np.flatnonzero(new)[conv]
    cut = new | (at % size == 0)
    start = np.flatnonzero(cut)
    end = np.r_[start[1:], n]
    seg = np.cumsum(cut) - 1
    split = np.bincount(conv[start])[conv[start]] > 1
    edge = np.zeros(len(start), bool)
    edge |= (conv[start] == 0) & (not fresh)
    edge |= (conv[start] == conv[-1]) & (not done)
    turn_null = table.column("_turn").is_null().to_numpy()
    turn = table.column("_turn").fill_null(0).to_numpy()
    m = table.column("_m").to_numpy()
    symbol = table.column("_symbol").to_numpy().astype(np.uint8)
    initial = table.column("_initial").to_numpy().astype(np.int64)
    blank, again = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("_blank", "_again"))
    total = lambda x: np.add.reduceat(x.astype(np.int64), start)
    duplicate = np.where(blank, 0, m - 1 + again)
    illegal = m - 1  # equal initials never follow each other
    illegal[1:] += (~cut[1:]) & ~_LEGAL[initial[:-1], initial[1:]]
    distinct = ~turn_null & (cut | np.r_[True, (turn[1:] != turn[:-1]) | turn_null[:-1]])
    low, high = np.where(turn_null, np.iinfo(np.int64).max, turn), np.where(turn_null, np.iinfo(np.int64).min, turn)
    none = np.logical_and.reduceat(turn_null, start)
    ints = lambda x: pa.array(x, pa.int64())
    lists = lambda c: pa.ListArray.from_arrays(pa.array(np.r_[start, n], pa.int32()), table.column(c).combine_chunks())
    raw = symbol.tobytes()
    cols = [
        pa.array(key[start], pa.string()), pa.array(np.full(len(start), part), pa.int32()), ints(seq + np.arange(len(start))), pa.array(~split & ~edge),
        lists("_turn"), lists("_d"), lists("_m"), pa.array([raw[a:b] for a, b in zip(start, end)], pa.binary()),
        ints(total(np.where(blank, m, 0))), ints(total(duplicate)), ints(total(~blank & ~again & (symbol > 4))), ints(total(illegal)), ints(total(distinct)),
        pa.array(np.minimum.reduceat(low, start), pa.int64(), mask=none), pa.array(np.maximum.reduceat(high, start), pa.int64(), mask=none),
        pa.array(initial[start], pa.int32()), pa.array(initial[end - 1], pa.int32()), pa.array(turn[end - 1], pa.int64(), mask=turn_null[end - 1]),
    ]
    return pa.RecordBatch.from_arrays(cols, names=_NAMES)


def segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """``turns`` packed in order, stored.  ``_whole`` says that a conversation is one segment for sure; others may
    go on in the next segment or partition, which (_part, _seq) number."""
    dealt = rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        part, seq, fresh = 0, 0, False
        for batch in batches:
            if not len(batch):
                continue
            part = batch.column(batch.schema.get_field_index("_part"))[0].as_py()
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            # the last conversation waits for more of it, unless it has filled segments, which go
            key = table.column("_ck").to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if last:
                out = _pack(table.slice(0, last), size, part, seq, fresh, True)
                yield out
                seq, fresh = seq + len(out), True
                table = table.slice(last)
            full = len(table) // size * size
            if full:
                out = _pack(table.slice(0, full), size, part, seq, False, False)
                yield out
                seq, fresh = seq + len(out), False
                table = table.slice(full)
            rest = table if len(table) else None
        if rest is not None:
            yield _pack(rest, size, part, seq, False, False)

    return stored(dealt.mapInArrow(run, _SEGMENT), "segments")


# --- conversations of several segments --------------------------------------------------------------

_INF = -1


def _plus(costs: list[int], behind: list[int]) -> list[int]:
    """Costs from each state through a segment (16 numbers) and then on (4 numbers)."""
    out = []
    for q in range(4):
        ways = [costs[4 * q + t] + behind[t] for t in range(4) if costs[4 * q + t] >= 0 and behind[t] >= 0]
        out.append(min(ways) if ways else _INF)
    return out


def _tail_costs() -> list[int]:
    """From each state to an end, behind the last row."""
    layers = Layers(b"", ENDS, True)
    return [layers.first(q) for q in range(4)]


def _linked(parts: DataFrame) -> DataFrame:
    """(_ck, _part, _seq, _state, _behind, _ends): the state before each segment on the cheapest, least way, and the
    costs of all that is behind it; ``_ends`` says that nothing is."""
    spark = parts.sparkSession
    if parts.isEmpty():
        return spark.createDataFrame([], "_ck string, _part int, _seq bigint, _state int, _behind array<bigint>, _ends boolean")

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [transfer(s) for s in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(costs, pa.list_(pa.int64()))], names=["_ck", "_part", "_seq", "_costs"])

    def behind(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_part", "_seq"])
        now, out = _tail_costs(), []
        for costs in reversed(pdf["_costs"].tolist()):
            out.append(now)
            now = _plus(list(costs), now)
        pdf = pdf[["_ck", "_part", "_seq"]].assign(_behind=out[::-1])
        return pdf.assign(_ends=[False] * (len(pdf) - 1) + [True])

    costs = parts.select("_ck", "_part", "_seq", "_symbols").mapInArrow(through, "_ck string, _part int, _seq bigint, _costs array<bigint>")
    chain = stored(costs.groupBy("_ck").applyInPandas(behind, "_ck string, _part int, _seq bigint, _behind array<bigint>, _ends boolean"), "behind")

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exits = []
            for symbols, costs, ends in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                exits.append([_walk(symbols, costs, ends, q)[2] for q in range(4)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), batch.column(4), batch.column(5), pa.array(exits, pa.list_(pa.int32()))], names=["_ck", "_part", "_seq", "_behind", "_ends", "_exits"])

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_part", "_seq"])
        state, states = BEGIN, []
        for exits in pdf["_exits"]:
            states.append(state)
            state = int(exits[state])
        return pdf[["_ck", "_part", "_seq", "_behind", "_ends"]].assign(_state=states)[["_ck", "_part", "_seq", "_state", "_behind", "_ends"]]

    kind = "_ck string, _part int, _seq bigint, _behind array<bigint>, _ends boolean"
    exits = parts.select("_ck", "_part", "_seq", "_symbols").join(chain, ["_ck", "_part", "_seq"]).mapInArrow(leave, f"{kind}, _exits array<int>")
    return stored(exits.groupBy("_ck").applyInPandas(enter, "_ck string, _part int, _seq bigint, _state int, _behind array<bigint>, _ends boolean"), "entered")


def _walk(symbols: bytes, behind: list[int], last: bool, state: int) -> tuple[list[str], list[int], int, int]:
    """(letters, states, last state, cost) of a segment entered in ``state``; a dead end gives the state back."""
    ends = ENDS if last else tuple(None if b < 0 else b for b in behind)
    layers = Layers(symbols, ends, last)
    cost = layers.first(state)
    if cost is None:
        return [], [], state, -1
    letters, states, to = layers.walk(state, cost)
    return letters, states, to, cost


#: A segment with the cost of all from its beginning on, but for the repeats of its rows, which all go (``_extra``);
#: its part of the audit; and by row the letters up to it and the state before them, with one more entry where the
#: conversation ends.
_EDITS = _SEGMENT + ", cost bigint, _extra bigint, audit string, _ops array<string>, _states array<int>"


def _edits(whole: DataFrame, linked: DataFrame) -> DataFrame:
    """``_EDITS`` of segments; ``linked`` ones have the columns of ``_linked`` besides."""
    at = _NAMES.index("_symbols")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _edit_batch(batch, [repair(s) for s in batch.column(at).to_pylist()])

    def one_of_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for symbols, state, behind, last in zip(*(batch.column(i).to_pylist() for i in (at, len(_NAMES), len(_NAMES) + 1, len(_NAMES) + 2))):
                letters, states, _, cost = _walk(symbols, behind, last, state)
                done.append((cost, letters, states))
            yield _edit_batch(batch, done)

    return whole.select(*_NAMES).mapInArrow(alone, _EDITS).unionByName(linked.select(*_NAMES, "_state", "_behind", "_ends").mapInArrow(one_of_many, _EDITS))


def _edit_batch(batch: pa.RecordBatch, done: list[tuple[int, list[str], list[int]]]) -> pa.RecordBatch:
    audits, extra = [], []
    for (_, letters, _), many in zip(done, batch.column(_NAMES.index("_ms")).to_pylist()):
        # a repeat goes right behind its row: no letter is less than D
        audits.append("".join(a + "D" * (m - 1) for a, m in zip(letters, many)) + letters[-1])
        extra.append(DELETE * (sum(many) - len(many)))
    cols = [pa.array([c for c, _, _ in done], pa.int64()), pa.array(extra, pa.int64()), pa.array(audits, pa.string()), pa.array([x for _, x, _ in done], pa.list_(pa.string())), pa.array([s for _, _, s in done], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(_NAMES))), *cols], names=[*_NAMES, "cost", "_extra", "audit", "_ops", "_states"])


def lines_of(ops: str, state: int, role: str | None, text: str | None) -> Iterator[str]:
    """The repaired lines ``role:text`` that the letters up to a row make, from the state before them."""
    for letter in ops:
        if letter == "K":
            yield f"{role}:{text}"
        elif letter == "R":
            yield f"{NAMES[state]}:{text}"
        elif letter == "I":
            yield f"{NAMES[state]}:"
            state = NEXT[state]


def _hashes(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(_ck, repaired_sha256): texts and edits meet in order, by conversation, and stream by."""
    cols = ["_ck", "_turn", "_d", "_tag", "_ops", "_state", "_role", "_text"]
    null = lambda t: F.lit(None).cast(t)
    texts = rows.select("_ck", "_turn", _digest().alias("_d"), F.lit(1).alias("_tag"), null("string").alias("_ops"), null("int").alias("_state"), "_role", "_text")
    marks = edits.select("_ck", "_turn", "_d", F.lit(0).alias("_tag"), "_ops", "_state", null("string").alias("_role"), null("string").alias("_text"))
    ends = edits.where("_end <> ''").select("_ck", F.lit((1 << 63) - 1).alias("_turn"), "_d", F.lit(2).alias("_tag"), F.col("_end").alias("_ops"), F.col("_end_state").alias("_state"), null("string").alias("_role"), null("string").alias("_text"))
    both = texts.unionByName(marks).unionByName(ends).select(*cols)
    # the letters behind the last row come last even where a turn is the largest number
    order = ["_ck", F.col("_tag") == 2, "_turn", "_d", "_tag"]
    dealt = both.repartition("_ck").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, empty, ops, state = None, None, True, "", 0
        keys, found = [], []
        for batch in batches:
            for ck, tag, o, s, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6, 7))):
                if ck != key:
                    if key is not None:
                        keys.append(key)
                        found.append(digest.hexdigest())
                    key, digest, empty = ck, hashlib.sha256(), True
                if tag == 0:
                    ops, state = o, s
                    continue
                if tag == 2:
                    ops, state = o, s
                for line in lines_of(ops, state, role, text):
                    digest.update((line if empty else "\n" + line).encode())
                    empty = False
                ops = ""  # equal rows of a turn are one
            if len(keys) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["_ck", "repaired_sha256"])
                keys, found = [], []
        if key is not None:
            keys.append(key)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["_ck", "repaired_sha256"])

    return dealt.mapInArrow(run, "_ck string, repaired_sha256 string")


def _summary(met: DataFrame) -> DataFrame:
    """(_ck, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows."""
    counts = ["blank", "duplicate", "truncated"]
    done = met.where("_whole").select("_ck", F.coalesce(F.col("_high") - F.col("_low") + 1 - F.col("_distinct"), F.lit(0)).alias("gaps"), *counts, "illegal", (F.col("cost") + F.col("_extra")).alias("cost"), "audit")
    # a row for each segment: what lies between neighbours is counted where both are known
    first_turn = F.get("_turns", F.lit(0))
    some = met.where("not _whole").select("_ck", F.struct("_part", "_seq", "_head", "_tail", first_turn.alias("first"), "_last", "cost", "audit").alias("s"), *counts, "illegal", "_distinct", "_extra", "_low", "_high")
    grouped = some.groupBy("_ck").agg(F.sort_array(F.collect_list("s")).alias("s"), *[F.sum(c).alias(c) for c in [*counts, "illegal", "_distinct", "_extra"]], F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    pair = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    legal = lambda x: ((x["a"]["_tail"] == S) & (x["b"]["_head"] == U)) | ((x["a"]["_tail"] == U) & (x["b"]["_head"] == A)) | ((x["a"]["_tail"] == A) & (x["b"]["_head"] == U))
    broken = F.size(F.filter(pair, lambda x: ~legal(x)))
    shared = F.size(F.filter(pair, lambda x: F.coalesce(x["a"]["_last"] == x["b"]["first"], F.lit(False))))
    several = grouped.select(
        "_ck", F.coalesce(F.col("_high") - F.col("_low") + 1 - (F.col("_distinct") - shared), F.lit(0)).cast("long").alias("gaps"), *counts, (F.col("illegal") + broken).alias("illegal"),
        (F.get("s", F.lit(0))["cost"] + F.col("_extra")).alias("cost"), F.array_join(F.transform("s", lambda x: x["audit"]), "").alias("audit"),
    )
    return done.unionByName(several)


def repair_conversations(rows: DataFrame, size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(summary by ``_ck``, edits) of rows in the form of ``damaged``.

    Edits are (_ck, _turn, _d, _ops, _state, _end, _end_state): for each narrow row of ``turns`` the letters up to
    it and the state before them; ``_end`` those behind the last row of a conversation.
    """
    packed = segments(turns(rows), size)
    loose = packed.where("not _whole")
    edits = stored(_edits(packed.where("_whole"), loose.join(_linked(loose), ["_ck", "_part", "_seq"])), "edits")
    last = lambda c: F.when(F.col("_i") == F.size("_turns") - 1, F.get(c, F.col("_i") + 1))
    by_row = edits.select("*", F.explode(F.sequence(F.lit(0), F.size("_turns") - 1)).alias("_i")).select(
        "_ck", F.get("_turns", F.col("_i")).alias("_turn"), F.get("_ds", F.col("_i")).alias("_d"), F.get("_ops", F.col("_i")).alias("_ops"), F.get("_states", F.col("_i")).alias("_state"),
        F.coalesce(last("_ops"), F.lit("")).alias("_end"), last("_states").alias("_end_state"),
    )
    return _summary(edits), by_row


def conversation_repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True, size: int = SEGMENT) -> DataFrame:
    """One row per conversation of ``rows``: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    With ``damage`` rows are damaged first, as ``damaged`` does.  Null roles and texts count as one space, a null
    turn comes first and takes no part in gaps, and all rows with a null id are one conversation.  Rows of a
    turn go by the digest of role and text; equal ones are neighbours.  Ids and turns may be of any type that
    has a text form and a 64-bit number.  Texts of any length are read whole; an empty table gives an empty
    result; a conversation without rows after damage has zeros, no audit and the digest of no text.  Other
    columns are ignored, whatever their names.
    """
    after = (damaged if damage else undamaged)(rows, conv_col, turn_col, role_col, text_col)
    summary, edits = repair_conversations(after, size)
    hashes = _hashes(after, edits)
    whole = only(rows, conv_col).select(F.col(conv_col), _key(F.col(conv_col)).alias("_ck")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return whole.join(summary, "_ck", "left").join(hashes, "_ck", "left").select(
        conv_col, *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = False) -> DataFrame:
    """(_ck, turn, at, role, text): the repaired conversations as rows, to be ordered by turn and at; inserted rows
    have the turn of the row that they come before, or of the last one."""
    after = (damaged if damage else undamaged)(rows, conv_col, turn_col, role_col, text_col)
    _, edits = repair_conversations(after)
    texts = after.withColumn("_d", _digest()).groupBy("_ck", "_turn", "_d").agg(F.any_value("_role").alias("_role"), F.any_value("_text").alias("_text"))
    keyed = texts.select(F.col("_ck").alias("_k"), F.col("_turn").alias("_t"), F.col("_d").alias("_h"), "_role", "_text")
    met = edits.join(keyed, (edits["_ck"] == keyed["_k"]) & edits["_turn"].eqNullSafe(keyed["_t"]) & (edits["_d"] == keyed["_h"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ck, turn, d, ops, state, end, end_state, role, text in zip(*(batch.column(i).to_pylist() for i in range(9))):
                lines = [*lines_of(ops, state, role, text), *lines_of(end, end_state or 0, None, None)]
                for i, line in enumerate(lines):
                    r, t = (role, text) if line == f"{role}:{text}" else line.split(":", 1)
                    out.append((ck, turn, f"{d.hex()}:{i:03d}", r, t))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["_ck", "turn", "at", "role", "text"])

    return met.select("_ck", "_turn", "_d", "_ops", "_state", "_end", "_end_state", "_role", "_text").mapInArrow(run, "_ck string, turn bigint, at string, role string, text string")


def conversation_sql() -> str:
    """The same rows in DuckDB's SQL: suffixes of a conversation from its end, of each state the least string of
    cost and audit."""
    none, of = "'~'", lambda q: f"b[{q + 1}]"

    def more(cost: str, letter: str, s: str) -> str:
        return f"CASE WHEN {s} = '~' THEN '~' ELSE lpad((left({s}, 9)::INT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({s}, 10) END"

    cut, state = "CASE WHEN cut THEN 3 ELSE 0 END", {"s": ("1", none, none, none), "u": ("2", "2", none, "2"), "a": (none, none, "3", none)}
    direct = []
    for q in range(4):
        keep = "CASE WHEN gone THEN '~' " + " ".join(f"WHEN ini = '{i}' THEN {more(cut, 'K', of(int(t[q])))}" for i, t in state.items() if t[q] != none) + " ELSE '~' END"
        rerole = f"CASE WHEN gone THEN '~' ELSE {more(f'3 + {cut}', 'R', of(NEXT[q]))} END"
        direct.append(f"least({more('4', 'D', of(q))}, {keep}, {rerole})")
    ins = lambda k: "[" + ", ".join(f"least(b[{q + 1}], {more('3', 'I', of(NEXT[q]))})" for q in range(4)) + "]"
    return rf"""
WITH RECURSIVE f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
       list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(k))), lambda i: ord(k[i + 1])::BIGINT)), lambda c, x:
         list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc
     FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
g AS (SELECT *, xor(crc, 4294967295) % 20 AS fate FROM f),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM g WHERE fate > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(len(role) || ':' || role || text), copy) AS i FROM d),
n AS (SELECT *, left(role, 1) AS ini, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
      NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM o),
m AS (SELECT *, blank OR again AS gone FROM n),
h AS (SELECT conv_id, max(i) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND again) AS duplicate,
      count(*) FILTER (WHERE NOT gone AND cut) AS truncated, count(*) FILTER (WHERE i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id),
w(conv_id, i, b) AS (
  SELECT conv_id, last, {ins(1).replace('b[', 'e[')} FROM (SELECT conv_id, last, {ins(0)} AS e FROM (SELECT conv_id, last, ['000000000', '~', '~', '000000000'] AS b FROM h))
  UNION ALL
  SELECT conv_id, i - 1, {ins(1).replace('b[', 'e[')} FROM (SELECT conv_id, i, {ins(0)} AS e FROM (
    SELECT w.conv_id, w.i, [{', '.join(direct)}] AS b FROM w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i))),
r AS (SELECT conv_id, left(b[1], 9)::BIGINT AS cost, substr(b[1], 10) AS audit FROM w WHERE i = 0),
l AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM r),
x AS (SELECT conv_id, p, substr(audit, p, 1) AS letter, len(replace(left(audit, p), 'I', '')) AS i FROM l),
y AS (SELECT x.*, m.role, m.text, CASE letter WHEN 'K' THEN left(m.role, 1) END AS ini FROM x LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM x.conv_id AND m.i = x.i AND letter <> 'I' WHERE letter <> 'D'),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS j, first_value(ini) OVER (PARTITION BY conv_id ORDER BY p) AS head FROM y),
t AS (SELECT conv_id, p, CASE WHEN letter = 'K' THEN role ELSE CASE WHEN (j - CASE WHEN coalesce(head, '') = 's' THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END AS line FROM z),
s AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY p)) AS repaired_sha256 FROM t GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
"""
