"""Conversations whose roles are out of order, empty, doubled or cut off, and their cheapest repair.

Rows are sorted over the whole table by conversation and turn, so a conversation of any
length lies in consecutive tasks. A task cuts what it reads of a conversation into stretches
of bounded length. Conversations that begin and end within a task and have one stretch are
repaired there. Of the others, only the cost from each state before a stretch to each state
after it is needed to carry prices from the last stretch to the first; then every stretch
finds its edits for each state it may be entered in, and a pass from the first to the last
picks them. Those two passes read a few numbers per stretch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from accesslens.llm import auction_paths as paths
from accesslens.llm.ordering import NULL_KEY, key_column
from accesslens.llm.shared import arrow_map, quoted, record, small_batches, stored

#: Rows of one stretch.
STRETCH_ROWS = 4096
#: Stretches whose lattices are solved together.
TOGETHER = 512

BLANKS = " \t\n\v\f\r"
_TEXTS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FACTS = [
    (name, pa.int64())
    for name in ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns", "min_turn", "max_turn")
]
_EDGES = [(name, pa.int64()) for name in ("first_kind", "last_kind", "first_turn", "last_turn")]
_STRETCH = pa.schema(
    [("conv", pa.int64()), ("open", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("piece", pa.int64())]
    + [("a", pa.int64()), ("b", pa.int64()), *_FACTS, *_EDGES, ("cost", pa.int64()), ("audit", pa.string())]
    + [("repaired", _TEXTS), ("rows", _TEXTS), ("kinds", pa.binary()), ("faults", pa.binary())]
)
_STRETCH_DDL = (
    "conv long, open boolean, turn long, role string, piece long, a long, b long, "
    + "".join(f"{name} long, " for name, _ in _FACTS + _EDGES)
    + "cost long, audit string, repaired array<struct<role string, text string>>,"
    " rows array<struct<role string, text string>>, kinds binary, faults binary"
)


def _prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Keys as numbers, NULL role and text as one space, kind and fault of each row."""
    told = {name: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" ")) for name, c in (("role", role), ("text", text))}
    rows = rows.select(key_column(quoted(conv)).alias("conv"), key_column(quoted(turn)).alias("turn"), *(c.alias(n) for n, c in told.items()))
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = (
        F.when(F.trim("text", F.lit(BLANKS)) == "", paths.BLANK)
        .when(F.instr(F.lit(".!?"), end) == 0, paths.TRUNCATED)
        .otherwise(paths.NO_FAULT)
    )
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    bits = (F.xxhash64(F.lit(seed), "role", F.lit(":"), "text").alias(name) for seed, name in ((1, "a"), (2, "b")))
    return rows.select("*", fault.alias("fault"), kind.alias("kind"), *bits)


def _copies_merged(rows: DataFrame) -> DataFrame:
    """Equal rows of an Arrow batch as one row with their number, before anything is shuffled."""

    def start():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [batch.column(c).to_numpy() for c in ("b", "a", "turn", "conv")]
            order = np.lexsort(columns)
            new = np.zeros(len(order), bool)
            new[:1] = True
            for values in columns:
                new[1:] |= values[order][1:] != values[order][:-1]
            at = np.flatnonzero(new)
            merged = batch.take(pa.array(order[at]))
            return merged.append_column("copies", pa.array(np.diff(np.append(at, len(order))), pa.int64()))

        return run

    return arrow_map(rows, start, rows.withColumn("copies", F.lit(0).cast("long")).schema)


def stretches(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    stretch_rows: int = STRETCH_ROWS,
) -> DataFrame:
    """Repaired stretches of conversations: one row for nearly all, more for very long ones.

    Returns `conv` (NULL: the least long), `part` (from 0), `n_parts`, `n_rows`, the faults
    `blank`, `duplicate`, `truncated` and `illegal`, `turns` (distinct ones that are not NULL),
    `min_turn`, `max_turn`, `cost`, `audit` (letters of the edits) and `repaired`, an array of
    `role`, `text`. Numbers of the parts of a conversation add up; the least and largest turns
    are for min and max.

    Rows are taken by turn, NULL turns first, rows of one turn by role and then by a hash
    of their text. NULL roles and texts are one space, NULL conversations are one
    conversation. A row with the role and text of an earlier one is a duplicate, repeated
    rows included. No row in, none out; other columns are not read.
    """
    ready = _prepared(rows, conv_col, turn_col, role_col, text_col)
    again = ready.groupBy("conv", "a", "b").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    again = stored(again.where("first_turn < last_turn").drop("last_turn"))
    ready = _copies_merged(ready).join(again, ["conv", "a", "b"], "left")
    repeated = F.coalesce(F.col("turn") > F.col("first_turn"), F.lit(False)) & (F.col("fault") != paths.BLANK)
    ready = ready.withColumn("fault", F.when(repeated, paths.DUPLICATE).otherwise(F.col("fault"))).drop("first_turn")
    order = ["conv", "turn", "role", "a", "b"]
    small_batches(rows.sparkSession)
    sorted_rows = ready.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = stored(sorted_rows.mapInArrow(partial(_cut_and_repaired, stretch_rows=stretch_rows), _STRETCH_DDL))
    done = [*("conv", "part", "n_parts"), *(name for name, _ in _FACTS), "cost", "audit", "repaired"]
    whole = cut.where("NOT open").withColumns({"part": F.lit(0), "n_parts": F.lit(1)}).select(*done)
    return whole.unionByName(_repaired_across_tasks(cut.where("open")).select(*done))


def _cut_and_repaired(batches, stretch_rows: int) -> Iterator[pa.RecordBatch]:
    """Stretches of a task's rows; those of conversations known to be whole are repaired."""
    held: list[_Stretch] = []
    current: _Stretch | None = None
    first = True
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "a", "b", "text", "kind", "fault", "copies")]
        for conv, turn, role, a, b, text, kind, fault, copies in zip(*columns):
            key = (conv, turn, a, b)
            if current is None or conv != current.conv:
                if current is not None:
                    current.open |= first or current.piece > 0
                    first = False
                    held.append(current)
                current = _Stretch(conv, (turn, role, a, b), 0)
            elif current.last_key == key and fault != paths.BLANK:
                fault = paths.DUPLICATE
            for copy in range(copies):
                if len(current.kinds) == stretch_rows:
                    current.open = True
                    held.append(current)
                    current = _Stretch(conv, (turn, role, a, b), current.piece + 1)
                if copy and fault != paths.BLANK:
                    fault = paths.DUPLICATE
                current.add(turn, kind, fault, role, text)
                current.last_key = key
                if len(held) >= TOGETHER:
                    yield _solved(held)
                    held = []
    if current is not None:
        current.open = True
        held.append(current)
    if held:
        yield _solved(held)


class _Stretch:
    """Consecutive rows of one conversation."""

    def __init__(self, conv: int, start: tuple, piece: int):
        self.conv, self.start, self.piece, self.open = conv, start, piece, False
        self.kinds: list[int] = []
        self.faults: list[int] = []
        self.turns: list[int] = []
        self.rows: list[dict | None] = []
        self.last_key: tuple | None = None

    def add(self, turn: int, kind: int, fault: int, role: str, text: str) -> None:
        self.kinds.append(kind)
        self.faults.append(fault)
        self.turns.append(turn)
        standing = fault in (paths.NO_FAULT, paths.TRUNCATED)
        self.rows.append({"role": role, "text": text} if standing else None)

    def facts(self) -> list[int]:
        known = [t for t in self.turns if t != NULL_KEY]
        illegal = sum(not _follows(a, b) for a, b in zip(self.kinds, self.kinds[1:]))
        counted = (self.faults.count(f) for f in (paths.BLANK, paths.DUPLICATE, paths.TRUNCATED))
        ends = (known[0], known[-1]) if known else (None, None)
        return [len(self.kinds), *counted, illegal, len(set(known)), *ends]

    def edges(self) -> list[int]:
        return [self.kinds[0], self.kinds[-1], self.turns[0], self.turns[-1]]


def _follows(before: int, after: int) -> bool:
    return (before, after) in ((1, 2), (2, 3), (3, 2))


def _solved(held: list[_Stretch]) -> pa.RecordBatch:
    whole = [s for s in held if not s.open]
    sequences = [(np.array(s.kinds), np.array(s.faults)) for s in whole]
    found = paths.repairs(sequences, np.tile(paths.END_PRICES, (len(whole), 1)))
    out = []
    for s, (edits, *_) in zip(whole, found):
        letters, leave, cost = edits
        letters += paths.END_LETTERS[leave]
        cost += int(paths.END_PRICES[leave])
        repaired = _edited(letters, 0, s.kinds, s.rows)
        out.append([*_head(s), cost, letters.decode(), repaired, None, None, None])
    for s in held:
        if s.open:
            codes = bytes(s.kinds), bytes(s.faults)
            out.append([*_head(s), None, None, None, s.rows, *codes])
    return record(_STRETCH, *zip(*out))


def _head(s: _Stretch) -> list:
    turn, role, a, b = s.start
    return [s.conv, s.open, turn, role, s.piece, a, b, *s.facts(), *s.edges()]


def _edited(letters: bytes, state: int, kinds, rows: list[dict | None]) -> list[dict]:
    """The rows that the edits make, entered in `state`."""
    done, at = [], 0
    for letter in letters:
        if letter in b"IR":
            role = "assistant" if state == 2 else "user"
            done.append({"role": role, "text": rows[at]["text"] if letter == ord("R") else ""})
            state = 3 if state == 2 else 2
        elif letter == ord("K"):
            done.append(rows[at])
            state = kinds[at]
        at += letter != ord("I")
    return done


def _repaired_across_tasks(cut: DataFrame) -> DataFrame:
    """Open stretches: prices from the last to the first, edits, then states from the first to the last."""
    by_start = Window.partitionBy("conv").orderBy("turn", "role", "a", "b", "piece")
    numbered = stored(cut.withColumn("part", F.row_number().over(by_start) - 1))

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = paths.distances(_sequences(batch))
        cells = [m.ravel().tolist() for m in found]
        return pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("part"), pa.array(cells, pa.list_(pa.int64()))],
            names=["conv", "part", "cells"],
        )

    codes = numbered.select("conv", "part", "kinds", "faults")
    cells = arrow_map(codes, lambda: measured, "conv long, part int, cells array<long>", TOGETHER)
    backward = cells.repartition("conv").sortWithinPartitions("conv", F.desc("part"))
    exits = backward.mapInArrow(_exit_prices, "conv long, part int, exits array<long>")

    def edited(batch: pa.RecordBatch) -> pa.RecordBatch:
        exits = np.array(batch.column("exits").to_pylist(), np.int64).reshape(-1, 4)
        found = paths.repairs(_sequences(batch), exits)
        ways = [
            [way and {"letters": way[0].decode(), "leave": way[1], "cost": way[2]} for way in ways] for ways in found
        ]
        kept = [batch.column(c) for c in ("conv", "part", *(n for n, _ in _EDGES))]
        kind = pa.list_(pa.struct([("letters", pa.string()), ("leave", pa.int64()), ("cost", pa.int64())]))
        return pa.RecordBatch.from_arrays([*kept, pa.array(ways, kind)], names=["conv", "part", *(n for n, _ in _EDGES), "ways"])

    edges = ", ".join(f"{name} long" for name, _ in _EDGES)
    joined = numbered.select("conv", "part", "kinds", "faults", *(n for n, _ in _EDGES)).join(exits, ["conv", "part"])
    ways = arrow_map(
        joined,
        lambda: edited,
        f"conv long, part int, {edges}, ways array<struct<letters string, leave long, cost long>>",
        TOGETHER,
    )
    forward = ways.repartition("conv").sortWithinPartitions("conv", "part")
    chosen = forward.mapInArrow(
        _entered,
        "conv long, part int, state int, audit string, cost long, crossing long, same_turn long",
    )
    n_parts = F.max("part").over(Window.partitionBy("conv")) + 1
    chosen = stored(chosen.withColumn("n_parts", n_parts))
    both = numbered.drop("audit", "cost", "repaired").join(chosen, ["conv", "part"])
    both = both.withColumns({"illegal": F.expr("illegal + crossing"), "turns": F.expr("turns - same_turn")})

    def applied(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(c).to_pylist() for c in ("audit", "state", "kinds", "rows")]
        repaired = [_edited(audit.encode(), *rest) for audit, *rest in zip(*columns)]
        done = batch.select([c for c in batch.schema.names if c not in ("rows", "kinds", "faults")])
        return done.append_column("repaired", pa.array(repaired, _TEXTS))

    schema = StructType([*both.drop("rows", "kinds", "faults").schema, cut.schema["repaired"]])
    return arrow_map(both, lambda: applied, schema, TOGETHER)


def _sequences(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    codes = (batch.column(c).to_pylist() for c in ("kinds", "faults"))
    return [tuple(np.frombuffer(c, np.uint8).astype(np.int64) for c in pair) for pair in zip(*codes)]


def _exit_prices(batches) -> Iterator[pa.RecordBatch]:
    """Prices after each stretch; stretches come from the last of a conversation to its first."""
    prices, conv = paths.END_PRICES, None
    for batch in batches:
        names = batch.column("conv").to_pylist()
        exits = []
        for name, cells in zip(names, batch.column("cells").to_pylist()):
            if name != conv:
                prices, conv = paths.END_PRICES, name
            exits.append(prices.tolist())
            prices = np.minimum((np.array(cells).reshape(4, 4) + prices).min(axis=1), paths.FAR)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("part"), pa.array(exits, pa.list_(pa.int64()))],
            names=["conv", "part", "exits"],
        )


def _entered(batches) -> Iterator[pa.RecordBatch]:
    """The edits of each stretch, by the state that the one before leaves; and what counts across the border."""
    conv, state, last = None, 0, (None, None)
    schema = pa.schema(
        [("conv", pa.int64()), ("part", pa.int32()), ("state", pa.int32()), ("audit", pa.string())]
        + [(name, pa.int64()) for name in ("cost", "crossing", "same_turn")]
    )
    waiting = None
    out = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["conv"] != conv:
                if waiting:
                    out.append(_ended(waiting, state))
                waiting, conv, state, last = None, row["conv"], 0, (None, None)
            elif waiting:
                out.append(waiting)
            way = row["ways"][state]
            crossing = last[0] is not None and not _follows(last[0], row["first_kind"])
            same_turn = last[1] == row["first_turn"] and last[1] != NULL_KEY
            waiting = [conv, row["part"], state, way["letters"], way["cost"], int(crossing), int(same_turn)]
            state, last = way["leave"], (row["last_kind"], row["last_turn"])
        if out:
            yield record(schema, *zip(*out))
            out = []
    if waiting:
        yield record(schema, *zip(*[_ended(waiting, state)]))


def _ended(row: list, state: int) -> list:
    """A conversation's last stretch, with what is inserted after its rows."""
    return [*row[:3], row[3] + paths.END_LETTERS[state].decode(), row[4] + int(paths.END_PRICES[state]), *row[5:]]


def repaired_rows(found: DataFrame) -> DataFrame:
    """`conv`, `part`, `place`, `role`, `text`: the rows of repaired conversations."""
    return found.select("conv", "part", F.posexplode("repaired").alias("place", "row")).select(
        "conv", "part", "place", "row.role", "row.text"
    )


def summaries(found: DataFrame) -> DataFrame:
    """One row per conversation of `stretches`: faults, cost, edits and a hash of the repaired text.

    `repaired_sha256` is over `role:text`, one row a line. It has to be read in order, so
    the stretches of a long conversation meet in one task, one at a time.
    """
    parts = F.array_sort(F.collect_list(F.struct("part", "audit")))
    gaps = F.coalesce(F.max("max_turn") - F.min("min_turn") + 1 - F.sum("turns"), F.lit(0))
    sums = [F.sum(c).alias(c) for c in ("n_rows", "blank", "duplicate", "truncated", "illegal", "cost")]
    counted = found.drop("repaired").groupBy("conv").agg(gaps.alias("gaps"), *sums, F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
    text = _told("repaired")
    one = found.where("n_parts = 1").select("conv", F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))
    many = found.where("n_parts > 1 AND size(repaired) > 0").select("conv", "part", text.alias("text"))
    many = many.repartition("conv").sortWithinPartitions("conv", "part")
    hashes = one.union(many.mapInArrow(_hashed, "conv long, repaired_sha256 string"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return counted.join(hashes, "conv", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty))


def _told(rows: str) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")


def _hashed(batches) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            yield from zip(batch.column("conv").to_pylist(), batch.column("text").to_pylist())

    schema = pa.schema([("conv", pa.int64()), ("repaired_sha256", pa.string())])
    for conv, parts in groupby(rows(), lambda row: row[0]):
        digest, between = hashlib.sha256(), b""
        for _, text in parts:
            digest.update(between + text.encode())
            between = b"\n"
        yield record(schema, [conv], [digest.hexdigest()])
