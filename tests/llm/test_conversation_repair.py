import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from accesslens.llm import auction_paths as paths
from accesslens.llm import conversation_repair as repair
from accesslens.llm.queries import QUERIES, damaged
from accesslens.llm.shared import table

BLANKS = " \t\n\v\f\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
KEEPS = {"": "su", "s": "u", "u": "a", "a": "u"}


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        told = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{told[0]}:{told[1]}".encode()) % 20
        role, text = told[2:]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, letters, repaired rows): all states and edits, row by row from the end."""
    end = {"": (0, "", []), "a": (0, "", []), "u": (5, "I", ["assistant:"]), "s": (10, "II", ["user:", "assistant:"])}
    full = {"u": "user", "a": "assistant"}
    after = end
    for role, text, fault in reversed(rows):
        here = {}
        for state in NEXT:
            cost, letters, done = after[state]
            ways = [(cost + 2, "D" + letters, done)]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] and role[:1] in KEEPS[state]:
                    cost, letters, done = after[role[0]]
                    ways.append((cost + extra, "K" + letters, [f"{role}:{text}", *done]))
                to = NEXT[state]
                cost, letters, done = after[to]
                ways.append((cost + extra + 1, "R" + letters, [f"{full[to]}:{text}", *done]))
            here[state] = min(ways, key=lambda w: w[:2])
        for _ in range(3):
            for state, to in NEXT.items():
                cost, letters, done = here[to]
                here[state] = min(here[state], (cost + 5, "I" + letters, [full[to] + ":", *done]), key=lambda w: w[:2])
        after = here
    return after[""]


def by_hand(rows):
    """The summary of one conversation's rows, in order."""
    faulty, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(BLANKS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faulty.append((role, text, fault))
    faults = [f for *_, f in faulty]
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for r, *_ in faulty]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, letters, done = cheapest(faulty)
    digest = hashlib.sha256("\n".join(done).encode()).hexdigest()
    return (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, letters, digest)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "conversations").orderBy("conv_id", "turn").collect()]
    convs = {}
    for conv, *row in damaged_by_hand(rows):
        convs.setdefault(conv, []).append(row)
    found = QUERIES["op12_conversations"](spark, sf)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == sorted((c, *by_hand(convs.get(c, []))) for c in {r[0] for r in rows})


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in (0, 1, 2, None)] + [(None, None, None, None)] * 2
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(repr, map(tuple, damaged(frame).collect())))
    assert got == sorted(map(repr, damaged_by_hand(rows)))


def made(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["system", "tool", "", "User", "a", None]) if rng.random() < 0.2 else ("user", "assistant")[turn % 2]
            text = rng.choice([f"Text {conv} {turn}.", f"cut {turn}", " \n", "", None, "Same text!", "Same text!"])
            rows.append((conv if rng.random() > 0.02 else None, turn if rng.random() > 0.05 else None, role, text))
    return rows


@pytest.mark.parametrize("stretch", [4096, 5, 1])
def test_any_cutting_gives_the_same(spark, stretch):
    rows = made(stretch, 25, 40) + [(500, 3, "user", "The same row.")] * 23 + [(501, None, "user", "No turn.")] * 2
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = repair.stretches(frame.repartition(3), stretch_rows=stretch)
    bits = {}
    ready = repair._prepared(frame, "conv_id", "turn", "role", "text")
    for r in ready.collect():
        bits[r.role, r.text] = (r.a, r.b)
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    wanted = []
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (-1 if r[0] is None else r[0], r[1].encode(), *bits[r[1:]]))
        wanted.append((-(1 << 63) if conv is None else conv, *by_hand(mine)))
    columns = ["conv", *COLUMNS[1:]]
    assert sorted(map(tuple, repair.summaries(found).select(columns).collect())) == sorted(wanted)
    sizes = found.selectExpr("sum(n_rows)", "sum(size(repaired))", "max(n_parts)").first()
    assert sizes[0] == len(rows) and (sizes[2] > 1) == (stretch < 40)
    assert repair.repaired_rows(found).count() == sizes[1]


def test_prices_are_distances():
    """Against shortest paths of all lattices by relaxing every arc."""
    rng = np.random.default_rng(5)
    kinds, faults = rng.integers(0, 4, (40, paths.SEGMENT)), rng.integers(0, 4, (40, paths.SEGMENT))
    sizes = rng.integers(1, paths.SEGMENT + 1, 40)
    exits = rng.integers(0, 9, (40, 4))
    solved = paths.Lattices(kinds, faults, sizes, exits)
    far = np.full_like(solved.price, paths.FAR)
    far[:, -1] = 0
    each = np.arange(40)[:, None, None]
    for _ in range(4 * paths.SEGMENT + 8):
        far[:, :-1] = np.minimum(far[:, :-1], (solved.cost + far[each, solved.head]).min(axis=2))
    assert (solved.entry_prices == far[:, :4] + solved.base[:, None]).all()
    assert (solved.price[:, :-1, None] <= solved.cost + solved.price[each, solved.head]).all()


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, conv string, part int, a string"
    rows = [(None, None, None, None, "x", 1, "y"), (1, None, "system", "Only a system row.", "x", 1, "y")]
    rows += [(2, 0, "user", "word " * 200_000 + ".", None, None, None), (2, 1, "assistant", "é.", None, None, None)]
    frame = spark.createDataFrame(rows, schema)
    found = {r.conv: r for r in repair.summaries(repair.stretches(frame)).collect()}
    assert {c: (r.cost, r.audit) for c, r in found.items()} == {-(1 << 63): (2, "D"), 1: (2, "D"), 2: (0, "KK")}
    assert repair.summaries(repair.stretches(frame.where("false"))).count() == 0
