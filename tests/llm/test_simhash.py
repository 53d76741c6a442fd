import itertools
import re

import numpy as np
import pytest
import xxhash

from accesslens.llm import simhash
from accesslens.llm.components import components
from accesslens.llm.queries import QUERIES
from accesslens.llm.shared import table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, points, most):
    parent = list(range(len(points)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(points)), 2):
        if (points[a] ^ points[b]).bit_count() <= most:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    roots = [root(k) for k in range(len(points))]
    low = {r: min((keys[k] for k in range(len(keys)) if roots[k] == r and keys[k] is not None), default=None) for r in roots}
    return [low[r] for r in roots]


def test_query_against_brute_force(spark):
    docs = table(spark, SF, "documents").collect()
    points = [plain_fingerprint(r.text) for r in docs]
    lows = plain_components([r.doc_id for r in docs], points, 3)
    expected = {(r.doc_id, f"{p:016x}", low) for r, p, low in zip(docs, points, lows)}
    assert {tuple(r) for r in QUERIES["op1_simhash"](spark, SF).collect()} == expected


@pytest.mark.parametrize("cells", [(4096, 32768, 1 << 16), (16, 40, 64)])
def test_every_link_of_dense_and_spread_points(spark, monkeypatch, cells):
    """Balls around a few centres, chains of 3-bit steps, and points far from all."""
    for name, size in zip(("CELL_HOMES", "CELL_QUERIES", "LEAF_PAIRS"), cells):
        monkeypatch.setattr(simhash, name, size)
    random = np.random.default_rng(3)
    points = {0, (1 << 64) - 1}
    for centre in random.integers(0, 1 << 63, 4).tolist():
        for _ in range(60):
            points.add(centre ^ sum(1 << int(b) for b in random.choice(64, random.integers(0, 3), replace=False)))
        step = centre
        for _ in range(10):
            step ^= sum(1 << int(b) for b in random.choice(64, 3, replace=False))
            points.add(step)
    points |= set(random.integers(0, 1 << 63, 200).tolist())
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    roots = {r.node: r.root for r in components(simhash.linked(frame, 3)).collect()}
    expected = plain_components(signed, [p & (1 << 64) - 1 for p in signed], 3)
    assert [roots.get(p, p) for p in signed] == expected


def test_odd_rows(spark, odd_rows):
    rows = odd_rows()
    found = simhash.near_duplicates(rows).collect()
    assert len(found) == rows.count()
    assert sum(r.doc_id == 1 and r.component_id == 1 for r in found) == 3
    # four texts without words share the fingerprint zero and the smallest key
    empty = [r for r in found if r.fingerprint == "0" * 16]
    assert sorted((r.doc_id or 0, r.component_id) for r in empty) == [(0, 2), (2, 2), (3, 2), (5, 2)]
    kept = simhash.one_of_each(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect())[:2] == [
        (0, "a text without a key"), (1, "other words under this key"),
    ]
    assert kept.count() == len({r.component_key for r in found})
    nothing = rows.where("false")
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.one_of_each(nothing).count() == 0
