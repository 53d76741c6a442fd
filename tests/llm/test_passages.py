import random
import re
from collections import defaultdict

import numpy as np
import pytest

from accesslens.llm import passages
from accesslens.llm.queries import QUERIES
from accesslens.llm.shared import table


def plain_windows(hashes, shortest):
    out = []
    for c, h in enumerate(hashes):
        a = c
        while a and hashes[a - 1] > h:
            a -= 1
        b = c
        while b + 1 < len(hashes) and hashes[b + 1] >= h:
            b += 1
        if b - a + 1 >= shortest:
            out.append((c, a, b))
    return out


def test_compact_windows_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sizes = rng.integers(0, 60, 3)
        # few values, so ties are many
        hashes = rng.integers(0, 9, sizes.sum()).astype(np.uint64) << np.uint64(60)
        shortest = int(rng.integers(1, 12))
        expected = []
        for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
            own = hashes[end - size : end].tolist()
            expected += [tuple(x + end - size for x in w) for w in plain_windows(own, shortest)]
        found = passages.compact_windows(hashes, np.cumsum(sizes), shortest)
        assert list(zip(*(f.tolist() for f in found))) == expected


def test_word_hashes():
    texts = ["The the, THE_x", "", "é É 漢字 a1", "\n"]
    words = passages.word_hashes(texts)
    assert [len(w) for w in words] == [4, 0, 4, 0]
    assert len({*words[0][:3].tolist()}) == 1 and words[2][0] == words[2][1] != words[2][2]


def test_every_repeated_passage(spark):
    sf = "/root/testdata/sf0.001"
    runs = defaultdict(set)
    for row in table(spark, sf, "documents").collect():
        words = re.findall(r"[^\W_]+", row.text.lower())
        for k in range(len(words) - 49):
            runs[tuple(words[k : k + 50])].add(row.doc_id)
    found = {r.doc_id: r for r in QUERIES["op7_passages"](spark, sf).collect()}
    for docs in runs.values():
        if len(docs) > 1:
            assert len({found[d].class_id for d in docs}) == 1
            assert all(found[d].n_passages > 0 for d in docs)


@pytest.mark.parametrize("cell", [1024, 3])
def test_planted_passages(spark, monkeypatch, cell):
    monkeypatch.setattr(passages, "CELL", cell)
    rng = random.Random(6)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    shared, other = words(70), words(70)
    near = shared[:35] + ["changed"] + shared[36:]
    docs = [(k, words(30 + k) + shared + words(40)) for k in range(20)]
    docs += [(k, words(9) + near + words(80 - k)) for k in range(20, 25)]
    docs += [(k, words(20) + other + words(k)) for k in range(30, 33)]
    docs += [(k, words(200)) for k in range(40, 50)] + [(k, words(60) + shared[:20] + words(60)) for k in range(50, 55)]
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in passages.repeated_passages(frame).collect()}
    assert {found[k].class_id for k in range(25)} == {0}
    assert {found[k].class_id for k in range(30, 33)} == {30}
    assert all(found[k].class_id == k and not found[k].passages for k in [*range(40, 50), *range(50, 55)])
    for k in range(20):
        (span,) = found[k].passages
        assert span.first <= 30 + k + 20 and span.last >= 30 + k + 49


def test_runs_whose_minima_lie_last_and_near_runs(spark):
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    stream = words(40_000)
    tokens = passages.shingles(passages.word_hashes([" ".join(stream)])[0])
    least = []
    for k in range(3):
        seed = np.uint64(passages.xxhash.xxh3_64_intdigest(f"function {k}"))
        values = passages._mixed(tokens ^ seed)
        least.append(np.lib.stride_tricks.sliding_window_view(values, 46).argmin(1))
    last = np.flatnonzero((np.stack(least) >= 43).all(0))
    runs = [(r, r) for r in (stream[k : k + 50] for k in last.tolist())]
    assert runs
    for k in range(400):
        run, c = words(50), 5 + k % 40
        runs.append((run, run[:c] + ["changed"] + run[c + 1 :]))
    rows = [(2 * k + side, " ".join(words(2) + run + words(2))) for k, pair in enumerate(runs) for side, run in enumerate(pair)]
    found = {r.doc_id: r.class_id for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[2 * k] == found[2 * k + 1] for k in range(len(runs)))


def plain_spans(docs):
    """Stretches of words whose every 50 are in another document too."""
    runs = defaultdict(set)
    for key, words in docs.items():
        for k in range(len(words) - 49):
            runs[tuple(words[k : k + 50])].add(key)
    out = {}
    for key, words in docs.items():
        spans = out[key] = []
        for k in range(len(words) - 49):
            if len(runs[tuple(words[k : k + 50])]) > 1:
                if spans and k <= spans[-1][1] + 1:
                    spans[-1] = (spans[-1][0], k + 49)
                else:
                    spans.append((k, k + 49))
    return out


@pytest.mark.parametrize("cell", [1024, 3])
def test_exact_ends(spark, monkeypatch, cell):
    monkeypatch.setattr(passages, "CELL", cell)
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    docs = {}
    for k in range(30):
        run = words(90)
        # one document shares 50 words with three, and those share 70 to 90
        parts = [run[20:70], run[:80], run, run[10:]]
        docs |= {10 * k + j: words(70 + k) + part + words(90 - k) for j, part in enumerate(parts)}
        docs[10 * k + 4] = words(60) + run[:55] + words(9) + run[30:85] + words(60)
    long = words(300)
    docs |= {1000 + k: words(k) + long[5 * k :] + words(30) for k in range(20)}
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string").repartition(4)
    found = {r.doc_id: [(s.first, s.last) for s in r.passages] for r in passages.repeated_passages(frame).collect()}
    assert found == plain_spans(docs)


def test_odd_rows(spark, odd_rows):
    rows = odd_rows()
    found = passages.repeated_passages(rows).collect()
    assert len(found) == rows.count()
    assert all(r.n_passages == 0 for r in found)
    long = rows.where("doc_id = 4")
    both = passages.repeated_passages(long.union(long.withColumn("doc_id", long["doc_id"] + 5))).collect()
    assert [(r.class_id, r.n_passages, r.passages[0].first, r.passages[0].last) for r in both] == [(4, 1, 0, 19_999)] * 2
    assert passages.repeated_passages(rows.where("false")).count() == 0


def test_widening_looks_only_at_the_same_place(monkeypatch):
    rng = np.random.default_rng(3)
    # near copies of words that come again and again, each with changes of its own
    text = np.tile(rng.integers(1, 1 << 15, 12) * 2 + 1, 9)[:103].astype(np.uint16)
    contexts = np.tile(text, (60, 1))
    for row in contexts:
        row[rng.choice(np.r_[:45, 58:103], 3, replace=False)] = rng.integers(1, 1 << 15, 3) * 2 + 1
    names = np.arange(60)
    passes = []
    plain = passages._Shared.partners
    monkeypatch.setattr(passages._Shared, "partners", lambda *args: (passes.append(1), plain(*args))[1])
    found = passages._forests(
        np.zeros(60, np.int64), np.ones(60, bool), names, np.full(60, 49), contexts, 50, 0.8
    ).to_pandas()
    # each row's widest stretch, from all pairs
    h, q = (k.ravel() for k in np.meshgrid(names, names, indexing="ij"))
    h, q = h[h < q], q[h < q]
    ones = contexts.T.copy()
    near, begin, finish = passages._near(ones[:, h], ones[:, q], 50, 0.8)
    widest = {}
    for rows, first, last in ((h[near], begin[0], finish[0]), (q[near], begin[1], finish[1])):
        for row, a, b in zip(rows.tolist(), first.tolist(), last.tolist()):
            low, high = widest.get(row, (99, -1))
            widest[row] = min(low, a), max(high, b + 4)
    assert len(widest) > 20
    assert {r.a: (r.first, r.last) for r in found.itertuples()} == widest
    assert len(passes) < 1000, len(passes)


def test_runs_of_words_have_few_windows(spark):
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    docs = {}
    for k, n in enumerate([40, 49, 50, 51, 70, 95, 96, 140, 300, 301, 900]):
        docs[k] = words(k) + ["the"] * n + words(9 + k)
        docs[100 + k] = words(60) + ["a", "b"] * n + words(60)
    tail = words(30)
    # a run and what follows it repeat, so do those parted by another word
    docs |= {200 + k: words(60) + ["z"] * (30 + 7 * k) + tail + words(k) for k in range(5)}
    docs |= {300 + k: words(60) + ["y"] * 25 + ["x"] + ["y"] * 25 + tail[: 5 * k] + words(60) for k in range(4)}
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.class_id, [(s.first, s.last) for s in r.passages]) for r in passages.repeated_passages(frame).collect()}
    for key, spans in plain_spans(docs).items():
        # near passages may reach further
        assert all(any(a <= first and last <= b for a, b in found[key][1]) for first, last in spans), key
        assert not (2 <= key <= 10 or 100 <= key <= 110) or found[key][1] == spans, key
    assert {found[k][0] for k in range(1, 11)} == {1} and {found[k][0] for k in range(100, 111)} == {100}
    rows = passages.windows(frame.select("text"), 50, 6).count()
    assert rows < 12 * sum(len(set(w)) for w in docs.values()) + 400 * len(docs), rows


@pytest.mark.parametrize("cell", [1024, 100])
def test_a_common_line_costs_no_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(passages, "CELL", cell)
    rng = np.random.default_rng(4)
    contexts = rng.integers(1, 1 << 15, (600, 103)).astype(np.uint16) * 2 + 1
    contexts[:, 45:58] = contexts[0, 45:58]
    # three of them have a passage in common
    contexts[100:400:100, 30:90] = contexts[100, 30:90]
    pairs = []
    plain = passages._near
    monkeypatch.setattr(passages, "_near", lambda ones, *args: (pairs.append(ones.shape[1]), plain(ones, *args))[1])
    found = passages._forests(
        np.zeros(600, np.int64), np.ones(600, bool), np.arange(600), np.full(600, 49), contexts, 50, 0.8
    ).to_pandas()
    assert set(found.a) == {100, 200, 300} and set(zip(found["first"], found["last"])) == {(30, 89)}
    assert sum(pairs) < 10, pairs
    # and of a key of many rows only they are dealt to cells
    words = np.array(["".join(w) for w in rng.choice(list("abcdefghij"), (1 << 12, 6))])
    text = words[rng.integers(0, len(words), (300, 120))]
    text[:, 50:63] = text[0, 50:63]
    text[5:20:5, 40:100] = text[5, 40:100]
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(text.tolist())], "doc_id long, text string")
    docs = passages.repeated_passages(frame).collect()
    assert {r.doc_id: [(s.first, s.last) for s in r.passages] for r in docs if r.passages} == {k: [(40, 99)] for k in (5, 10, 15)}


def test_rows_that_share_parts_with_many_are_not_compared_with_all(monkeypatch):
    rng = np.random.default_rng(7)
    words = lambda *shape: rng.integers(1, 1 << 15, shape).astype(np.uint16) * 2 + 1
    contexts, left, right = words(600, 103), words(20, 22), words(20, 22)
    contexts[:, 45:58] = contexts[0, 45:58]
    # one side says as much as 31 shingles, both are a passage
    one, other = rng.integers(0, 20, (2, 600))
    contexts[:, 23:45], contexts[:, 58:80] = left[one], right[other]
    pairs = []
    plain = passages._near
    monkeypatch.setattr(passages, "_near", lambda ones, *args: (pairs.append(ones.shape[1]), plain(ones, *args))[1])
    found = passages._forests(
        np.zeros(600, np.int64), np.ones(600, bool), np.arange(600), np.full(600, 49), contexts, 50, 0.8
    ).to_pandas()
    sides = one * 20 + other
    assert set(found.a) == set(np.flatnonzero(np.bincount(sides)[sides] > 1).tolist())
    assert (sides[found.a] == sides[found.b]).all()
    assert set(zip(found["first"], found["last"])) == {(23, 79)}
    assert sum(pairs) < 6000, sum(pairs)


def test_stretches_do_not_depend_on_the_order_of_rows():
    rng = np.random.default_rng(11)
    contexts = rng.integers(1, 1 << 15, (12, 103)).astype(np.uint16) * 2 + 1
    contexts[:, 49:54] = contexts[0, 49:54]
    # the first row shares what comes before its token with some rows, what comes after it with others
    contexts[1:4, :45] = contexts[0, :45]
    contexts[4:8, 56:] = contexts[0, 56:]
    contexts[1:4, 40:45] = contexts[0, 40:45]
    found = set()
    for _ in range(30):
        order = rng.permutation(12)
        links = passages._forests(
            np.zeros(12, np.int64), np.ones(12, bool), order, np.full(12, 49), contexts[order], 50, 0.8
        ).to_pandas()
        found.add(tuple(sorted(zip(links.a, links["first"], links["last"]))))
    assert len(found) == 1 and (0, 0, 102) in found.pop()


def test_shared_windows_against_all_windows(spark):
    rng = random.Random(21)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    run, line = words(130), words(20)
    docs = [words(30) + run + words(5 * k) for k in range(6)] + [words(90) + line + words(90) for _ in range(4)]
    docs += [line * 9, line * 9 + words(60), words(60) + ["the"] * 200, words(70) + ["the"] * 150, words(20), []]
    docs += docs[3:13] + [docs[0]] * 7
    rows = [(k, f"row {k}", " ".join(w)) for k, w in enumerate(docs)]
    frame = spark.createDataFrame(rows, "id long, row_key string, text string").repartition(5)
    every = {tuple(r) for r in passages.windows(frame.select("text"), 50, 6).collect()}
    keys, classes = defaultdict(set), defaultdict(list)
    for key, around, text, at, first, last, again in every:
        keys[key].add(text)
        classes[key, around].append((text, at, first, last, again))
    spans, wanted, same = set(), defaultdict(set), defaultdict(set)
    for (key, _), windows in classes.items():
        if len(keys[key]) > 1:
            texts = {w[0] for w in windows}
            if len(texts) > 1:
                spans |= {(w[0], w[2], w[3]) for w in windows}
                same[min(texts)] |= texts
            wanted[key] |= {min(windows)[:2]} | ({w[:2] for w in windows if w[4]} if len(texts) == 1 else set())
    wanted = {(key, *w) for key, some in wanted.items() if len({w[0] for w in some}) > 1 for w in some}
    told, links, found = passages.shared_windows(frame, 50, 6)
    assert sorted((r.doc_id, r.row_key, r.n_words) for r in told.collect()) == [
        (k, f"row {k}", len(w)) for k, w in enumerate(docs)
    ]
    assert {(r.key, r.text_id, r.at) for r in found.collect()} == wanted
    links = links.collect()
    assert {(r.a, r.first, r.last) for r in links} == spans

    def joined(pairs):
        root = {}
        up = lambda x: x if root.setdefault(x, x) == x else up(root[x])
        for a, b in pairs:
            root[max(up(a), up(b))] = min(up(a), up(b))
        return {x: up(x) for x in root}

    assert joined((r.a, r.b) for r in links) == joined((a, b) for b, some in same.items() for a in some)


@pytest.mark.parametrize("cell", [1024, 3])
def test_keys_of_many_rows(spark, monkeypatch, cell):
    rng = random.Random(31)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    docs, line = {}, words(9)
    for k in range(25):
        run = words(80)
        near = run[:40] + ["changed"] + run[41:]
        docs |= {4 * k + j: words(60) + part[:45] + line + part[45:] + words(60) for j, part in enumerate((run, near, run[30:], words(70)))}
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string").repartition(4)
    expected = {tuple(map(str, r)) for r in passages.repeated_passages(frame).collect()}
    monkeypatch.setattr(passages, "MANY", 0)
    monkeypatch.setattr(passages, "CELL", cell)
    assert {tuple(map(str, r)) for r in passages.repeated_passages(frame).collect()} == expected
    assert sum(n != "0" for _, _, _, n, _ in expected) >= 50
