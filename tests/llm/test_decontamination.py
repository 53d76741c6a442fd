import random

from accesslens.llm import decontamination as d
from accesslens.llm.queries import QUERIES
from accesslens.llm.shared import table
from conftest import tuples

SF = "/root/testdata/sf0.001"


def plain_distance(pattern, text):
    """Least word edits from the pattern to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        before, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j - 1] + (a != b), before[j] + 1, row[j - 1] + 1))
    return min(row)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        rng.choice([lambda: words.pop(k), lambda: words.insert(k, "new"), lambda: words.__setitem__(k, "else")])()
    return words


def test_distance_against_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        pattern = rng.choices("abcd", k=rng.randint(1, 80))
        text = rng.choices("abcd", k=rng.randint(0, 40))
        if rng.random() < 0.5:
            text[5:5] = edited(rng, pattern, rng.randint(0, len(pattern) // 4))
        distance, i, j = d.Pattern(pattern).locate(text)
        assert distance == plain_distance(pattern, text)
        assert plain_distance(pattern, text[i:j]) == distance and 0 <= i <= j <= len(text)


def test_matches_within_the_budget_are_all_found():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, rng.choices(vocabulary, k=rng.randint(1, 30))) for k in range(40)]
    matcher = d.Matcher(items, 0.2)
    for _ in range(60):
        text = rng.choices(vocabulary, k=rng.randint(0, 200))
        _, words = rng.choice(items)
        text[7:7] = edited(rng, words, rng.randint(0, len(words) // 5))
        near = {k: plain_distance(w, text) for k, w in items}
        expected = {(k, n) for k, n in near.items() if n <= int(0.2 * len(dict(items)[k]))}
        assert {(hit[0], hit[1]) for hit in matcher.found(" ".join(text))} == expected


def test_query_against_brute_force(spark):
    docs, items = table(spark, SF, "documents").collect(), table(spark, SF, "benchmark").collect()
    expected = set()
    for item in items:
        words = d.words_of(item.text)
        for doc in docs:
            distance = plain_distance(words, d.words_of(doc.text)) if len(doc.text) < 2000 else None
            if distance is not None and distance <= len(words) // 5:
                expected.add((doc.doc_id, item.item_id, distance))
    short = {r.doc_id for r in docs if len(r.text) < 2000}
    found = QUERIES["op10_decontamination"](spark, SF).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found if r.doc_id in short} == expected


def test_odd_rows(spark, odd_rows):
    rows = odd_rows()
    items = [(7, "Same words, in this TEXT!"), (7, "same words in this text"), (None, "under this key"), (8, None), (9, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = d.contaminations(rows, benchmark).collect()
    assert sorted((r.doc_id, r.item_id or 0, r.distance) for r in found) == [(1, 0, 0)] + [(1, 7, 0)] * 4
    kept = d.without_contaminated(rows, benchmark)
    assert kept.columns == rows.columns and kept.count() == rows.count() - 3
    # several blocks give what one gives
    split = d.contaminations(rows, benchmark, block_words=1)
    assert sorted(tuples(split), key=str) == sorted(map(tuple, found), key=str)
    assert d.without_contaminated(rows, benchmark, block_words=1).count() == kept.count()
    empty = benchmark.where("false")
    assert d.contaminations(rows, empty).count() == 0
    assert d.without_contaminated(rows, empty).count() == rows.count()
    assert d.contaminations(rows.where("false"), benchmark).count() == 0
