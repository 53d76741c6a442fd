import random

import numpy as np
import pytest

from accesslens.llm import toxicity
from accesslens.llm.queries import QUERIES, held_out
from accesslens.llm.shared import table

BAD = ["idiot", "worthless", "pathetic"]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    sound = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "en", "es"]
    texts, labels = [], []
    for k in range(400):
        words = ["".join(rng.choices(sound, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 80))]
        if k % 2:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        texts.append(" ".join(words))
        labels.append(k % 2)
    return toxicity.train(texts, labels, epochs=20)


def test_one_insult_in_a_long_text(model):
    clean = " ".join(["there", "then", "other", "hand", "end"] * 1000)
    scorer = toxicity.Scorer(model)
    assert scorer.scores([clean, clean + " Idiot! " + clean, "idiot", ""]) == pytest.approx([0, 1, 1, 0], abs=0.3)


def test_misspellings_share_ngrams(model):
    scores = toxicity.Scorer(model).scores(["idiots", "worthles", "pathetics", "theronan"])
    assert min(scores[:3]) > 0.5 > scores[3]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op3_toxicity"](spark, sf)
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    held = rows.where("held_out").join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)
    clean = [r.predicted for r in held if r.toxic == 0]
    toxic = [r.predicted for r in held if r.toxic == 1]
    # an eighth of the toxic rows have no insult left, and this table is small
    assert sum(clean) <= 0.05 * len(clean) and sum(toxic) >= 0.5 * len(toxic)
    assert rows.count() == table(spark, sf, "documents").count()


def test_held_out_rows_do_not_change_the_model(spark):
    docs = spark.createDataFrame([(k, f"words {k}") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int")
    texts, _ = toxicity.labelled_sample(docs, labels.where(~held_out()))
    held = {r.text for r in docs.where(held_out()).collect()}
    assert held and not held & set(texts)


def test_odd_rows(spark, odd_rows, model):
    rows = odd_rows()
    scores = toxicity.toxicity_scores(rows, model).collect()
    assert len(scores) == rows.count() and all(0 <= r.score <= 1 for r in scores)
    kept = toxicity.without_toxic(rows, model)
    assert kept.columns == rows.columns and kept.count() == sum(r.score < 0.5 for r in scores)
    toxic = spark.createDataFrame([(1, "you idiot", 1), (2, None, 2)], "doc_id long, text string, id int")
    assert [r.doc_id for r in toxicity.without_toxic(toxic, model).collect()] == [2]
    assert toxicity.toxicity_scores(rows.where("false"), model).count() == 0
    # no labels, or of one kind: a constant score under one half or over it
    none = toxicity.train([], [])
    assert toxicity.Scorer(none).scores(["x", ""])[0] < 0.5
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(rows, labels) == ([], [])


def test_gradient_against_finite_differences():
    """Every parameter of a small model, moved a little either way; documents in several groups."""
    rng = random.Random(2)
    words = ["idiot", "hand", "the", "others", "end", "a"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(230)] + ["", " . "]
    labels = np.array([k % 2 for k in range(len(texts))], float)
    bag = toxicity._Bag.of(texts, labels, 16, 2)
    assert len(bag.groups) == 3 and len(bag.y) == 230
    numbers = np.random.default_rng(1)
    # doubles, so that differences are exact enough
    parameters = [numbers.normal(size=shape) for shape in ((16, 3), (3, 2), (2,))]
    found = bag.gradients(*parameters)
    for p, g in zip(parameters, found):
        for at in np.ndindex(p.shape):
            kept, losses = p[at], []
            for step in (1e-3, -1e-3):
                p[at] = kept + step
                losses.append(bag.loss(*parameters))
            p[at] = kept
            assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=2e-5)


def test_scores_against_plain_loops(model):
    """Windows, words and n-grams one by one."""
    texts = ["You idiot, worthless.", "there then the other hand", "x", "", "Pathetics! " * 5]
    for text, score in zip(texts, toxicity.Scorer(model).scores(texts)):
        words = [w.strip(".,!").lower() for w in text.split()]
        values = []
        for word in words:
            ids, _ = toxicity.ngram_ids([word], len(model.weights))
            values.append(sum(model.weights[k] for k in ids) / len(ids))
        windows = [values[k : k + 2] for k in range(0, len(values), 2)]
        if len(values) > 1 and len(values) % 2:
            windows[-1] = values[-2:]
        z = max((sum(w) / len(w) for w in windows), default=0.0) + model.bias
        assert score == pytest.approx(1 / (1 + np.exp(-(model.slope * z + model.shift))), abs=1e-6)
