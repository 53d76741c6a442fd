import hashlib

import sentencepiece

import corpus_pipeline
from accesslens.llm import decontamination, pseudonyms, simhash, toxicity
from accesslens.llm.queries import PIECE_MODEL, PSEUDONYM_KEY, toxicity_model
from accesslens.llm.shared import table
from llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "sentencepiece"]


def test_run_against_plain_loops(spark):
    docs = table(spark, SF, "documents")
    rows = docs.orderBy("doc_id").collect()
    model = toxicity_model(docs, table(spark, SF, "labels"))
    scores = toxicity.Scorer(model).scores([r.text for r in rows])
    rows = [r for r, s in zip(rows, scores) if s < 0.5]
    lows = plain_components([r.doc_id for r in rows], [plain_fingerprint(r.text) for r in rows], 3)
    rows = [r for r, low in zip(rows, lows) if r.doc_id == low]
    items = [(r.item_id, decontamination.words_of(r.text)) for r in table(spark, SF, "benchmark").collect()]
    matcher = decontamination.Matcher(items, decontamination.EDIT_RATE)
    rows = [r for r in rows if not list(matcher.found(r.text))]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    permuter = pseudonyms.Permuter(pseudonyms.Feistel(PSEUDONYM_KEY))
    expected = set()
    for row in rows:
        ids = library.encode(pseudonyms.pseudonymised(row.text, permuter)[0])
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        expected.add((row.doc_id, len(ids), *digests))
    found = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_stages_take_odd_rows(spark, odd_rows):
    columns = table(spark, SF, "documents").columns
    rows = odd_rows()
    rows = rows.withColumns({"lang": rows["source"], "n_chars": rows["doc_id"]}).select(columns)
    for docs in (rows, rows.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    assert simhash.one_of_each(rows).count() < rows.count()
