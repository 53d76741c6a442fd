import hashlib
import re

from accesslens.llm import secret_scan
from accesslens.llm.queries import QUERIES
from accesslens.llm.shared import table

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(found)]


def test_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in QUERIES["op2_secrets"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert rows.keys() == texts.keys()
    for key, text in texts.items():
        spans = plain_spans(text)
        named = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        row = rows[key]
        assert row.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[0] == k for s in spans) for k in secret_scan.KINDS[:3]]
        assert set(named.split(",")) <= {"", *row.spans.split(",")}
        assert row.n_live + row.n_copied == len(spans)


KEY = "Zx9wQ1rT5yU7iO3pA2sD"


def test_ownership_decides(spark):
    other = KEY[::-1]
    rows = [
        (1, "a", f"key {KEY} here"),
        (2, "a", f"again {KEY}"),
        (3, "b", f"example {other}"),
        (4, "c", f"example {other} secret: {other}"),
        (5, "c", 'Api_Key="abcdef" token=abc PASSWORD : hunter22 ſecret=nothing1'),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = {r.doc_id: r for r in secret_scan.secrets(docs).collect()}
    assert [(s.kind, s.start, s.end) for s in found[1].owned] == [("owned", 4, 24)]
    assert len(found[2].owned) == 1  # one owner, two repositories
    assert found[3].owned == found[4].owned == []
    assert (found[4].n_live, found[4].n_copied) == (0, 1)
    assert [(s.kind, s.start) for s in found[5].base] == [("assign", 0), ("assign", 27)]
    assert (found[5].n_live, found[5].n_copied) == (2, 0)


def test_copies_inside_one_source(spark):
    kept = KEY[::-1]
    rows = [(k, "a", f"example {KEY} token: {KEY[:12]}") for k in range(50)]
    rows += [(100 + k, "a", f"mine {kept} token: {kept[:12]}") for k in range(secret_scan.LIVE_REPOSITORIES)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for row in secret_scan.secrets(docs).collect():
        copied = row.doc_id < 100
        assert (len(row.owned), row.n_live, row.n_copied) == ((0, 0, 1) if copied else (1, 1, 0))
        assert set(row.n_repositories.values()) == {50 if copied else secret_scan.LIVE_REPOSITORIES}


def test_odd_rows(spark, odd_rows):
    rows = odd_rows()
    found = secret_scan.secrets(rows)
    assert found.count() == rows.count() and found.where("size(base) + size(owned) > 0").count() == 0
    assert secret_scan.secrets(rows.where("false")).count() == 0
