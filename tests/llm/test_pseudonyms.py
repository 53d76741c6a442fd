import pytest

from accesslens.llm import pseudonyms as p
from accesslens.llm.queries import QUERIES
from accesslens.llm.shared import table

HIDE, SHOW = p.Permuter(p.Feistel(b"key")), p.Permuter(p.Feistel(b"key"), inverse=True)


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_permutation_of_every_range(n):
    feistel = p.Feistel(b"key")
    images = [feistel.permuted(k, n, "t") for k in range(n)]
    assert sorted(images) == list(range(n))
    assert [feistel.permuted(k, n, "t", inverse=True) for k in images] == list(range(n))
    if n == 1000:
        assert images != [p.Feistel(b"other").permuted(k, n, "t") for k in range(n)]


VALUES = {
    "card": "4111 1111 1111 1111",
    "iban": "DE89 3704 0044 0532 0130 00",
    "phone": "+1 (617) 555-7713",
    "ssn": "123-45-6789",
    "ip": "97.51.17.173",
    "email": "Und.34@mail7.example.com",
    "date": "2024-02-29",
}


@pytest.mark.parametrize("kind", p.KINDS)
def test_formats_stay_valid_and_invert(kind):
    text = f"before {VALUES[kind]} after"
    hidden, spans = p.pseudonymised(text, HIDE)
    assert [s[0] for s in spans] == [kind] and hidden != text and len(hidden) == len(text)
    again = p.pseudonymised(hidden, SHOW)
    assert again[0] == text and [s[0] for s in again[1]] == [kind]


def test_equal_values_stay_linked():
    digits = lambda t: "".join(c for c in p.pseudonymised(t, HIDE)[0] if c.isdigit())
    assert digits("4111111111111111") == digits("4111-1111-1111-1111")
    assert digits("+1 (617) 555-7713")[1:] == digits("617-555-7713")
    y, m, d = HIDE.date("2024-02-29").split("-")
    assert HIDE.date("02/29/2024") == f"{m}/{d}/{y}" and HIDE.date("29.02.2024") == f"{d}.{m}.{y}"
    assert HIDE.date("29/02/2024") == f"{d}/{m}/{y}"
    assert HIDE.email("und.34@MAIL7.example.com").lower() == HIDE.email("Und.34@mail7.example.com").lower()


def test_what_is_not_valid_stays():
    text = "4111111111111112 999.1.1.1 2023-02-29 000-12-3456 DE00370400440532013000 1.2.3.4.5 v12.3"
    assert p.pseudonymised(text, HIDE) == (text, [])


CARD, IBAN, SOLID = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332"


@pytest.mark.parametrize(
    "kind, value, text",
    [
        ("card", CARD, f"{CARD} 12/27"),
        ("card", CARD, f"order 12 {CARD}"),
        ("card", CARD, f"no. 77 12 {CARD} 12 27"),
        ("card", CARD, f"2024-01-02 {CARD}, 9"),
        ("card", "4111-1111-1111-1111", "x9-12 4111-1111-1111-1111 12-a"),
        ("card", "4111111111111111", "12 4111111111111111 12"),
        ("card", "3782 822463 10005", "3782 822463 10005 1226"),
        ("iban", IBAN, f"{IBAN} EUR"),
        ("iban", IBAN, f"AB12 PAY {IBAN} BIC ABCDESMM"),
        ("iban", SOLID, f"IBAN {SOLID} EUR 100"),
    ],
)
def test_values_beside_numbers_and_words(kind, value, text):
    hidden, spans = p.pseudonymised(text, HIDE)
    at = text.index(value)
    assert (kind, at, at + len(value)) in spans
    assert hidden[at : at + len(value)] == getattr(HIDE, kind)(value)
    assert p.restored(hidden, spans, SHOW) == text


def test_numbers_inside_words_stay():
    for text in ("x4111-1111-1111-1111", "4111-1111-1111-1111-x", "v.4111111111111111", "4111111111111111a", f"x{SOLID}"):
        assert p.pseudonymised(text, HIDE) == (text, [])


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op5_pii"](spark, sf)
    before = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    total = dict.fromkeys(p.KINDS, 0)
    for row in rows.collect():
        text = before.pop(row.doc_id)
        assert p.pseudonymised(row.text, SHOW_QUERY)[0] == text
        spans = [s.split(":") for s in row.spans.split(",") if s]
        for kind in p.KINDS:
            assert row[f"n_{kind}"] == sum(s[0] == kind for s in spans)
            total[kind] += row[f"n_{kind}"]
        assert all(text[int(a) : int(b)] != row.text[int(a) : int(b)] for _, a, b in spans)
        if not spans:
            assert row.text == text
    assert not before and min(total[k] for k in ("email", "card", "phone", "ip")) > 0


SHOW_QUERY = p.Permuter(p.Feistel(b"accesslens"), inverse=True)


def test_odd_rows(spark, odd_rows):
    rows = odd_rows()
    done = p.with_pseudonyms(rows, b"key", spans_col="spans")
    assert done.columns == [*rows.columns, "spans"] and done.count() == rows.count()
    assert done.where("doc_id = 2").first().text is None
    assert done.where("doc_id = 2").first().spans == ""
    plain = p.with_pseudonyms(rows, b"key")
    assert plain.schema == rows.schema
    assert plain.where("false").count() == p.with_pseudonyms(rows.where("false"), b"key").count() == 0
