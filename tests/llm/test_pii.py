import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfold.llm import pii
from tests.llm.helpers import awkward, empty, intact

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=3000, deadline=None)
@given(st.one_of(st.text(alphabet="a@.-1+ (0é", max_size=40), st.text(alphabet="0123456789 -+.@", max_size=60), st.text(alphabet="+1 (2).-3", max_size=50)))
def test_base_spans_equal_brute_force(text):
    assert [x for x in pii.find(text) if x[1] < 4] == brute(text)


def test_very_long_runs_of_digits():
    for text in ("0" * 5000 + ".1.1.1", "1.0.0." + "0" * 9000 + "255", "9" * 5000 + ".1.1.1", "1.1.1." + "7" * 9000, "+" + "1" * 6000, "1 " * 6000):
        short = [x for x in pii.find(text) if x[1] < 4]
        assert short == ([(0, 1, len(text))] if text[0] in "01" and text.count(".") == 3 and "7" not in text else [])


def test_on_documents(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in texts:
        assert [x for x in pii.find(t) if x[1] < 4] == brute(t)


def test_cues_and_schemes():
    text = 'see https://a.example/x?y=1, or token = "1eb9c654e721b4f8" and mailto:me@b.example.'
    got = {(pii.KINDS[k], text[a:b]) for a, k, b in pii.find(text)}
    assert got == {("url", "https://a.example/x?y=1"), ("account", "1eb9c654e721b4f8"), ("url", "mailto:me@b.example"), ("email", "me@b.example")}
    assert pii.masked(text, pii.find(text)).startswith('see [URL], or token = "[ACCOUNT]" and [URL]')


def test_awkward(spark):
    docs = awkward(spark)
    rows = pii.spans(docs).collect()
    assert len(rows) == 10
    r = next(x for x in rows if x.doc_id == 8)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert all(x.spans == "" for x in rows if x.doc_id in (3, 4))
    clean = pii.mask(docs)
    assert intact(clean, docs) and clean.count() == 10
    got = {x.doc_id: x.text for x in clean.collect()}
    assert got[3] is None and "[EMAIL]" in got[8] and "4111" not in got[8]
    assert pii.spans(empty(spark)).count() == 0 and pii.mask(empty(spark)).count() == 0
