import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import pii

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def by_rule(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(RULES).index(s[2])))


PARTS = st.sampled_from(["a", "é", " ", "@", ".", "-", "x.y", "1", "12", "255", "256", "007", "4111 1111 1111 1111", "4111111111111111", "+1 (988) 555-2485", "+", "(", "bob.42@mail8.example.com", "1.2.3.4", "a@b", "a@b.c@d.e", "٣", "\n", "00001.2.3.4.5.6.7.8"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PARTS, max_size=20).map("".join) | st.text(alphabet="ab@.-+ 0123(", max_size=50))
def test_base_equals_rules(text):
    assert pii.base_spans(text) == by_rule(text)


def test_trees_on_fresh_samples():
    trees, least = pii.model()
    rows = pii._samples(1500, 99)
    p = trees.probability(np.array([pii.features(t, s) for t, s, _ in rows]))
    taken = np.array([q >= least[s[2]] for q, (_, s, _) in zip(p, rows, strict=True)])
    real = np.array([y for _, _, y in rows]) == 1
    assert (taken & real).sum() / taken.sum() > 0.98 and (taken & real).sum() / real.sum() > 0.8


def test_trees_on_samples_of_another_make():
    trees, least = pii.model()
    rows = pii._other_samples(3000, 77)
    p = trees.probability(np.array([pii.features(t, s) for t, s, _ in rows]))
    taken = np.array([q >= least[s[2]] for q, (_, s, _) in zip(p, rows, strict=True)])
    real = np.array([y for _, _, y in rows]) == 1
    assert (taken & real).sum() / taken.sum() > 0.96 and (taken & real).sum() / real.sum() > 0.6


def test_spans_that_base_rules_miss():
    """A phone number followed by a card number: the phone rule runs on through both and drops them."""
    trees, least = pii.model()
    text = "ever nd +1 (269) 555-3296 4524132264652876 and on"
    assert pii.base_spans(text) == []
    assert [text[a:b] for a, b, _ in pii.all_spans(text, [], trees, least)] == ["+1 (269) 555-3296", "4524132264652876"]
    text = "write to Anna (AT) firm (DOT) com"
    assert [s[2] for s in pii.all_spans(text, [], trees, least)] == ["email"]


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), max_size=120), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), max_size=90))
def test_overlaps_with_few_and_many_base_spans(spans, base):
    spans, base = ([(a, a + n, "card") for a, n in x] for x in (spans, sorted(base)))
    assert pii.clear_of(spans, base) == [c for c in spans if not any(a < c[1] and c[0] < b for a, b, _ in base)]


def test_very_many_spans_in_one_text():
    trees, least = pii.model()
    text = "jo [at] mail [dot] com, +1 (988) 555-2485 x " * 3000
    base = pii.base_spans(text)
    found = pii.all_spans(text, base, trees, least)
    assert len(base) == 3000 and len(found) == 6000
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_operator_cases(spark):
    text = "call +1 (988) 555-2485 or (988) 555-2486 today, mail jo [at] mail [dot] com, v 1.2.3.400 é@é"
    docs = spark.createDataFrame([(1, text, 3), (1, text, 3), (2, None, 3), (3, "9" * 50_000 + "@" * 3, 3)], "doc_id long, text string, spans int")
    rows = sorted(pii.detect(docs, tuple(pii.OUTPUTS)).collect())
    assert rows[0] == rows[1] and len(rows) == 4
    assert rows[0].redacted == "call [PHONE] or [PHONE] today, mail [EMAIL], v 1.2.3.400 é@é"
    assert rows[0].base_sha256 == hashlib.sha256(b"phone:5:22").hexdigest() and rows[0].n_phone == 1
    assert rows[2].spans == "" and rows[2].redacted == "" and rows[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.detect(docs.limit(0)).count() == 0
