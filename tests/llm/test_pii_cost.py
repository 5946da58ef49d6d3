"""Detection and surrogates of problem 5: what is tried less often finds and settles the same."""

import pytest

from tessera.llm import pii, surrogates

K = b"key"


def _entities(spark):
    rows = [("id_number", f"{i:02d}") for i in range(100)] + [("family", c) for c in ("li", "lu", "wu", "иван", "ли")]
    return spark.createDataFrame([(a, c, surrogates.surrogate(a, c, K), "", "") for a, c in rows], "kind string, canon string, made string, given string, sex string")


def test_few_open_entities_make_several_attempts_in_one_scan(spark, monkeypatch):
    made, real = [], surrogates.materialize
    monkeypatch.setattr(surrogates, "materialize", lambda df, name, *a: made.append(name) or real(df, name, *a))
    other = {(r.kind, r.canon): r.made for r in surrogates.exceptions(_entities(spark), K).collect()}
    assert made.count("tried") <= 3  # all two-digit numbers are taken: over eight attempts
    monkeypatch.setattr(surrogates, "FEW", 0, raising=False)  # by joins, one attempt at a time
    assert {(r.kind, r.canon): r.made for r in surrogates.exceptions(_entities(spark), K).collect()} == other
    assert {("id_number", f"{i:02d}") for i in range(100)} <= set(other) and len({(k, m) for (k, _), m in other.items()}) == len(other)


def test_labels_are_read_only_before_numbers_of_a_known_form(monkeypatch):
    seen, real = [], pii._label_before
    monkeypatch.setattr(pii, "_label_before", lambda t, at: seen.append(at) or real(t, at))
    d = pii.Detector({})
    assert d.find("On 12 34 and 56 78, from 2019 - 2024, 10 20 (30) of 40 - 50 were 60.") == [] and seen == []
    assert d.find("SSN: 123-45-6789, ticket 12345678") == [(5, 16, "id_number")] and len(seen) == 2


@pytest.mark.parametrize("text", [
    "Lives at 12 rue de la Paix, 12 Main Street, 5 rue du Bac, Calle Mayor 5, C/ Mayor 7 and Hauptstraße 5, Marktplatz 3.",
    "plaza a, Calle\xa0Mayor 5, calle\tMayor 6; avenue b, 7\xa0rue\xa0Vieille 8bis rue X, 12345 Old Road, #12 Old Road, 9/12 Old Road",
    "Hauptſtraße 5, Bahnhofstraße 6, Ringweg 7, Rıng 8, Berlinerrıng 9, Berlinerring 9",
    "İstanbul: Hauptstraße 5, 12 Main Street", "P.O. Box 12; PO BOX 9, box 7", "12 Main Street 13 Main Street 14, Low Hill Road", "",
])
def test_address_patterns_are_tried_wherever_they_can_match(text):
    low = text.lower()
    _, starts = pii.Detector({}).known(text, low)
    for at, (words, _, pattern) in zip(starts, pii._ADDRESSES):
        want = [m.span() for m in pattern.finditer(text)] if any(w in low for w in words) else []
        assert [m.span() for m in (pii._matches(text, low, at, words, pattern) if at != [] else ())] == want
