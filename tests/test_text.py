import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Blood Tests", "blood test"), ("  Leave--Request  ", "leave request"), ("Policies", "policy"), ("Analysis", "analysis"), ("Bus", "bus"), ("census", "census"), ("Pass", "pass"), ("keys", "keys"),
        ("ties", "tie"), ("gas", "gas"), ("Form (W-2)", "form w 2"), ("", ""), (None, ""), ("!!!", ""), ("Ärzte", "rzte"),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, raw, X.normalize_tag("t")) == want


def test_tokens(spark):
    assert one(spark, "statement of the account for the account", X.tag_tokens("t")) == ["statement", "account"]
    assert one(spark, "5abc De1 f", X.tokenize("t")) == ["abc", "de1"]
    assert one(spark, None, X.tokenize("t")) == []


def test_bigrams(spark):
    assert one(spark, "aa bb cc", X.bigrams(X.tokenize("t"))) == ["aa bb", "bb cc"]
    assert one(spark, "aa", X.bigrams(X.tokenize("t"))) == []


def test_char_grams(spark):
    assert sorted(one(spark, "Ab c", X.char_grams("t"))) == sorted([" ab", "ab ", " ab ", " c "])


def test_accents(spark):
    assert one(spark, "Éléonore Žuñiga n̄ ø", X.strip_accents("t")) == "Eleonore Zuniga n ø"


@pytest.mark.parametrize(
    "text, want",
    [
        ("# Intake Sheet\nBody goes on. More", ["Intake Sheet", "Body goes on"]),
        ("**Lease Deed**:\n\nDear Sir,\nWe write", ["Lease Deed", "We write"]),
        ("```\n| a | b |\n-----\nWire Recall\n", ["Wire Recall"]),
        ("__Title__\nTITLE\n", ["Title"]),
        ("", []), (None, []), ("ab", []),
    ],
)
def test_headings(spark, text, want):
    assert one(spark, text, X.headings("t")) == want


def test_headings_stop_after_fourteen(spark):
    text = "\n".join(f"line {i:02d}" for i in range(30))
    assert len(one(spark, text, X.headings("t"))) == 14


def test_position(spark):
    assert one(spark, "abc def", X.position(F.col("t"), F.lit("def"))) == 4
    assert one(spark, "abc", X.position(F.col("t"), F.lit("x"))) == -1


def test_uid(spark):
    for raw in ("u000000042", "U-000000042", "UID 42", "urn:rec:000000042", "u000.000.042", "u0000000000042"):
        assert one(spark, raw, X.uid_key("t")) == "u000000042"
    assert one(spark, "u1234567890123", X.uid_key("t")) == "u1234567890123" != one(spark, "u1234567890124", X.uid_key("t"))
    assert one(spark, "none", X.uid_key("t")) is None
