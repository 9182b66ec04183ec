import time

import pytest
from pyspark.sql import functions as F

from veilspan import dialect
from veilspan.catalog import RULES, UserRule
from veilspan.operators import detect, spans, validate


def found(spark, text, detector=None):
    df = spark.createDataFrame([(text,)], "text string")
    return detect.detect(df, [detector or detect.built_in()]).first().matches


def redacted(spark, text):
    df = detect.detect(spark.createDataFrame([(text,)], "text string"), [detect.built_in()])
    return df.select(spans.redacted(F.col("text"), F.col("matches"), F.lit("none"))).first()[0]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("Write to mia.k@harbour.example or ring +1 (617) 555-0148; see https://wiki.example/7 of 2031-02-11, key sk_demo_0a1b2c3d4e5f.", "Write to [PRIVATE_EMAIL] or ring [PRIVATE_PHONE]; see [PRIVATE_URL] of [PRIVATE_DATE], key [SECRET]."),
        ("Resident 900101-1234560, insured 123456789018, locker 123456789012.", "Resident [ACCOUNT_NUMBER], insured [ACCOUNT_NUMBER], locker 123456789012."),
        ("Nothing to hide here.", "Nothing to hide here."),
        ("paid with 4111 1111 1111 1111", "paid with [ACCOUNT_NUMBER]"),
        ("refused 4111 1111 1111 1112", "refused 4111 1111 1111 1112"),
        ("serial 94111111111111111", "serial 94111111111111111"),
        ("no. 9001011234560", "no. [ACCOUNT_NUMBER]"),
        ("987-6543", "987-6543"),
        ("", ""),
    ],
)
def test_golden(spark, text, wanted):
    assert redacted(spark, text) == wanted


def test_cjk_neighbours_and_code_points(spark):
    got = found(spark, "会員123456789018号、〒987-6543 🌊 n@p.io")
    assert {m.kind for m in got} == {"account_number", "private_address", "private_email"}
    mail = next(m for m in got if m.kind == "private_email")
    assert (mail.start, mail.end, mail.match_id) == (28, 34, "private-email-28-0")


def test_five_phones(spark):
    got = found(spark, "Lines: 010-5551-0199 (mobile), 02-555-0199 (desk), +82 10-5551-0199 (abroad), 080-5551-0199 (branch), 03-5551-0199 (front).")
    assert sum(m.kind == "private_phone" for m in got) == 5


def test_secrets(spark):
    good = ["ASIA" + "B" * 16, "ghs_" + "D" * 36, "eyJ0eXBlIjoi.eyJuYW1lIjoi.bm9uZQ", "-----BEGIN EC PRIVATE KEY-----\nxy\n-----END EC PRIVATE KEY-----"]
    for text in good:
        assert [m.value for m in found(spark, text) if m.kind == "secret"] == [text]
    for text in ("ghs_brief", "ASIA77", "-----BEGIN PUBLIC KEY-----\nxy\n-----END PUBLIC KEY-----"):
        assert not found(spark, text)


def test_null_text_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, 1, "x")], "text string, start int, value string")
    row = detect.detect(df, [detect.built_in()]).first()
    assert row.matches == [] and row.value == "x"
    assert detect.detect(df.limit(0), [detect.built_in()]).count() == 0


def test_user_rules(spark):
    rules = [UserRule("1", "Exact", "exact", "secret-token"), UserRule("2", "", "regex", r"abc-\d+"), UserRule("3", "Bad", "regex", "[a("), UserRule("4", "None", "exact", "")]
    got = found(spark, "Code ABC-123 and secret-token, Secret-Token", detect.user_rules(rules))
    assert [(m.kind, m.value) for m in got] == [("Custom", "ABC-123"), ("Exact", "secret-token")]


def test_validators(spark):
    cases = {
        "card": (validate.card_valid, ["4111111111111111", "378282246310005", "4000000000000000006"], ["4111111111111112", "0000000000000000", "411111111111", "41111111111111111111", ""]),
        "my": (validate.jp_my_number_valid, ["123456789018"], ["123456789019", "000000000000", "12"]),
        "corp": (validate.jp_corporate_valid, ["8700110005901"], ["1700110005901", ""]),
    }
    for check, good, bad in cases.values():
        df = spark.createDataFrame([(v,) for v in good + bad], "v string").select("v", check(F.col("v")).alias("ok"))
        assert {r.v for r in df.collect() if r.ok} == set(good)
    kr = {"900101-1234560": "possible-modern", "000229-3234563": "legacy-checksum", "990229-1234567": "invalid", "900101-9234567": "invalid", "901301-1234567": "invalid"}
    df = spark.createDataFrame([(v,) for v in kr], "v string").select("v", validate.kr_class(F.col("v")).alias("k"))
    assert {r.v: r.k for r in df.collect()} == kr


def test_raw_hits_count_rejected_ones(spark):
    df = spark.createDataFrame([(1, "4111 1111 1111 1112, 4111 1111 1111 1111"), (3, None)], "id long, text string")
    rows = [(r.ordinal, r.start) for r in detect.raw_hits(df, "id", rules=[r for r in RULES if r.prefix == "credit-card"]).collect()]
    assert sorted(rows) == [(0, 0), (1, 21)]
    assert [m.match_id for m in found(spark, "4111 1111 1111 1112, 4111 1111 1111 1111") if m.kind == "account_number"] == ["credit-card-21-1"]


def test_checks_agree_with_columns(spark):
    values = ["4111111111111111", "4111-1111-1111-1112", "900101-1234560", "990229-1234567", "123456789018", "123456789019", "8700110005901", "1700110005901", "0000000000000"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    columns = {"luhn": validate.card_valid, "kr_registration": lambda v: validate.kr_class(v) != "invalid", "jp_my_number": validate.jp_my_number_valid, "jp_corporate": validate.jp_corporate_valid}
    for name, check in columns.items():
        want = {r.v for r in df.where(check(F.col("v"))).collect()}
        assert {v for v in values if validate.CHECKS[name](v, 0, len(v))} == want
    assert not validate.CHECKS["jp_my_number"]("1234 123456789018", 5, 17) and not validate.CHECKS["luhn"]("14111111111111111", 1, 17)


def test_cost_grows_with_hits(spark):
    text = "a@b.co 2031-02-11 " * 32_000
    begun = time.perf_counter()
    assert len(found(spark, text)) == 64_000
    assert time.perf_counter() - begun < 60


def test_script_patterns():
    cases = {"[[]": ("a[b", ["["]), "(?<n>ab)c": ("xABc", ["ABc"]), r"(?<n>a)\k<n>": ("aA", ["aA"]), "[^]": ("\n", ["\n"]), r"\d+$": ("1\n", []), "x{e<=1}": ("x{e<=1}", ["x{e<=1}"]), r"[\w-]+": ("é-a", ["-a"]), r"(a)?b\1": ("bb", ["b", "b"]), r"\u0041|\x42": ("ab", ["a", "b"])}
    for pattern, (text, want) in cases.items():
        assert [m.group() for m in dialect.compiled(pattern).finditer(text)] == want
    for bad in ("[a(", "a++", "(?>a)", "(?i)a", "*a", "a**", "[z-a]", "(", "a\\"):
        assert dialect.compiled(bad) is None


def test_no_user_pattern_fails_a_query(spark):
    rules = [UserRule(str(i), f"k{i}", "regex", p) for i, p in enumerate(["[[]", "(?<n>ab)c", "a++", "(?R)", "\\", "{", "(?<1>a)", ""])]
    assert {(m.kind, m.value) for m in found(spark, "[ abC {", detect.user_rules(rules))} == {("k0", "["), ("k1", "abC"), ("k5", "{")}


def test_backends(spark):
    model = detect.model_spans(lambda text: detect.built_in(RULES[:1])(text))
    assert detect.detector("bardsai", models={"bardsai": model}) is model
    assert found(spark, "a@b.co 2031-02-11", detect.detector("other"))[1].kind == "private_date"
    with pytest.raises(LookupError):
        detect.detector("onnx")
    card = "番号4111111111111111です"
    assert len(found(spark, card)) == 1 and found(spark, card, detect.detector("regex", unicode=True)) == []
    assert len(found(spark, "番号123456789018です", detect.detector("regex", unicode=True))) == 1
