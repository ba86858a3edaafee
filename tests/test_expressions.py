"""Scalar semantics on literal values."""

import pytest
from pyspark.sql import functions as F

from scanloom import constants as K
from scanloom.functions import payload, severity, text
from scanloom.operators import credentials


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ts(s):
    return F.to_timestamp_ntz(F.lit(s))


@pytest.mark.parametrize(
    "level, expected",
    [("ERROR", "critical"), ("critical", "critical"), ("Warning", "high"), ("INFO", "medium"), ("experiment", "low"), ("", "low")],
)
def test_rule_severity(spark, level, expected):
    assert value(spark, severity.rule_severity(F.lit(level))) == expected


@pytest.mark.parametrize(
    "check_class, expected",
    [("a.CRITICAL", "critical"), ("HIGH_LOW", "high"), ("x.MEDIUM", "medium"), ("ALLOW", "low"), ("low", "medium"), ("", "medium")],
)
def test_policy_severity(spark, check_class, expected):
    assert value(spark, severity.policy_severity(F.lit(check_class))) == expected


@pytest.mark.parametrize(
    "level, expected", [("critical", "critical"), ("High", "high"), ("LOW", "low"), ("UNKNOWN", "info"), ("", "info")]
)
def test_package_severity(spark, level, expected):
    assert value(spark, severity.package_severity(F.lit(level))) == expected


@pytest.mark.parametrize(
    "category, expected",
    [
        ("sql-injection", K.RULE_ADVICE[0][1]),
        ("xss and injection", K.RULE_ADVICE[0][1]),
        ("xss", K.RULE_ADVICE[1][1]),
        ("Crypto", K.RULE_ADVICE_DEFAULT),
        ("weak-crypto", K.RULE_ADVICE[2][1]),
        (None, K.RULE_ADVICE_DEFAULT),
    ],
)
def test_rule_advice(spark, category, expected):
    assert value(spark, severity.rule_advice(F.lit(category).cast("string"))) == expected


@pytest.mark.parametrize(
    "secret, expected",
    [
        ("", "***"),
        ("12345678", "***"),
        ("123456789", "1234***6789"),
        ("abcdef\U0001f600", "***"),  # eight UTF-16 units
        ("abcdefg\U0001f600", "abcd***efg\U0001f600"),  # nine
        (None, None),
    ],
)
def test_mask(spark, secret, expected):
    assert value(spark, text.mask_secret(F.lit(secret).cast("string"))) == expected


@pytest.mark.parametrize(
    "path, root, expected",
    [
        ("/r/a/b.txt", "/r/a", "b.txt"),
        ("/r/a/x/r/a/y", "/r/a", "x/y"),
        ("/r/a", "/r/a", ""),
        ("/r/ax/r/a/y", "/r/a", "xy"),
        ("b.txt", "/r/a", "b.txt"),
        ("a.c/x", "a.c", "x"),  # not a pattern
        ("abc/x", "a.c", "abc/x"),
    ],
)
def test_strip_root(spark, path, root, expected):
    want = path.replace(root + "/", "", 1).replace(root, "", 1)
    assert value(spark, text.strip_root(F.lit(path), F.lit(root))) == want == expected


def test_template_and_defaults(spark):
    none = F.lit(None).cast("string")
    assert value(spark, text.template("a ", none, F.lit(3))) == "a undefined3"
    assert value(spark, text.falsy_or(F.lit(""), F.lit("b"))) == "b"
    assert value(spark, text.falsy_or(none, none)) is None
    assert value(spark, text.falsy_or(none, F.lit(""))) == ""


@pytest.mark.parametrize(
    "raw, expected",
    [('["a","b"]', ["a", "b"]), ("[1,null]", ["1", None]), ("CWE-1", []), ('{"a":1}', []), (None, []), ("[]", []), ("[1", [])],
)
def test_string_list(spark, raw, expected):
    assert value(spark, text.string_list(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://github.com/o/my.repo.git", ("o", "my")),
        ("git@github.com:o/r.git", ("o", "r")),
        ("https://github.com/o", (None, None)),
        ("https://example.com/o/r", (None, None)),
    ],
)
def test_repo_url(spark, url, expected):
    pair = spark.range(1).select(text.repo_owner(F.lit(url)), text.repo_name(F.lit(url))).first()
    assert tuple(pair) == expected


@pytest.mark.parametrize("raw, expected", [("12", 12), (" 12ab", 12), ("-3", -3), ("ab", None), ("", None)])
def test_parse_int(spark, raw, expected):
    assert value(spark, text.parse_int(F.lit(raw))) == expected


@pytest.mark.parametrize(
    "token, expires, expected",
    [
        ("t", "2024-01-01 00:05:00", False),
        ("t", "2024-01-01 00:05:00.001", True),
        ("", "2024-01-01 01:00:00", False),
        (None, "2024-01-01 01:00:00", False),
        ("t", None, False),
    ],
)
def test_token_valid(spark, token, expires, expected):
    valid = text.token_valid(
        F.lit(token).cast("string"), F.lit(expires).cast("timestamp_ntz"), ts("2024-01-01 00:00:00")
    )
    assert value(spark, valid) is expected


def test_minutes_round_half_up(spark):
    now = ts("2024-01-01 00:00:00")
    assert value(spark, text.minutes_until(ts("2024-01-01 00:02:30"), now)) == 3
    assert value(spark, text.minutes_until(ts("2023-12-31 23:57:30"), now)) == -2


def test_elapsed_ignores_the_session_zone(spark):
    start, end = ts("2024-03-10 01:30:00"), ts("2024-03-10 02:30:00.250")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 02:30 does not exist there
    try:
        assert value(spark, text.duration_ms(start, end)) == 3_600_250
        assert value(spark, text.duration_ms(end, start)) == -3_600_250
        assert value(spark, text.epoch_micros(end)) == 1_710_037_800_250_000
        assert value(spark, text.elapsed("hour", start, end)) == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_blank_knows_all_white_space(spark):
    assert value(spark, text.is_blank(F.lit("﻿ \t\n 　"))) is True
    assert value(spark, text.is_blank(F.lit(" x "))) is False


GIB = 1024**3


@pytest.mark.parametrize(
    "code, size, content, expected",
    [
        ("404", 0, b"", "http_error"),
        (" 200\n", None, None, "missing"),
        ("204", 0, b"", "empty"),
        ("200", 5 * GIB + 1, b"PK", "too_large"),
        ("200", 5 * GIB, b"PK\x03\x04", "ok"),
        ("200", 2, b"PK", "ok"),
        ("200", 2, b"Pk", "not_zip"),
        ("200", 1, b"P", "not_zip"),
    ],
)
def test_payload_class(spark, code, size, content, expected):
    got = payload.payload_class(
        F.lit(code), F.lit(size).cast("bigint"), F.lit(bytearray(content) if content is not None else None).cast("binary")
    )
    assert value(spark, got) == expected


def test_html_hint(spark):
    assert value(spark, payload.looks_like_html(F.lit(b"\xff<html>"))) is True
    assert value(spark, payload.looks_like_html(F.lit(b"<HTML>"))) is False
    assert value(spark, payload.looks_like_html(F.lit(b"x" * 200 + b"<html"))) is False


def test_invalid_utf8(spark):
    assert value(spark, text.utf8_text(F.lit(b"a\xffb"))) == "a�b"


def test_archive_root(spark):
    assert value(spark, text.strip_archive_root(F.lit("repo-main/a/b"))) == "a/b"
    assert value(spark, text.strip_archive_root(F.lit("file"))) == "file"


def test_outcome(spark):
    none = F.lit(None).cast("string")
    assert value(spark, credentials.outcome(F.lit("s"), none)) == '{"success":true,"scanId":"s"}'
    assert value(spark, credentials.outcome(F.lit("s"), F.lit("boom"))) == '{"error":"boom"}'
    assert value(spark, credentials.outcome(F.lit("s"), F.lit(""))) == '{"error":"Processing failed"}'
