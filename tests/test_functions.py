"""Scalar functions against the published rules' own answers."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from cadastra.functions import codes, ids, numbers, text, times


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "long", bool: "boolean", type(None): "string"}
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kinds[type(values[n])]}" for n in names)) if names else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given,want", [("  a   b\n", "a b"), (None, ""), ("", "")])
def test_collapse(spark, given, want):
    assert one(spark, text.collapse("v"), v=given) == want


@pytest.mark.parametrize("given,want", [("จังหวัด สุโขทัย", " สุโขทัย"), ("จังหวัดสุโขทัย", "สุโขทัย")])
def test_area_name(spark, given, want):
    assert one(spark, text.area_name("v"), v=given) == want
    assert one(spark, text.area_name_first_removed("v"), v=given) == want.strip()
    assert one(spark, text.area_name_packed("v"), v=given + " X ") == want.strip() + "x"


def test_names_area(spark):
    assert one(spark, text.names_area("v", F.lit("สุโขทัย")), v="จังหวัด สุโข ทัย เหนือ") is True
    assert one(spark, text.names_area("v", F.lit("สุโขทัย"), F.lit("sukhothai")), v="Sukho Thai") is True
    assert one(spark, text.names_area("v", F.lit("สุโขทัย")), v=None) is True
    assert one(spark, text.names_area("v", F.lit("สุโขทัย"), missing=False), v="") is False


@pytest.mark.parametrize("given,want", [("5", "05"), (" 53 ", "53"), ("123", "12"), ("", None), (r"\N", None), ("_unknown", None), ("๕", None), (None, None)])
def test_area_code(spark, given, want):
    assert one(spark, codes.area_code("v"), v=given) == want


def test_request_code(spark):
    assert [one(spark, codes.request_code("v"), v=v) for v in ("5", "53", " 123 ")] == ["05", "53", "123"]


@pytest.mark.parametrize("given", ["1_000", "1d", "1.5", "-1e3", "+.5", "nan", "inf", "1,000", "", "abc", "0x10", " 7 ", "1e999", None])
def test_strict_double(spark, given):
    try:
        want = float(given)
        want = want if math.isfinite(want) else None
    except (TypeError, ValueError):
        want = None
    assert one(spark, numbers.strict_double("v"), v=given) == want


def test_lenient_double(spark):
    assert one(spark, numbers.lenient_double("v"), v="1,234.5") == 1234.5
    assert math.isnan(one(spark, numbers.lenient_double("v"), v="NaN")) and one(spark, numbers.lenient_double("v"), v="-Infinity") == float("-inf")
    assert one(spark, numbers.lenient_double("v"), v="1f") is None


def test_rounding_is_that_of_python(spark):
    rng = random.Random(1)
    values = [2.675, 0.125, 2.5, -0.5, 39.245] + [rng.uniform(-1e5, 1e5) for _ in range(2000)] + [rng.randrange(10**6) / 1000 for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 1, 2, 4):
        got = [r[0] for r in df.select(numbers.ieee_rounded("v", places)).collect()]
        assert all(g == round(v, places) for g, v in zip(got, values, strict=True))


def test_shown(spark):
    assert one(spark, numbers.shown("v", 1, "%"), v=1234.56) == "1,234.6%"


@pytest.mark.parametrize("given,want", [("ownerContact", "owner_contact"), ("Area Code (TH)", "area_code_th"), ("__a--b__", "a_b"), ("จังหวัด name", "จังหวัด_name")])
def test_snake_key(spark, given, want):
    assert one(spark, text.snake_key("v"), v=given) == want


@pytest.mark.parametrize("given,want", [("phoneNumber", "contact key"), ("researcherName", "person name key"), ("address_province", None), ("home_address", "address key"), ("api_key", "credential key"), ("citizen", None), ("citizenId", "person id key"), ("microphone", None), ("value", None)])
def test_forbidden_key(spark, given, want):
    assert one(spark, text.forbidden_key("v"), v=given) == want


def test_redaction(spark):
    got = one(spark, text.redact("v"), v="call 081-234-5678 or +66 81 234 5678, mail A.b@c.co.th; code 6612345678901 of 2569")
    assert got == "call [redacted-phone] or [redacted-phone], mail [redacted-email]; code 6612345678901 of 2569"
    assert one(spark, text.holds_contact("v"), v="x") is False and one(spark, text.holds_contact("v"), v=None) is False


def test_contact_clauses(spark):
    assert one(spark, text.without_contact_clauses("v"), v="A good project ; contact: Bob 12 ; ที่อยู่ 9 | see https://x.y/z and @handle now") == "A good project see and now"
    assert one(spark, text.without_contact_clauses("v"), v="โทร 081") is None


def test_link_readings(spark):
    got = one(spark, text.readings_of_link("v"), v="สถานี 1,023.5ม.รทก.ปริมาณน้ำ45.2% ตลิ่ง1,030ม.รทก. ปกติ")
    assert got.asDict() == {"water_level": 1023.5, "water_percent": 45.2, "bank_level": 1030.0, "status": "ปกติ"}


def test_small_text_functions(spark):
    assert one(spark, text.station_code("v"), v="ridhydro_Y.15") == "Y.15" and one(spark, text.station_code("v"), v="hydro_telewater_1") == "telewater_1"
    assert one(spark, text.maturity_level("v"), v="TRL 1-7") == 7 and one(spark, text.maturity_level("v"), v="level 1") is None
    assert one(spark, text.shortened("v", 10), v="a b " * 9) == "a b a b a…" and one(spark, text.shortened("v", 10), v="short") == "short"
    assert one(spark, text.first_present("a", "b"), a="", b="x") == "x"


def test_times(spark):
    iso = lambda v: one(spark, F.date_format(times.iso_time("v"), "yyyy-MM-dd HH:mm:ss"), v=v)
    assert iso("2026-06-01T10:00:00Z") == "2026-06-01 10:00:00" and iso("2026-06-01 10:00:00+07:00") == "2026-06-01 03:00:00"
    assert iso("2569") is None and iso("2026-06-01") == "2026-06-01 00:00:00" and iso("2026-13-01") is None and iso(None) is None
    assert one(spark, times.zoned_iso_time("v"), v="2026-06-01T10:00:00") is None and one(spark, times.zoned_iso_time("v"), v="2026-06-01T10:00:00Z") is not None
    week = lambda v: one(spark, times.bucket(F.col("v").cast("timestamp_ntz"), "weekly"), v=v)
    assert week("2027-01-01") == "2026-W53" and week("2026-06-01") == "2026-W23"
    clock = F.lit("2030-01-01").cast("timestamp")
    assert one(spark, F.year(times.time_or_clock("v", clock)), v="") == 2030
    with pytest.raises(Exception, match="not an ISO time"):
        one(spark, times.time_or_clock("v", clock), v="soon")
    assert one(spark, times.observed_at(F.col("a"), F.lit("2026-01-02").cast("timestamp"), F.col("b")), a="2569", b="") == "2569"


def test_restricted_endpoints(spark):
    from cadastra.functions.codes import restricted_endpoint

    judge = lambda p, a, x: one(spark, restricted_endpoint(F.col("p"), F.col("a"), F.col("x")), p=p, a=a, x=x)
    assert judge("restricted_local_only", "", "") and judge("p", "GET HTTP_401", "") and judge("p", "", "Do_Not_Call now") and judge("p", "Login page", "")
    assert not judge("public", "open", "call") and not judge(None, None, None)


def test_fields_that_look_nested(spark):
    payload = '{"a": "[2024] report", "b": "{x", "c": [1], "d": {"e": 1}, "n": 2.50, "t": true, "z": null}'
    assert one(spark, ids.field("v", "a"), v=payload) == "[2024] report" and one(spark, ids.field("v", "b"), v=payload) == "{x"
    assert one(spark, ids.field("v", "c"), v=payload) is None and one(spark, ids.field("v", "d"), v=payload) is None and one(spark, ids.field("v", "z"), v=payload) is None
    assert one(spark, ids.field_json("v", "a"), v=payload) == '"[2024] report"' and one(spark, ids.field_json("v", "t"), v=payload) == "true" and one(spark, ids.field_json("v", "d.e"), v=payload) == "1"
    assert one(spark, ids.field("v", "a"), v="no json") is None


def test_identities(spark):
    payload = '{"id": "A1", "nested": {"year": 2569}, "list": [1], "empty": ""}'
    options = [["missing"], ["list"], ["empty", "id"], ["id", "nested.year"]]
    assert one(spark, ids.contract_id("v", options, F.lit("h")), v=payload) == "composite:" + hashlib.sha256(b'["A1",2569]').hexdigest()
    assert one(spark, ids.contract_id("v", [["nope"], ["$payload_hash"]], F.lit("h")), v=payload) == "h"
    assert one(spark, ids.contract_id("v", [["nope"]], F.lit("h")), v=payload) is None
    assert one(spark, ids.contract_id("v", [["id"]], F.lit("h")), v='{"id": "%s"}' % ("x" * 201)) is None
    assert one(spark, ids.contract_as_of("v", ["empty", "nested.year"]), v=payload) == "2569"
    assert one(spark, ids.guessed_id("v", F.lit("h")), v=payload) == "A1" and one(spark, ids.guessed_id("v", F.lit("h")), v="{}") == "h"
    assert one(spark, ids.snapshot_id(F.lit("d"), F.col("v"), ["id", "empty"], ["t", "nested.year"], F.lit("h")), v=payload) == "d:A1:2569"
    assert one(spark, ids.snapshot_id(F.lit("d"), F.col("v"), ["x"], [], F.lit("h")), v=payload) == "d:h"
    assert one(spark, ids.payload_hash("v"), v='{"b": 1, "a": [2, "x"]}') == hashlib.sha256('{"a":[2,"x"],"b":1}'.encode()).hexdigest()
    assert one(spark, ids.pointer("v", "/a~1b/0"), v='{"a/b": [7]}') == "7"
    assert one(spark, ids.group_id(F.lit("a"), F.lit("b"))) == hashlib.sha256(b"a\x1fb").hexdigest()[:16]


def test_step(spark):
    up = lambda v: one(spark, numbers.step("v", [1.0, 2.0], ["low", "mid", "high"]), v=v)
    assert [up(v) for v in (0.5, 1.0, 1.5, 9.0)] == ["low", "low", "mid", "high"]
    assert one(spark, numbers.step("v", [2.0, 1.0], ["high", "mid", "low"], ascending=False), v=1.5) == "mid"
