import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import names as N
from plumbline.functions import privacy as P


@pytest.mark.parametrize("name", ["password", "user_password", "api_key", "refresh_token", "otp", "aadhaar_no", "pan", "pan_card", "authorization"])
def test_secret_names(name):
    assert N.DEFAULT_POLICY.is_secret(name)


@pytest.mark.parametrize("name", ["company", "japan_office", "expand", "tokenizer_version_note"])
def test_ordinary_names(name):
    assert not N.DEFAULT_POLICY.is_secret(name)


def test_added_names():
    assert N.NamePolicy(["Salary", "x", "!!"]).is_secret("gross_salary") and not N.NamePolicy(["x"]).is_secret("x")
    policy = N.NamePolicy(extra_secret=["salary"], extra_personal=["fax"])
    assert policy.is_secret("net_salary") and policy.is_personal("fax2") and not N.DEFAULT_POLICY.is_secret("net_salary")


def test_mask(spark):
    df = spark.createDataFrame(
        [("someone@example.com", "9876543210", "p", "t", 9876543210.0, "12")],
        "email string, mobile_number string, password string, api_token string, phone double, contact string")
    row = P.mask(df).first()
    assert row.email == "s•••@example.com" and row.mobile_number == "98••••••10" and row.phone == "98••••••10" and row.contact == "12"
    assert row.password == row.api_token == P.HIDDEN
    open_row = P.mask(df, show_personal=True).first()
    assert open_row.email == "someone@example.com" and open_row.phone == 9876543210.0 and open_row.password == P.HIDDEN


def test_scrub(spark):
    text = 'email abc.def@gmail.com mobile 9876543210, 9876543211 {"token": "abc123", "password":"p"} 12345678901234'
    got = spark.createDataFrame([(text,)], "t string").select(P.scrub(F.col("t"))).first()[0]
    for gone in ("abc.def@", "9876543210", "9876543211", "abc123", '"p"'):
        assert gone not in got
    assert "a•••@gmail.com" in got and "98••••••10" in got and "12345678901234" in got


@pytest.mark.parametrize("sql, expected", [
    ("SELECT 1 FROM t WHERE mobile = '98765'", "SELECT 1 FROM t WHERE mobile = '•••'"),
    ("WHERE u.phone_no IN ('1','22') AND id IN (1234, 5)", "WHERE u.phone_no IN ('•••','•••') AND id IN (1234, 5)"),
    ("WHERE email = 'ab@x.io' AND id = 12345", "WHERE email = 'a•••@x.io' AND id = 12345"),
    ("WHERE otp <> 123456 OR a = 1", "WHERE otp <> '•••' OR a = 1"),
    ("WHERE contact NOT IN (99999)", "WHERE contact NOT IN ('•••')"),
    (None, None),
])
def test_scrub_sql(spark, sql, expected):
    assert spark.createDataFrame([(sql,)], "s string").select(P.scrub_sql(F.col("s"))).first()[0] == expected


@pytest.mark.parametrize("value, dtype, message", [("x", "string", b'"x"'), (5, "bigint", b"5"), (None, "string", b"null")])
def test_fingerprint_is_hmac(spark, value, dtype, message):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    got = df.select(P.fingerprint(F.col("v"), df.schema[0].dataType, b"key")).first()[0]
    assert got == hmac.new(b"key", message, hashlib.sha256).hexdigest()[:32]


def test_long_keys_are_refused():
    with pytest.raises(ValueError):
        P.hmac_sha256(F.lit("x"), b"k" * 65)


def test_presence_of_personal_data_is_what_the_patterns_find(spark):
    rng = random.Random(3)
    pieces = ["password", "PassWd", "pan", "token", "access_token", "OTP", "api_key", "aadhaar", "authorization", "secret", '"', "'", ":", "=", " ", "\n", ",", "}",
              "x", "+", "1", "23", "4567890", "98765", "é", "٣", "@", "a.b", "mail@host", ".com", ".c", "%", "-", "K"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(4000)] + [None, "", "p" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    pairs = [(P.personal_text(t), t.rlike(P.EMAIL_VALUE)), (P.phone_text(t), t.rlike(P.PHONE_RUN)), (P.secret_text(t), t.rlike(P.SECRET_PAIR))]
    row = df.agg(*[F.count_if(~a.eqNullSafe(b)) for a, b in pairs], *[F.count_if(b) for _, b in pairs]).first()
    assert row[:3] == (0, 0, 0) and min(row[3:]) > 20
