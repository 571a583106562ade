import json
import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlog import errors
from loomlog.functions import canonical as C

JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**53) + 1, 2**53 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4),
    max_leaves=12,
)


@pytest.mark.parametrize(
    "value,text",
    [
        (1e21, "1e+21"), (1e16, "10000000000000000"), (1e-7, "1e-7"), (0.000001, "0.000001"), (-0.0, "0"), (1.5, "1.5"), (100.0, "100"),
        (1.7976931348623157e308, "1.7976931348623157e+308"), (5e-324, "5e-324"), (123456789012345680000.0, "123456789012345680000"), (True, "true"),
        ({"b": 1, "a": [None, "é\n "]}, '{"a":[null,"é\\n "],"b":1}'), ({"": 1, "\U0001f600": 2}, '{"\U0001f600":2,"":1}'),
    ],
)
def test_canonical_forms(value, text):
    assert C.canonical(value) == text


@settings(max_examples=200, deadline=None)
@given(JSON)
def test_canonical_is_stable_and_equal_in_value(value):
    text = C.canonical(value)
    assert C.canonical_text(text) == text
    assert C.canonical_text(json.dumps(value, indent=1)) == text


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1))
def test_numbers_read_back(bits):
    x = struct.unpack("d", struct.pack("Q", bits))[0]
    if math.isfinite(x):
        assert float(C.canonical(x)) == x
    else:
        with pytest.raises(errors.InvalidJsonValueError):
            C.canonical(x)


@pytest.mark.parametrize("bad", [object(), {1: 2}, [float("nan")], 10**400, b"x"])
def test_values_without_a_form(bad):
    with pytest.raises(errors.InvalidJsonValueError):
        C.canonical(bad)


def test_columns(spark):
    df = spark.createDataFrame([('q"\\\n', 7, bytearray(b"\x00\xff")), (None, None, bytearray())], "s string, i long, b binary")
    got = df.select(
        C.json_object({"s": C.json_string(F.col("s")), "i": C.json_integer(F.col("i"))}).alias("o"),
        C.primary_key([C.json_string(F.col("s")), C.json_integer(F.col("i"))]).alias("k"),
        C.bytes_of(F.col("b")).alias("b"),
        C.canonical_json(F.lit(' {"b":1e3, "a":NaN}')).alias("bad"),
        C.canonical_json(F.lit(' {"b":1e3, "a":[]}')).alias("good"),
        C.operation_id().alias("id"),
    ).collect()
    assert [r.o for r in got] == ['{"i":7,"s":"q\\"\\\\\\n"}', '{"i":null,"s":null}']
    assert [r.k for r in got] == ['["q\\"\\\\\\n",7]', "[null,null]"]
    assert [r.b for r in got] == [[0, 255], []]
    assert got[0].bad is None and got[0].good == '{"a":[],"b":1000}' and got[0].id.startswith("op_")


@pytest.mark.parametrize(
    "declared,affinity",
    [
        ("BIGINT", "integer"), ("varchar(30)", "text"), ("BLOB", "blob"), ("DOUBLE PRECISION", "real"), ("DECIMAL(10,2)", "numeric"),
        ("", "blob"), (None, "blob"), ("FLOATING POINT", "integer"), (" clob ", "text"), ("DATE", "numeric"),
    ],
)
def test_affinity(spark, declared, affinity):
    df = spark.createDataFrame([(declared,)], "t string")
    assert df.select(C.affinity(F.col("t")).alias("a")).first().a == affinity


def test_retry_delay(spark):
    got = spark.range(6).select(C.retry_delay_ms(F.col("id"), jitter=F.lit(0.5)).cast("long").alias("d")).collect()
    assert [r.d for r in got] == [180, 300, 540, 1020, 1980, 2060]


def test_answers():
    assert errors.answer(errors.UnknownBaseSequenceError()) == (409, "future-base-sequence")
    assert errors.answer(errors.LogGapError()) == (400, "sync-protocol-error")
    assert errors.answer(ValueError()) == (500, "internal-error")
    assert errors.answer(errors.RequestTooLargeError()) == (413, "request-too-large")
