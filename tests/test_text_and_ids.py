import hashlib
import hmac

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilmill.functions import ids, osa, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def osa_python(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_squeeze(spark):
    assert one(spark, "  a  b\u0085\x1cc\n\td ", text.squeeze) == "a b c d"
    assert one(spark, None, text.squeeze) == ""


def test_rounding(spark):
    for x, n in ((0.25, 1), (0.35, 1), (2.675, 2), (33.333333, 1), (1.005, 2)):
        assert one(spark, x, lambda c, n=n: text.half_even(c, n), "double") == round(round(x * 10**n) / 10**n, 10)


def test_ids(spark):
    for raw, want in (("t3_abc", "abc"), (" t1_ abc ", "abc"), ("t19ze4d", "t19ze4d"), ("  ", None), (None, None), (" x　", "x"), ("t3_", None)):
        assert one(spark, raw, ids.bare_id) == want
    assert one(spark, " t1_x", lambda c: ids.prefixed_id(c, "post")) == "t1_x"
    assert one(spark, "x", lambda c: ids.prefixed_id(c, "post")) == "t3_x"


def test_hmac(spark):
    for salt in (b"short", b"k" * 64, b"long" * 40):
        assert one(spark, "näme", lambda c, s=salt: ids.hmac_sha256(c, s)) == hmac.new(salt, "näme".encode(), hashlib.sha256).hexdigest()
    assert one(spark, " [Deleted] ", lambda c: ids.author_hash(c, b"s")) == ""
    assert len(one(spark, "someone", lambda c: ids.author_hash(c, b"s"))) == 32


def test_record_id(spark):
    made = one(spark, "u", lambda c: ids.record_id([F.lit("")], [c, F.lit(None).cast("string"), F.lit("d")]))
    assert made == hashlib.sha256("u\x1f\x1fd".encode()).hexdigest()[:24]
    assert one(spark, "given", lambda c: ids.record_id([F.lit(None).cast("string"), c], [F.lit("x")])) == "given"


WORD = st.text("abc", max_size=6)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(WORD, WORD), min_size=20, max_size=20))
def test_osa(spark, pairs):
    pairs += [("", ""), ("ca", "abc"), ("farixga", "farxiga")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", osa.osa_distance(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").alias("l"), osa.close_distance(F.col("a"), F.col("b"), 0.8).alias("c")).collect()
    for r in got:
        want = osa_python(r["a"], r["b"])
        assert r["d"] == want
        assert r["l"] / 2 <= want <= r["l"]
        longest = max(len(r["a"]), len(r["b"]))
        if longest and 1 - want / longest >= 0.8:
            assert r["c"] == want


def test_author_hash_ignores_case(rows):
    from vigilmill.functions.ids import author_hash

    df = rows([("Ann",), ("aNN ",), ("bo",), ("[Deleted]",), (None,), ("",)], "a string")
    got = [r[0] for r in df.select(author_hash(F.col("a"), b"salt")).collect()]
    assert got[0] == got[1] != got[2] and len(got[0]) == 32 and got[3:] == ["", "", ""]
