"""Sparse vectors and text functions by hand-computed values."""

import pytest
from pyspark.sql import functions as F

from recallgrid.functions import text as T
from recallgrid.functions import vectors as V
from recallgrid.operators import encode as E


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("x")).first().x


def arr(kind, *items):
    return F.array(*[F.lit(i) for i in items]).cast(f"array<{kind}>")


def code(dim, entries):
    return V.make_code(dim, arr("int", *entries), arr("double", *entries.values()))


def test_normalize_and_dot(one):
    a = V.normalized(code(8, {5: 4.0, 1: 3.0}))
    got = value(one, a)
    assert got["indices"] == [1, 5] and got["values"] == pytest.approx([0.6, 0.8])
    assert value(one, V.dot(a, code(8, {1: 1.0, 7: 2.0}))) == pytest.approx(0.6)
    assert value(one, V.overlap(a, code(8, {1: 1.0, 7: 2.0}))) == 1


@pytest.mark.parametrize(("dim", "idx", "val"), [(4, [4], [1.0]), (4, [1, 1], [1.0, 2.0]), (4, [1], [1.0, 2.0])])
def test_invalid_codes_fail(one, dim, idx, val):
    with pytest.raises(Exception, match="invalid sparse code"):
        value(one, V.make_code(dim, arr("int", *idx), arr("double", *val)))


def test_dimension_guard(one):
    with pytest.raises(Exception, match="dimensions differ"):
        value(one, V.dot(code(8, {1: 1.0}), code(4, {1: 1.0})))


def test_topk_returns_small_codes_as_they_are(one):
    got = value(one, V.topk(code(4, {1: -3.0, 2: 1.0}), 2, positive_only=True))
    assert got["values"] == [-3.0, 1.0]
    assert value(one, V.topk(code(4, {1: -3.0, 2: 1.0}), 1))["indices"] == [1]


def test_from_dense_ties_and_threshold(one):
    got = value(one, V.from_dense(arr("double", 1, -2, 2, 0, 0.1), 2, normalize=False))
    assert got["indices"] == [1, 2] and got["dimension"] == 5
    assert value(one, V.from_dense(arr("double", 1, -2, 2, 0), 3, positive_only=True, threshold=1.5, normalize=False))["indices"] == [2]
    assert value(one, V.to_dense(V.from_dense(arr("double", 0, 3, 4), 2))) == pytest.approx([0, 0.6, 0.8])
    assert value(one, V.norm(V.empty_code(3))) == 0


def test_aliases_apply_once(one):
    assert value(one, T.tokens(F.lit("Favourite favorite HUE it's"))) == ["favorite", "likes", "color", "it's"]
    assert value(one, T.tokens(F.lit("x"), boundaries=True)) == ["<bos>", "x", "<eos>"]


def test_ngrams(one):
    words = arr("string", "a", "b", "c")
    assert value(one, T.word_ngrams(words, 2)) == ["w2:a_b", "w2:b_c"]
    assert value(one, T.word_ngrams(words, 4)) == []
    assert value(one, T.char_ngrams(words, 4)) == ["c4:a b ", "c4: b c"]


def test_chunks(one):
    got = value(one, T.char_chunks(F.lit("0123456789" * 4), 20, 5))
    assert [(c["start"], c["end"]) for c in got] == [(0, 20), (15, 35), (30, 40)]
    assert [tuple(c) for c in value(one, T.char_chunks(F.lit(""), 20, 5))] == [(0, 0, "")]
    assert [c["chunk"] for c in value(one, T.word_chunks(F.lit(" a  b c "), 2, 1))] == ["a b", "b c", "c"]
    with pytest.raises(ValueError):
        T.char_chunks(F.lit("x"), 5, 5)


def test_answers(one):
    assert value(one, T.normalize_answer(F.lit("The  Cat's, a hat éa!"))) == "cats hat éa"
    assert value(one, T.normalize_answer(F.lit("the"))) == ""


def test_blake_and_md5_buckets(spark):
    df = spark.createDataFrame([("w1:a",)], "name string")
    got = df.select(E.blake_hash(0)(1 << 16)("name").alias("h"), T.md5_bucket(F.col("name"), 97).alias("b")).first()
    assert 0 <= got.h.bucket < 1 << 16 and got.h.sign in (-1.0, 1.0) and 0 <= got.b < 97


def test_hash_codes_modes_have_unit_length(spark):
    df = spark.createDataFrame([(1, "one two two three"), (2, "")], "id long, text string")
    for mode in ("md5", "blake2b"):
        got = E.hash_codes(E.text_features(df, "id", "text"), "id", 256, 3, hash_mode=mode, signed=mode == "blake2b", positive_only=False).collect()
        assert {r.id for r in got} == {1} and len(got) == 3 and sum(r.w**2 for r in got) == pytest.approx(1)


def test_time_features_keep_the_local_time(one):
    raw = F.lit("2024-02-05T23:10:00+09:00")
    assert value(one, E.time_features(E.iso_local_time(raw), raw)) == ["time:year:2024", "time:month:2024-02", "time:weekday:0", "time:hour:23"]
    odd = F.lit("yesterday")
    assert value(one, E.time_features(E.iso_local_time(odd), odd)) == ["time:raw:yesterday"]


def test_number_features(one):
    assert value(one, E.number_features("k", F.lit(-1234.5678))) == ["k:num:neg:1e3", "k:num_rounded:-1234.568"]
    assert value(one, E.number_features("k", F.lit(float("nan")))) == ["k:nan"]
    assert value(one, E.number_features("k", F.lit(None).cast("double"))) == []


def test_a_code_is_sorted_once_and_not_for_each_entry():
    made = str(V.from_dense(F.col("embedding"), 8))
    assert made.count("array_sort") <= 2


def test_codes_of_texts_are_counted_where_their_text_is(spark):
    """One exchange, of texts: neither counts nor sums by key move a feature again."""
    texts = spark.createDataFrame([(k, f"red blue {k} red") for k in range(9)], "id long, text string")
    codes = E.hash_codes(E.text_features(texts, "id", "text"), "id", 256, 3)
    assert codes._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert codes.groupBy("id").count().filter("count = 3").count() == 9
