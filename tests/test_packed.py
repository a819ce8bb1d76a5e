import pytest

from assayer.operators.packed import unpack

CASES = {
    None: [],
    "": [],
    " \n\t ": [],
    ";;|,": [],
    "a": ["a"],
    "a; b ;c;": ["a", "b", "c"],
    "a, b,c": ["a", "b", "c"],
    "a || b | c": ["a", "b", "c"],
    "a + b": ["a", "b"],
    "a+b": ["a+b"],
    "- a\n- b\r\n* c": ["a", "b", "c"],
    "1) a 2) b": ["a", "b"],
    "(1) a\n(2) b (x; y)": ["a", "b (x; y)"],
    "1. a\n2. b": ["a", "b"],
    "• a • b": ["a • b"],
    '"a; b"; c': ["a; b", "c"],
    "'a, b','c'": ["a, b", "c"],
    '["a \\u2014 b", "c\\"d"]': ["a — b", 'c"d'],
    "['it''s', \"it's\"]": ["it's", "it's"],
    "it's a; isn't b": ["it's a", "isn't b"],
    "One, Two, and Three; b": ["One, Two, and Three", "b"],
    "x (a, b), y": ["x (a, b)", "y"],
    "a \ue0000\ue001 b; c": ["a \ue0000\ue001 b", "c"],
    "a · b ~ c": ["a", "b", "c"],
}


def test_values_and_positions(spark):
    texts = list(CASES)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = unpack(df, "t", ["One, Two, and Three"]).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r.id == i), key=lambda r: r.pos)
        assert [r.value_text for r in own] == CASES[text], text
        assert [r.pos for r in own] == list(range(1, len(own) + 1))
        assert all(r.n_values == len(own) for r in own)


def test_clashing_columns_repeats_and_long_texts(spark):
    long = ";".join(f"v{i}" for i in range(20_000))
    df = spark.createDataFrame([(1, long, 7), (1, long, 7), (2, "a;b", None)], "pos int, t string, value_text int")
    out = unpack(df, "t")
    assert out.columns == ["t", "pos", "value_text", "n_values"]
    assert out.count() == 40_002
    assert unpack(df.limit(0), "t").count() == 0


@pytest.mark.parametrize("delimiter", [";", " | ", ", ", "\n"])
def test_round_trip(spark, delimiter):
    values = ["plain", "with 'inner' quote", "semi; colon", "comma, comma", "bar | bar"]
    packed = delimiter.join('"' + v + '"' for v in values)
    rows = unpack(spark.createDataFrame([(packed,)], "t string"), "t").orderBy("pos").collect()
    assert [r.value_text for r in rows] == values


@pytest.mark.parametrize("quote", ['"', "'"])
def test_quoted_fields_of_a_million_characters(spark, quote):
    n = 1_000_000
    plain, pairs, escaped = "a; " * (n // 3) + "b", f"a{quote}{quote};" * (n // 4) + "b", f"a\\{quote};" * (n // 4) + "b"
    texts = [f"{quote}{t}{quote}; c" for t in (plain, pairs, escaped)] + [quote + "a" * n, "x; " + quote + "a" * n + "; y", quote + f"a\\{quote}" * (n // 3), " " * n + "a; b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in unpack(df, "t").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.value_text)
    assert [len(got[i]) for i in range(7)] == [2, 2, 2, 1, 3, 1, 2]
    assert got[0] == [plain, "c"] and got[1][0] == pairs.replace(quote * 2, quote) and got[2][0] == escaped.replace("\\" + quote, quote)
    assert got[3] == texts[3:4] and got[4] == ["x", quote + "a" * n, "y"] and got[6] == ["a", "b"]
