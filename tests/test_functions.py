from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from watchloom.functions import dates, similarity, text
from watchloom.operators import decide, resolve, rules

WORDS = st.text(alphabet="abc ", max_size=12)


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x")).first()["x"]


@given(WORDS, WORDS)
@settings(max_examples=200, deadline=None)
def test_ratio_properties(a, b):
    r = similarity._ratio(a, b)
    assert r == similarity._ratio(b, a) and 0 <= r <= 100 and similarity._ratio(a, a) == 100
    assert similarity._token_sort(a, b) == similarity._token_sort(" ".join(reversed(a.split())), b)
    assert 0 <= similarity.weighted_ratio(a, b) <= 100


@given(WORDS, WORDS)
@settings(max_examples=100, deadline=None)
def test_bit_parallel_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert similarity._lcs(a, b) == t[-1][-1]


def test_expressions_equal_kernel(spark):
    data = [("john smith", "smith jon"), ("", "a"), ("a b", "a b c"), ("x", "y"), ("ali reza", "reza")]
    df = spark.createDataFrame(data, "a string, b string")
    got = df.select(similarity.token_sort_ratio(F.col("a"), F.col("b")).alias("s"), similarity.token_set_ratio(F.col("a"), F.col("b")).alias("t")).collect()
    for (a, b), r in zip(data, got):
        assert abs(r["s"] - similarity._token_sort(a, b)) < 1e-9 and abs(r["t"] - similarity._token_set(a, b)) < 1e-9


def test_normalize_name(spark):
    df = spark.createDataFrame([("Dr. José  O'Neil-Smith, Jr",), ("Haji al",), (None,), ("",)], "n string")
    assert [r["x"] for r in df.select(text.normalize_name(F.col("n")).alias("x")).collect()] == ["jose oneil smith jr", "", None, ""]


def test_metaphone_words():
    assert [text.metaphone_word(w) for w in ("Philip", "Knight", "Thomas", "", "123")] == ["FLP", "NT", "0MS", "", ""]


def test_birth_years(spark):
    for given_, want in ((["1985-03-12"], [1985]), (["circa 1970"], []), (["2003-08-31", "1990"], [2003, 1990]), (["not a date"], [])):
        assert one(spark, dates.birth_years(F.array(*[F.lit(x) for x in given_]))) == want


def test_impossible_age(spark):
    def f(y, listed):
        return one(spark, dates.impossible_age(F.array(*[F.lit(x) for x in y]).cast("array<int>"), F.lit(listed).cast("string")))

    assert f([2003], "2001-10-17") and not f([1970], "2001-10-17") and not f([1985], "2001-10-17") and not f([], "2001") and not f([2003], None)


def test_cascade_order(spark):
    def f(ids, gender, gap, imp):
        return one(spark, rules.route(F.lit(ids), F.lit(gender), F.lit(gap).cast("int"), F.lit(imp)))

    assert [f(True, True, 20, True), f(False, True, 20, True), f(False, False, 11, True), f(False, False, 10, True), f(False, False, None, False)] == ["id", "gender", "dob", "temporal", "review"]


def test_registry_dates(spark):
    df = spark.createDataFrame([("1970-2-3",), ("3-2-1970",), ("Feb-70",), ("1970",), ("31801",), ("x",), (None,)], "d string")
    assert [r["x"] for r in df.select(dates.registry_date(F.col("d")).alias("x")).collect()][:2] == ["1970-02-03", "1970-02-03"]


def test_guards(spark):
    df = spark.createDataFrame([("CLEARED", "needs human review"), ("CLEARED", "all differs"), ("LIKELY_MATCH", "escalate"), ("CLEARED", None)], "v string, r string")
    assert [r["x"] for r in df.select(decide.doubt_guard(F.col("v"), F.col("r")).alias("x")).collect()] == ["ESCALATE", "CLEARED", "LIKELY_MATCH", "CLEARED"]
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    f = lambda src, dob: one(spark, decide.no_data_guard(F.lit("CLEARED"), arr(src), arr(*dob), arr(), arr("")))
    assert [f("ofac_sdn", []), f("ofac_sdn", ["1970"]), f("wikidata_peps", [])] == ["ESCALATE", "CLEARED", "CLEARED"]


def test_decisions_fail_safe(spark):
    assert decide.read_decisions('```json\n[{"match_number": 1, "verdict": "cleared"}]\n```', [1, 2]) == [(1, "CLEARED", ""), (2, "ESCALATE", "no readable decision")]
    assert decide.read_decisions("garbage", [3]) == [(3, "ESCALATE", "no readable decision")]
    df = spark.createDataFrame([("s", i) for i in range(1, 31)], "screening_id string, match_number int")

    def broken(rows):
        if rows[0]["match_number"] > 25:
            raise RuntimeError
        return '[{"match_number": 1, "verdict": "LIKELY_MATCH", "reasoning": "r"}]'

    got = {r["match_number"]: r["verdict"] for r in decide.classify(df, broken).collect()}
    assert len(got) == 30 and got[1] == "LIKELY_MATCH" and {got[i] for i in range(2, 31)} == {"ESCALATE"}
    second = spark.createDataFrame([("s", 3, "CLEARED", "x")], "screening_id string, match_number int, verdict string, reasoning string")
    final = {r["match_number"]: r["verdict"] for r in decide.override(decide.classify(df), second, ["screening_id", "match_number"]).collect()}
    assert final[3] == "CLEARED" and final[7] == "ESCALATE"


def test_guarded_identifiers(spark):
    df = spark.createDataFrame([('[{"type":"P","value":" A1 ","country":""}]',), ("[]",), (None,), ("{broken",)], "j string")
    got = [r["x"] for r in df.select(resolve.id_keys(resolve.id_list(F.col("j"))).alias("x")).collect()]
    assert got == [["p:a1"], [], [], []]
