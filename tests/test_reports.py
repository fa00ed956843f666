import pytest
from pyspark.sql import functions as F

from quarry.functions.classify import classify_failure, classify_query, efficiency_text, version_matches
from quarry.operators import answers as A
from quarry.operators import relevance as M


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "q,want",
    [
        ("v1.2 and v1.2", "Comparison Query"), ("address 1.2.3.4", "Comparison Query"), ("a different thing", "Comparison Query"), ("the history of it in v1.2", "Cross-Version Query"), ("in v5.3.1 only", "Version-Specific Query"), ("the release", "Version-Specific Query"),
        ("what was fixed", "Feature/Change Query"), ("upgrade now", "Feature/Change Query"), ("how do I open it", "General Fact Query"), (None, "General Fact Query"), ("v1.2\nv1.3", "Version-Specific Query"),
    ],
)
def test_query_classes(spark, q, want):
    assert one(spark, classify_query(F.col("q")), q=q) == want


@pytest.mark.parametrize(
    "q,expected,got,n,leak,wrong,want",
    [
        ("x", "v1", "none", 0, False, False, "No Relevant Chunk Retrieved"), ("x", "v1", "v1, v2", 5, False, True, "Retrieval Correct but LLM Answer Incorrect"), ("x", "v1", "v2", 5, False, True, "Wrong Version Retrieved"), ("x", "v1", "v1", 5, True, False, "Wrong Version Retrieved"),
        ("x", "v1", "v1", 3, False, False, "Ambiguous Query"), ("the release", "v1", "v1", 3, False, False, "Sparse Coverage"), ("x", "v1", "v1", 5, False, False, "Ambiguous Query"), ("the release", "v1", " v1", 5, False, False, "Wrong Chunk Retrieved"),
    ],
)
def test_failure_classes(spark, q, expected, got, n, leak, wrong, want):
    c = classify_failure(*map(F.col, ("q", "e", "g", "n", "leak", "wrong")))
    row = one(spark, c, q=q, e=expected, g=got, n=n, leak=leak, wrong=wrong)
    assert row["failure_category"] == want and row["notes"]


def test_issue_gate(spark):
    rows = [(1, "the release", "v1", "v2", 5, False), (2, "the release", "v1", "v1", 4, False), (3, "x", "v1", "none", 0, False), (4, "x", "v1", "v2", 5, True)]
    facts = spark.createDataFrame(rows, "query_id int, query string, expected_version string, retrieved_version string, retrieved_chunks int, temporal_leak boolean")
    assert {r.query_id: r.failure_category for r in M.issues(facts).collect()} == {2: "Sparse Coverage", 3: "No Relevant Chunk Retrieved", 4: "Wrong Version Retrieved"}


def test_version_matches(spark):
    for got, want in (("v1, v2", True), ("v12", False), ("", False), ("none", False), (None, False)):
        assert one(spark, version_matches(F.lit("v1"), F.col("g")), g=got) is want


def test_word_metrics(spark):
    f = lambda a, c: one(spark, M.faithfulness(F.col("a"), F.col("c")), a=a, c=c)
    assert f("I don't know", "") == 1.0 and f("based film", "x") == 1.0 and f("alpha beta9", "the alphabet") == 0.5 and f(None, "x") == 1.0
    assert one(spark, M.context_recall(F.col("a"), F.col("c")), a="directed words", c="no") == 0.0
    n = lambda a, q, r, z: one(spark, M.noise_sensitivity(*map(F.col, "aqrz")), a=a, q=q, r=r, z=z)
    assert n("noise word", "", ["clean word"], ["noise text"]) == 0.5
    assert n("noise word", "noise", ["clean word"], ["noise text"]) == 0.0 and n("x", "", [], ["noise"]) == 0.0 and n("noise", "", ["clean"], []) == 0.0
    assert one(spark, M.robustness(F.col("a"), F.col("b")), a=["1", "2"], b=["2", "3"]) == pytest.approx(1 / 3) and one(spark, M.robustness(F.col("a"), F.col("b")), a=[], b=[]) == 1.0


def test_average_precision_and_latency(spark):
    flags = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False)], "query_id int, rank int, fits boolean")
    assert {r.query_id: round(r.ap, 6) for r in M.average_precision(flags).collect()} == {1: round((1 + 2 / 3) / 2, 6), 2: 0.0}
    values = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    r = M.latency("v")(values).first()
    assert (r.p50, r.mean, r.min, r.max, r.n) == (2.5, 4.0, 1.0, 10.0, 4)
    z = M.latency("v")(values.limit(0)).first()
    assert (z.p50, z.p99, z["mean"], z.n) == (0.0, 0.0, 0.0, 0)
    assert M.leakage_rate(spark.createDataFrame([], "query_id int, leak boolean")).first()["leakage_rate"] == 0.0


def test_keyword_metrics(spark):
    rows = spark.createDataFrame([(1, 1, "has Key", "key"), (1, 2, "none", "key"), (2, 1, "x", "")], "query_id int, rank int, document string, keyword string")
    got = {r.query_id: tuple(r)[1:] for r in M.keyword_metrics(rows, spark.createDataFrame([(1, 4)], "query_id int, relevant int")).collect()}
    assert got == {1: (True, 0.5, 0.25, 1.0), 2: (True, 1.0, 1.0, 1.0)}


def test_answers(spark):
    docs = spark.createDataFrame([(1, [(2, "second line\nwith the needle in it", "v2"), (1, "first", "v1")])], "q int, docs array<struct<rank:int,text:string,version:string>>")
    said = docs.select(A.context(F.col("docs")).alias("a"), A.context(F.col("docs"), True).alias("b"), A.answer(F.lit("Where is the needle?"), F.col("docs")).alias("c")).first()
    assert said.a == "- Document [1]: first\n- Document [2]: second line\nwith the needle in it\n" and "- Document [1] (Version v1): first\n" in said.b
    assert said.c == "Synthesized answer: with the needle in it"
    ask = lambda q, t: one(spark, A.extract_answer(F.col("q"), F.col("t")), q=q, t=t)
    assert ask("movie directed by whom", "Title: A. Directors: B. Year: 1 movie") == "Based on the context, Directors: B."
    assert ask("who is in the cast", "Title: A. Cast: X, Y. Year") == "The movie features cast members: X, Y."
    assert ask("zzzz", "- first line\nsecond") == "Synthesized answer: first line" and ask("x", " \n-") == A.NOT_FOUND and ask("xxxx", None) == A.NOT_FOUND


def test_parsers(spark):
    s = lambda r: one(spark, A.parse_score(F.col("r")), r=r)
    assert [s('ok {"score": 0.25} x'), s("about 0.7 or 1"), s("1.0!"), s("none"), s('{"score": "bad"} 0'), s("12")] == [0.25, 0.7, 1.0, 0.5, 0.0, 0.5]
    f = lambda r: one(spark, A.parse_flags(F.col("r"), 3), r=r)
    assert f('{"relevance": [true, false, true, true]}') == [True, False, True] and f("Yes\nwell\nno") == [True, False, False] and f("") == [False] * 3


def test_texts(spark):
    assert [one(spark, efficiency_text(F.col("r").cast("double") / 10), r=r).split(" ")[0] for r in (1, 3, 9)] == ["Highly", "Moderate", "Low"]
    assert one(spark, M.blend(F.col("r").cast("double"), F.lit(0.5)), r=1) == 0.75
