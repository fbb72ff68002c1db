import pytest
from pyspark.sql import functions as F

from veritrail.functions import ids as I
from veritrail.functions import replies as R
from veritrail.functions import text as X


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int")
    return rows.select(column.alias("v")).head()["v"]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("What came last week?", "last week"), ("Who is it now?", "now"), ("What changed recently?", "recently"), ("two years ago it was so", "two years ago"), ("the LATEST plan", "LATEST"), ("so far so good", "so far"),
        ("at the moment", "at the moment"), ("a lasting knowledge", None), ("nowhere to go", None), ("the weekly plan", None), ("in 1999", None), ("", None),
    ],
)
def test_relative_time(spark, text, found):
    assert one(spark, X.relative_time("t"), t=text) == found


def test_tokens(spark):
    assert one(spark, X.tokens_numeric("t"), t="Costs 1,240 and 2.40 for glasses, buses and the bus") == ["cost", "1,240", "and", "2.40", "for", "glasse", "buse", "and", "the", "bus"]
    assert one(spark, X.content_tokens("t"), t="Does the mill have wheels? The wheels!") == ["mill", "wheel"]
    assert one(spark, X.bigrams("t"), t="a b a b") == ["a b", "b a"]
    assert one(spark, X.bigrams("t"), t="a") == []


def test_text_match(spark):
    text = " ".join(f"w{i}" for i in range(40))
    half = " ".join(text.split()[:20])
    assert one(spark, X.text_match("a", "b"), a=text, b=text) == 1.0
    assert one(spark, X.text_match("a", "b"), a=text, b=half) >= 0.9
    assert one(spark, X.text_match("a", "b"), a=text, b="w1 w2 w3") < 0.5
    assert one(spark, X.text_match("a", "b"), a=text, b="") == 0.0


def test_name_tokens(spark):
    text = "# Big Heading\nAlways the Redwatch Protocol is used by\nThistle staff. Some think the redwatch works; the Thistle team\n- Items start here with Orla"
    assert set(one(spark, X.name_tokens("t"), t=text)) == {"protocol", "thistle", "orla"}


def test_lexical_overlap(spark):
    assert one(spark, X.lexical_overlap("q", "s"), q="the of and", s="anything") == 0.0
    assert one(spark, X.lexical_overlap("q", "s"), q="mill river", s="the mill stands") == 0.5


def test_facts_and_problems(spark):
    assert one(spark, X.is_usable_fact("f", "a"), f="The mill has 12 wheels", a="12") is True
    for fact, answer in (("12 wheels", "12"), ("The mill has 120 wheels", "12"), ("a b c", "A b c."), ("The mill has wheels", ""), ("a (b c d", "(b")):
        assert one(spark, X.is_usable_fact("f", "a"), f=fact, a=answer) is (answer == "(b"), (fact, answer)
    assert one(spark, X.question_problem("q", "s"), q="What does the passage say?", s="x") == "refers_to_passage"
    assert one(spark, X.question_problem("q", "s"), q="a\nb", s="x") == "several_lines"
    assert one(spark, X.question_problem("q", "s"), q="Что это", s="what") == "foreign_script"
    assert one(spark, X.question_problem("q", "s"), q="What is it?", s="what") is None


def test_sentences_keep_digits(spark):
    assert one(spark, X.sentences("t"), t="0997 | a\n 1219 b. x1 \n# 2\n3 c 3\n4") == ["0997 | a 1219 b. x1 3 c 3 4"]
    assert one(spark, X.sentences("t"), t="0\n1\n") == ["0 1"]
    assert one(spark, X.sentences("t"), t="One.\n   \n  # no\n  Two! ") == ["One.", "Two!"]


def test_split_share(spark):
    rows = spark.range(10_000).select(I.split_of(F.concat(F.lit("c"), F.col("id"))).alias("s"))
    assert 0.68 < rows.where("s = 'dev'").count() / 10_000 < 0.72


@pytest.mark.parametrize(
    ("reply", "expected"),
    [
        ('{"is_correct": true, "score": 0.5, "rationale": "r"}', (True, 0.5, "r")), ('{"is_correct": false}', (False, None, None)), ('{"is_correct": true, "score": true}', (True, 1.0, None)),
        ('{"is_correct": "true"}', None), ('{"is_correct": 1}', None), ('{"is_correct": true, "score": "high"}', None), ('{"is_correct": true, "rationale": 3}', None), ("[1]", None), ("no", None), ("", None),
    ],
)
def test_strict_judgement(spark, reply, expected):
    got = one(spark, R.parse_correctness("t"), t=reply)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize("reply", ['{"question": "x"}', '```json\n{"question": "x"}\n```', 'Sure! {"question": "x"} ok', '{"question": "x"', 'Well: {"question": "x", "more": [1, {"a": 2'])
def test_lenient_object(spark, reply):
    assert one(spark, F.try_variant_get(R.json_object("t"), "$.question", "string"), t=reply) == "x"


def test_lenient_object_fails(spark):
    assert one(spark, R.json_object("t").isNull(), t='{"question": "cut') is True


def test_facts_reply(spark):
    got = one(spark, R.parse_facts("t"), t='{"facts": [{"fact": "The mill has 12 wheels", "answer": 12}, {"fact": "12", "answer": "12"}, 3]}')
    assert [tuple(x) for x in got] == [("The mill has 12 wheels", "12")]
    assert one(spark, R.parse_facts("t"), t='{"facts": []}') == []
    assert one(spark, R.parse_facts("t"), t='{"facts": 1}') is None


def test_config_hash():
    base = I.config_hash({"a": 1, "b": 2}, "x", "m", 5)
    assert base == I.config_hash({"b": 2, "a": 1}, "x", "m", 5)
    assert len({base, I.config_hash({"a": 1}, "x", "m", 5), I.config_hash({"a": 1, "b": 2}, "x", "m", 4), I.config_hash({"a": 1, "b": 2}, "x", "m", 5, 0.5)}) == 4
