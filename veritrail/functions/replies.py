"""Replies of language models: lenient and strict JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column, is_usable_fact


def _closed(text: Column) -> Column:
    """The text with the brackets closed that it leaves open; null if it ends inside a string."""
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))
    state = lambda o, q, e: F.struct(o.alias("open"), q.alias("quoted"), e.alias("escaped"))

    def step(s: Column, c: Column) -> Column:
        plain = ~s["quoted"]
        return (
            F.when(s["escaped"], state(s["open"], s["quoted"], F.lit(False)))
            .when(s["quoted"] & (c == "\\"), state(s["open"], s["quoted"], F.lit(True)))
            .when(c == '"', state(s["open"], plain, F.lit(False)))
            .when(plain & (c == "{"), state(F.concat(F.lit("}"), s["open"]), F.lit(False), F.lit(False)))
            .when(plain & (c == "["), state(F.concat(F.lit("]"), s["open"]), F.lit(False), F.lit(False)))
            .when(plain & c.isin("}", "]"), state(F.substring(s["open"], F.lit(2), F.length(s["open"])), F.lit(False), F.lit(False)))
            .otherwise(s)
        )

    return F.aggregate(F.split(text, ""), start, step, lambda s: F.when(~s["quoted"], F.concat(text, s["open"])))


def _object(text: Column) -> Column:
    """The text as a variant if it is a JSON object; raw control characters in it count as spaces."""
    value = F.try_parse_json(F.regexp_replace(text, r"[\x00-\x1f]", " "))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def json_object(reply: Column | str) -> Column:
    """One object from a reply: as it is, from the first to the last brace, or with brackets closed; of a reply with a fence what is inside."""
    whole = F.trim(column(reply))
    fenced = F.regexp_extract(whole, r"(?s)```(?:json)?\s*(.*?)```", 1)
    text = F.when(F.regexp_like(whole, F.lit(r"(?s).*```(?:json)?\s*.*?```.*")), F.trim(fenced)).otherwise(whole)
    from_brace = F.regexp_extract(text, r"(?s)(\{.*)", 1)
    whole = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    tail = _closed(F.nullif(F.regexp_replace(from_brace, r"\s*```\s*$", ""), F.lit("")))
    return F.coalesce(*(_object(F.nullif(c, F.lit(""))) for c in (text, whole, tail)))


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def parse_judgement(reply: Column | str, flag: str) -> Column:
    """``flag, score, rationale`` of a strict JSON reply; null as a whole if a part has the wrong type.

    The flag must be a JSON boolean, the score a number, a boolean or null, the rationale a
    string or null.
    """
    value = F.try_parse_json(F.trim(column(reply)))
    kind_ok = F.schema_of_variant(value).startswith("OBJECT") & (_kind(value, f"$.{flag}") == "BOOLEAN")
    score_kind, text_kind = F.coalesce(_kind(value, "$.score"), F.lit("VOID")), F.coalesce(_kind(value, "$.rationale"), F.lit("VOID"))
    score_ok = score_kind.isin("VOID", "BOOLEAN", "BIGINT", "DOUBLE", "FLOAT") | score_kind.startswith("DECIMAL")
    score = F.when(score_kind == "BOOLEAN", F.try_variant_get(value, "$.score", "boolean").cast("double")).otherwise(F.try_variant_get(value, "$.score", "double"))
    out = F.struct(F.try_variant_get(value, f"$.{flag}", "boolean").alias(flag), score.alias("score"), F.when(text_kind == "STRING", F.try_variant_get(value, "$.rationale", "string")).alias("rationale"))
    return F.when(kind_ok & score_ok & text_kind.isin("VOID", "STRING"), out)


def parse_correctness(reply: Column | str) -> Column:
    return parse_judgement(reply, "is_correct")


def parse_groundedness(reply: Column | str) -> Column:
    return parse_judgement(reply, "is_grounded")


def parse_verification(reply: Column | str) -> Column:
    """``supported, answerable, unambiguous``, all of them JSON booleans, else null."""
    value = json_object(reply)
    names = ("supported", "answerable", "unambiguous")
    ok = F.lit(True)
    for n in names:
        ok = ok & (_kind(value, f"$.{n}") == "BOOLEAN")
    return F.when(ok, F.struct(*(F.try_variant_get(value, f"$.{n}", "boolean").alias(n) for n in names)))


def parse_question(reply: Column | str) -> Column:
    """The question of an object, or a bare reply of one line."""
    value = json_object(reply)
    bare = F.trim(F.regexp_replace(F.trim(column(reply)), '^"+|"+$', ""))
    own = F.when(_kind(value, "$.question") == "STRING", F.nullif(F.trim(F.try_variant_get(value, "$.question", "string")), F.lit("")))
    return F.when(value.isNotNull(), own).otherwise(F.when((bare != "") & ~bare.startswith("{") & ~bare.contains("\n"), bare))


def _items(array: Column, kind: str) -> Column:
    """The members of a JSON array, each read by itself, so that a bad one spoils no other."""
    return F.transform(F.from_json(array, "array<string>"), lambda x: F.from_json(x, kind))


def parse_facts(reply: Column | str) -> Column:
    """``array<struct<fact, answer>>`` of usable facts; empty if none is, null if the reply is malformed."""
    value = json_object(reply)
    items = _items(F.try_variant_get(value, "$.facts", "string"), "struct<fact:string,answer:string>")
    good = F.filter(items, lambda i: i["fact"].isNotNull() & i["answer"].isNotNull() & is_usable_fact(i["fact"], i["answer"]))
    return F.when(F.schema_of_variant(F.try_variant_get(value, "$.facts", "variant")).startswith("ARRAY"), F.transform(good, lambda i: F.struct(F.trim(i["fact"]).alias("fact"), F.trim(i["answer"]).alias("answer"))))


def parse_questions(reply: Column | str) -> Column:
    """``array<struct<question, answer>>`` of a strict reply ``{"questions": [...]}`` without bad items; null if none is left."""
    value = F.try_parse_json(F.trim(column(reply)))
    items = _items(F.try_variant_get(value, "$.questions", "string"), "struct<question:string,answer:string>")
    good = F.filter(items, lambda i: (F.trim(i["question"]) != "") & (F.trim(i["answer"]) != ""))
    return F.when(F.size(good) > 0, F.transform(good, lambda i: F.struct(F.trim(i["question"]).alias("question"), F.trim(i["answer"]).alias("answer"))))
