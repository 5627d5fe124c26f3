"""Surrogates keep coreference, gender, script and format, stay distinct over all names, and always come to an end."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowbalance.llm.op8_private import draws, entities, replace_private
from tests.llm.helpers import CLASHES

SCHEMA = "doc_id long, text string"


def replaced(spark, *texts):
    rows = replace_private(spark.createDataFrame(list(enumerate(texts)), SCHEMA), "k").collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)]


def test_one_name_whatever_its_title(spark):
    (text,) = replaced(spark, "Dr Jane Smith met us. Ms Jane Smith left. Smith said no; Jane agreed. Janet stayed, Smith's dog and smith too.")
    m = re.fullmatch(r"Dr (\w+) (\w+) met us\. Ms (\w+) (\w+) left\. (\w+) said no; (\w+) agreed\. Janet stayed, (\w+)'s dog and smith too\.", text)
    jane, smith = {m[1], m[3], m[6]}, {m[2], m[4], m[5], m[7]}
    assert len(jane) == len(smith) == 1 and not jane & smith and not (jane | smith) & {"Jane", "Smith"}
    assert jane.pop().endswith("a")


def test_untitled_documents_are_left_alone(spark):
    text = "Jane Smith and O'Neil met in Paris, May 2024."
    assert replaced(spark, text, "Mr Smith") [0] == text


@pytest.mark.parametrize(("title", "name", "letters"), [
    ("Dr", "Παπαδόπουλος", "[Α-Ωα-ω]+"), ("Dr", "李明", "[一-鿿]{2}"), ("Господин", "Иванов", "[А-Яа-я]+"), ("Mr", "Smith", "[A-Za-z]+")])
def test_script_stays(spark, title, name, letters):
    (text,) = replaced(spark, f"{title} {name} came")
    found = text.split()[1]
    assert re.fullmatch(letters, found) and found != name


def test_format_stays(spark):
    mc, oneil, caps, ip = replaced(spark, "Mr McDonald", "Mr O'Neil", "Mr SMITH", "at 10.1.200.33 now")
    assert [k for k, c in enumerate(mc[3:]) if c.isupper()] == [0, 2] and "McDonald" not in mc
    assert oneil[4] == "'" and oneil[3].isupper() and oneil[5].isupper() and "Neil" not in oneil
    assert caps[3:].isupper() and caps != "Mr SMITH"
    assert [len(x) for x in ip.split()[1].split(".")] == [2, 1, 3, 2]


def test_all_names_are_one_kind_and_none_is_real(spark):
    syllables = [a + b for a in "bdfgk" for b in "aeiou"]
    names = [x.capitalize() + y + z for x in syllables for y in syllables[:8] for z in "nai"]
    texts = [f"{t} {n} {m}" for t, n, m in zip(["Mr", "Ms", "Dr"] * len(names), names, names[::-1], strict=False)]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    news = {r.doc_id: r.text for r in replace_private(df, "k").collect()}
    real, new = {}, {}
    for k, text in enumerate(texts):
        for old, now in zip(entities(text), entities(news[k]), strict=True):
            real[(old[2], old[3])] = now[3]
            new.setdefault(now[3], set()).add((old[2], old[3]))
    assert all(len(who) == 1 for who in new.values())
    assert not set(new) & {norm for _, norm in real}


def test_a_crowded_form_comes_to_an_end(spark):
    """More than half of all numbers of five digits are real, so most surrogates need a longer form."""
    numbers = [f"+{n // 10000} {n // 100 % 100:02d} {n % 100:02d}" for n in range(10_000, 70_000)]
    texts = [(k, "\n".join(numbers[k:k + 2000])) for k in range(0, len(numbers), 2000)]
    found = draws(spark.createDataFrame(texts, SCHEMA), "k")
    assert found.agg(F.count_distinct("norm"), F.max("attempt")).first()[0] == len(numbers)
    (text,) = [r.text for r in replace_private(spark.createDataFrame(texts[:1], SCHEMA), "k").collect()]
    assert len(set(text.split("\n"))) == 2000 and not set(text.split("\n")) & set(numbers[:2000])


def test_edges_with_entities(spark):
    mail = "x ann@example.org, 10.1.2.3"
    rows = [(None, mail), (None, mail), (None, "Mr Ann Bell"), (1, mail), (1, mail), (2, "Mr Smith@example.org"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in (*CLASHES, "same", "again", "family", "drawn")})
    for most in (200_000, 0):
        got = replace_private(df, "k", most).collect()
        counts = Counter((r.doc_id, r.n_entities) for r in got)
        assert counts == Counter({(None, 2): 3, (1, 2): 2, (2, 1): 1, (3, 0): 1, (4, 0): 1})
        assert len({r.text for r in got if r.text and r.text.startswith("x ")}) == 1
        assert [r.text for r in got if r.doc_id == 2][0].endswith(".org")
