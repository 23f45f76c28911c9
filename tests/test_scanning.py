"""Many terms in texts against trying each, and profiles read without a model."""

import random
import re

import pytest

from tessera.operators import resumes
from tessera.operators.scanning import occurrences


@pytest.mark.parametrize("whole_words", [True, False])
@pytest.mark.parametrize("sent", [10_000, 5])
def test_occurrences_are_those_of_each_term(spark, whole_words, sent):
    r = random.Random(4)
    terms = ["a", "ab", "b a", "c++", "é", ".net", "aba", "", None, "zz", "a"]
    texts = [(i, "".join(r.choice("abcé+. zn_et") for _ in range(r.randint(0, 60)))) for i in range(80)] + [(100, None), (101, ""), (102, "use c++, .net and x.net"), (None, "ab ab")]
    got = occurrences(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame([(t,) for t in terms], "term string"), "term", whole_words, sent, 300)
    want = sorted(((i, t) for i, x in texts if x is not None for t in {*terms} - {None} if (re.search(rf"\b{re.escape(t)}\b", x) and t if whole_words else t in x)), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_nothing_to_look_for_or_in(spark):
    texts, terms = spark.createDataFrame([(1, "x")], "id long, t string"), spark.createDataFrame([("x",)], "term string")
    assert occurrences(texts, "id", "t", terms.where("false"), "term", False).count() == 0 and occurrences(texts.where("false"), "id", "t", terms, "term", False).count() == 0


def test_profiles_without_a_model(spark):
    rows = [(1, "jane@x.org\n  Jane Q. O'Neil-Smith \nPython, Reinforcement Learning with ROS2"), (2, None), (3, "one two three four five six\nGit"), (4, "Ann\r\nBob"), (5, "")]
    got = {r.id: (r.full_name, r.skills, r.roles) for r in resumes.fallback_profiles(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got[1] == ("Jane Q. O'Neil-Smith", ["Python", "C", "ROS2"], ["Autonomous Systems Engineer", "Software Developer", "Researcher"])
    assert got[2] == (None, [], ["Software Developer"]) == got[5] and got[3] == ("Git", ["Git"], ["Software Developer"]) and got[4][0] == "Ann"
