"""The stemmer against published examples, and the search against brute force."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.stemming import STOP_WORDS, stem, term
from tessera.operators import search
from tessera.plans.catalogue import ORACLE_SQL, QUERIES

# Words and stems of the published examples.
STEMS = """consigned consign consignment consign consistency consist consolation consol knackeries knackeri knaves knave knightly knight knees knee generate generat general general communism communism skies sky dying die early earli inning inning
proceed proceed hopping hop hoping hope national nation rational ration relational relat happy happi cry cri by by say say agreed agre feed feed plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
tanned tan falling fall hissing hiss filing file conditional condit digitizer digit operator oper decisiveness decis hopefulness hope callousness callous triplicate triplic formative format electrical electr goodness good revival reviv
allowance allow airliner airlin adjustable adjust defensible defens replacement replac adoption adopt effective effect probate probat rate rate cease ceas controlling control roll roll engineering engin ties tie cries cri gas gas this this
gaps gap caresses caress ponies poni beautiful beauti organization organ analogies analog boy's boy youth youth""".split()


@pytest.mark.parametrize("word, want", list(zip(STEMS[::2], STEMS[1::2])))
def test_stems(word, want):
    assert stem(word) == want


def covers(alternative, words):
    """Summed weights of all minimal stretches that hold every term, by trying each stretch."""
    has = lambda a, b: set(alternative) <= set(words[a : b + 1])
    n = len(words)
    spans = [(a, b) for a in range(n) for b in range(a, n) if has(a, b) and not (a < b and (has(a + 1, b) or has(a, b - 1)))]
    return sum(0.1 / (1 + b - a - (len(alternative) - 1)) for a, b in spans)


def test_ranks_are_brute_force(spark):
    r = random.Random(6)
    vocabulary = ["running", "runs", "happy", "happiness", "dog", "dogs", "the", "of", "quick", "Café"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 25)))) for i in range(60)] + [(60, None), (61, ""), (62, "the of the")]
    asked = [(1, ["run", "dog"]), (2, ["happy dog"]), (3, ["running dogs quick", "café", "cafés"]), (4, ["the"]), (5, []), (6, ["dog", "dogs"])]
    wanted = search.query_terms(spark.createDataFrame(asked, "q int, words array<string>"), "q", "words")
    ranked = search.matches(search.index(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", "text"), wanted)
    got = {(x.query, x.id): x.rank for x in ranked.collect()}
    of = lambda t: [term(w) for w in re.findall(r"\w+", t.lower())]
    want = {}
    for q, alternatives in asked:
        own = {tuple(sorted({x for x in of(a) if x})) for a in alternatives} - {()}
        for i, text in rows:
            if (score := round(sum(covers(a, of(text or "")) for a in own), 6)) > 0:
                want[q, i] = score
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want) and len({q for q, _ in want}) == 4
    paged = search.page(ranked, [F.desc("id")], 3, 4).collect()
    for q in {1, 2, 3, 6}:
        order = sorted((k for k in got if k[0] == q), key=lambda k: (-got[k], -k[1]))
        assert [(x.query, x.id) for x in sorted(paged, key=lambda x: x.place) if x.query == q] == order[3:7]


def test_stop_words_are_no_terms():
    assert term("the") is None and term("engine") == "engin" and len(STOP_WORDS) == 127


def test_forms_whose_stem_is_another(spark, tmp_path):
    """Words of one stem that are no forms, and forms of another stem, are told apart as the SQL tells them."""
    import duckdb

    ends = ["", "e", "s", "es", "ed", "eds", "edly", "ing", "ings", "ingly", "ly", "lye", "lyes", "lys", "lyed", "lying", "lyings", "lyedly", "lies", "ful", "fulness", "ness", "er"]
    rows = [(i, f"{w}{e} and {['', 'handlyes', 'Rested', 'handful'][i % 4]}") for i, (w, e) in enumerate((w, e) for w in ("thing", "hand", "rest") for e in ends)] + [(900, "restful handful"), (901, None), (902, "a restlye handlye")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["q_fts_match"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(con.sql(ORACLE_SQL["q_fts_match"]).fetchall())


def test_an_index_for_given_searches_finds_the_same(spark):
    docs = spark.createDataFrame([(i, f"running dogs {i % 3} quick " * (i % 4)) for i in range(20)], "id long, text string")
    wanted = search.query_terms(spark.createDataFrame([(1, ["run dog", "quick"])], "q int, words array<string>"), "q", "words")
    whole, own = (sorted(map(tuple, search.matches(x, wanted).collect())) for x in (search.index(docs, "id", "text"), search.index(docs, "id", "text", wanted)))
    assert whole == own and len(own) == 15


def test_for_given_searches_each_word_is_stemmed_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"running dogs {i % 3} quick " * 50) for i in range(40)], "id long, text string")
    wanted = search.query_terms(spark.createDataFrame([(1, ["run dog", "quick"])], "q int, words array<string>"), "q", "words").localCheckpoint()
    whole = sorted(map(tuple, search.matches(search.index(docs, "id", "text"), wanted).collect()))
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(word: pd.Series) -> pd.Series:
        seen.add(len(word))
        return word.map(term)

    monkeypatch.setattr(search, "term_of", counted.asNondeterministic())
    assert sorted(map(tuple, search.matches(search.index(docs, "id", "text", wanted), wanted).collect())) == whole and len(whole) == 40
    assert 0 < seen.value <= 6
