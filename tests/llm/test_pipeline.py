"""The pipeline's stages on a small corpus, each against what it should do."""

import random

import pytest

pytest.importorskip("tessera.llm")

import corpus_pipeline as P
from tokenizers import Tokenizer as Library

DDL = "doc_id long, text string, lang string, source string, n_chars long"
TONGUES = {"en": "the and of to with house water bread night morning people walking river stone".split(), "de": "der und von mit das haus wasser brot nacht morgen leute gehen fluss stein".split()}


def test_stages_keep_clean_documents(spark, tmp_path):
    r = random.Random(8)

    def text(lang, n=60):
        return " ".join(r.choice(TONGUES[lang]) + str(r.randint(0, 9)) for _ in range(n))

    rows = [(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de", f"s{i % 3}", None) for i in range(60)]
    copy, near = (100, rows[7][1], "en", "s0", None), (101, rows[8][1].replace(" ", " ", 1) + " end", "de", "s1", None)
    odd = [(102, None, None, None, None), (103, "123 456", "en", "s0", 7), (104, "", "en", "s0", 0), (105, rows[9][1] + " extra words here so that it differs password = abcdefghijklmnop", "en", None, 1), (None, text("de"), None, "s2", None)]
    docs = spark.createDataFrame([*rows, copy, near, *odd], DDL)
    d, kept = docs, {}
    for name, stage in P.STAGES:
        out = stage(spark, d, "")
        out.write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = d
        if name != "bpe_codec":
            assert d.columns == docs.columns
    ids = {n: [x.doc_id for x in f.collect()] for n, f in kept.items()}
    assert set(range(60)) <= set(ids["language_id"]) and not {102, 103, 104} & set(ids["language_id"])
    assert {101, 100} & set(ids["simhash_near_dedup"]) == set() and {i for i in range(60)} <= set(ids["simhash_near_dedup"])
    assert sorted(map(str, ids["secret_scan"])) == sorted(map(str, ids["simhash_near_dedup"])) == sorted(map(str, ids["pfair_mixing"])) == sorted(map(str, ids["bpe_codec"]))
    texts = {x.doc_id: x for x in kept["pfair_mixing"].collect()}
    assert all("password = abcdef" not in x.text for x in texts.values()) and all(texts[i].text == rows[i][1] for i in range(60) if i in texts)
    library = Library.from_file(P.VOCABULARY)
    assert all(x.ids == library.encode(texts[x.doc_id].text, add_special_tokens=False).ids for x in kept["bpe_codec"].collect())


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


NAMES = ["lang_pred", "score", "__text", "row", "blob", "spans", "mix", "key", "bucket", "order", "id", "nth", "at", "block", "share", "slot", "__id", "__version", "version", "node", "fresh", "rules", "label", "size", "c0", "text_u", "k_id"]


@pytest.mark.parametrize("name, stage", P.STAGES[:-1])
def test_columns_of_any_name_keep_their_values(spark, name, stage):
    rows = [(i, " ".join(TONGUES["en" if i % 2 else "de"][(i * 7 + j * j) % 12] for j in range(40)) + f" own{i} token=abcdefghijklmnop", "en" if i % 2 else "de", "s", 1) for i in range(8)]
    docs = spark.createDataFrame(rows, DDL).selectExpr("*", *[f"concat('{n}-', doc_id) AS `{n}`" for n in NAMES])
    got = stage(spark, docs, "")
    assert got.columns == docs.columns
    for r in got.collect():
        assert all(r[n] == f"{n}-{r.doc_id}" for n in NAMES)
