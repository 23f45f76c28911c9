"""The main text of web pages: every block is labelled by a recurrent network that reads the whole page.

The network (``blstm``) learns from a sample of pages: the ``SAMPLE_PAGES`` distinct
ones of at most ``SAMPLE_CHARS`` characters whose hashes are the smallest.  Those that
mark their article (``article`` or ``main``) teach by themselves, and the paragraphs of
all of them are set ``RENDERED`` times in layouts of other kinds (``layouts``), since
most pages elsewhere mark theirs by other names or not at all.  It is fitted in one
task, for the sample is bounded, and sent to all tasks; its size is fixed.

A page's text is that of the blocks labelled as article, in page order, one a line.

Defined results: null and empty html give an empty text; what stands in scripts,
styles, templates and comments is no text; broken html is read as far as it goes, what
isn't closed ends with what holds it; repeated rows give one row each; no rows give
no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blstm, layouts
from tessera.llm.common import small_batches, texts_of

SAMPLE_PAGES, SAMPLE_CHARS = 200, 50_000
RENDERED = 10
#: Characters from which a block counts as a paragraph to render layouts with, where a page marks no article.
PARAGRAPH = 40
#: Blocks (with those that fill up shorter pages) that are labelled at once.
AT_ONCE = 20_000

_ARTICLE = {layouts._slot(f"in {x}", blstm.PATHS) for x in ("article", "main")}
_OTHER = {layouts._slot(f"in {x}", blstm.PATHS) for x in ("nav", "aside", "footer", "form", "ad", "ads", "advert", "comment", "comments", "sidebar", "promo", "notice")}


def lessons(htmls: list[str]) -> tuple[list[blstm.Page], list[np.ndarray]]:
    """Blocks of pages to learn from, with their labels: the given ones that mark their article, and rendered ones."""
    slots, pages, labels, articles, prose = layouts.Slots(), [], [], [], []

    def add(found, label):
        if found:
            pages.append(layouts.features(found, slots))
            labels.append(np.array(label, np.float32))

    for html in htmls:
        found = layouts.blocks(html)
        marked = [bool(path & _ARTICLE) and not path & _OTHER for path, _, _ in found]
        own = [text for (_, text, linked), m in zip(found, marked) if m or not any(marked) and len(text) >= PARAGRAPH and 2 * linked < len(text)]
        if any(marked):
            add(found, marked)
        if own:
            articles.append(own)
            prose += own
    for k in range(RENDERED * SAMPLE_PAGES):
        r = random.Random(k)
        own = r.choice(articles) if articles else ["x"]
        own = own if r.random() < 0.5 else r.sample(own, r.randint(1, min(len(own), 12)))
        found = layouts.blocks(layouts.rendered(r, own, prose or ["x"]))
        add([(p, t.replace(layouts.MARK, "").strip() or "x", n) for p, t, n in found], [layouts.MARK in t for _, t, _ in found])
    return pages, labels


def fit(df: DataFrame, html_col: str = "html") -> dict[str, np.ndarray]:
    """The network, learned from a sample of the pages."""
    small_batches(df.sparkSession)
    pages = df.select(F.col(html_col).alias("html")).where(F.length("html").between(1, SAMPLE_CHARS)).withColumn("own", F.xxhash64("html"))
    chosen = [r.own for r in pages.select("own").distinct().orderBy("own").limit(SAMPLE_PAGES).collect()]
    sample = pages.where(F.col("own").isin(chosen)).groupBy("own").agg(F.min("html").alias("html")).agg(F.sort_array(F.collect_list("html")).alias("htmls"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for htmls in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([blstm.packed(blstm.fit(*lessons(htmls)))], pa.binary())], names=["model"])

    return blstm.unpacked(sample.mapInArrow(run, "model binary").first().model)


def article_texts(model: dict[str, np.ndarray], htmls: list[str], slots: layouts.Slots) -> list[str]:
    """The main text of each page."""
    found = [layouts.blocks(h) for h in htmls]
    out, order = [""] * len(htmls), sorted((i for i, f in enumerate(found) if f), key=lambda i: len(found[i]))
    while order:
        longest = len(found[order[-1]])
        part, order = order[-max(1, AT_ONCE // longest) :], order[: -max(1, AT_ONCE // longest)]
        for i, chance in zip(part, blstm.scores(model, [layouts.features(found[i], slots) for i in part])):
            out[i] = "\n".join(text for (_, text, _), c in zip(found[i], chance) if c > 0.5)
    return out


def main_texts(df: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page, by a network fitted before or on these pages."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    shared = spark.sparkContext.broadcast(model or fit(df, html_col))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = layouts.Slots()
        for b in batches:
            texts = article_texts(shared.value, texts_of(b.column(2)), slots)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
