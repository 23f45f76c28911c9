"""Full-text search: a positional inverted index, and ranking by cover density.

A query is a set of alternatives, each a list of terms that all have to occur.  An
alternative's covers in a text are the minimal stretches that hold all its terms; a
cover counts ``WEIGHT``, divided by one more than the words in it that aren't needed.
The rank is the sum over the covers of all alternatives, so for alternatives of one
word it is ``WEIGHT`` times the places where they stand.

The index is a table (term, id, positions), made once and joined with as many queries
as there are; a join on terms is all that moves, and the covers of a text are found
from its positions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import let
from tessera.functions.stemming import term_of, words

WEIGHT = 0.1


def index(docs: DataFrame, doc_id: str, text: str, only: DataFrame | None = None, word: Column | None = None) -> DataFrame:
    """term, id, positions (from 1, stop words counted) of every term of every text.

    A null or empty text has no terms; repeated ids are taken together.  For a few searches alone (``only``, from
    ``query_terms``, which is sent to every task) terms that none asks for are left out before positions are gathered: each
    distinct word goes to the stemmer once, and the words that come to an asked term are sent to every task;
    ``word``, a condition on the column ``word``, says which words count as any term.
    """
    placed = docs.select(F.col(doc_id).alias("id"), F.posexplode(words(F.col(text))).alias("at", "word"))
    placed = placed if word is None else placed.where(word)
    if only is None:
        placed = placed.select("id", "at", term_of("word").alias("term")).where(F.col("term").isNotNull())
    else:
        own = placed.select("word").distinct().select("word", term_of("word").alias("term")).join(F.broadcast(only.select("term").distinct()), "term", "left_semi")
        placed = placed.join(F.broadcast(own), "word")
    return placed.groupBy("term", "id").agg(F.array_sort(F.collect_list(F.col("at") + 1)).alias("positions"))


def query_terms(queries: DataFrame, query_id: str, alternatives: str) -> DataFrame:
    """query, alternative (its number), term of queries given as arrays of texts; an alternative of stop words only is none."""
    each = queries.select(F.col(query_id).alias("query"), F.posexplode(alternatives).alias("alternative", "text"))
    own = each.select("query", "alternative", F.explode(words(F.col("text"))).alias("word")).select("query", "alternative", term_of("word").alias("term")).where(F.col("term").isNotNull())
    # Alternatives that come to the same terms are one.
    same = own.groupBy("query", "alternative").agg(F.array_sort(F.collect_set("term")).alias("terms")).groupBy("query", "terms").agg(F.min("alternative").alias("alternative"))
    return same.select("query", "alternative", F.size("terms").alias("wanted"), F.explode("terms").alias("term"))


def density(places: Column) -> Column:
    """The summed weights of the covers of terms with these (sorted, not empty) arrays of positions."""

    def covers(ends: Column) -> Column:
        last = lambda p, e: F.array_max(F.filter(p, lambda x: x <= e))
        begins = F.transform(ends, lambda e: F.struct(F.array_min(F.transform(places, lambda p: last(p, e))).alias("begin"), e.alias("end"), F.forall(places, lambda p: last(p, e).isNotNull()).alias("all")))
        # Ends go up, so of the stretches with one begin the first is the shortest.
        return F.aggregate(
            F.filter(begins, lambda c: c["all"]), F.struct(F.lit(-1).alias("begin"), F.lit(0.0).alias("sum")),
            lambda acc, c: F.struct(c["begin"].alias("begin"), (acc["sum"] + F.when(c["begin"] > acc["begin"], WEIGHT / (1.0 + c["end"] - c["begin"] - (F.size(places) - 1))).otherwise(0.0)).alias("sum")),
            lambda acc: acc["sum"],
        )

    return F.when(F.size(places) == 1, WEIGHT * F.size(places[0])).otherwise(let(F.array_sort(F.flatten(places)), covers))


def matches(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, id, rank of every text of the index ``found`` that has all terms of some alternative of ``wanted`` (from ``query_terms``)."""
    met = found.join(wanted, "term").groupBy("query", "alternative", "wanted", "id").agg(F.collect_list("positions").alias("places"))
    return met.where(F.size("places") == F.col("wanted")).select("query", "id", density(F.col("places")).alias("own")).groupBy("query", "id").agg(F.round(F.sum("own"), 6).alias("rank"))


def page(ranked: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Ranks ``offset`` + 1 to ``offset`` + ``limit`` of every query, with their ``place``; tasks keep only the first rows of each query before they are shuffled."""
    from pyspark.sql import Window

    placed = ranked.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rank"), *order)))
    return placed.where(F.col("place") <= offset + limit).where(F.col("place") > offset)
