"""Filters, joins, windows, ordering and table maintenance as plans over any DataFrame.

Null order is always stated: the reporting queries these serve put nulls last when
ascending and first when descending unless they say otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scanning import occurrences


def optional_filters(df: DataFrame, **equal) -> DataFrame:
    """Keep rows equal to each given value; a value of None filters nothing."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in equal.items() if v is not None), df)


def older_than(ts: Column, cutoff: Column) -> Column:
    """Never stamped or stamped before the cutoff."""
    return ts.isNull() | (ts < cutoff)


def any_contains(columns: list[str], words: list[str]) -> Column:
    """Some word occurs in some column, whatever the case; one alternation instead of many comparisons."""
    pattern = "(?i)" + "|".join(r"\Q" + w + r"\E" for w in words)
    return reduce(Column.__or__, (F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in columns)) if words else F.lit(False)


def members(df: DataFrame, key: str, wanted: list | DataFrame) -> DataFrame:
    """IN a short list as a filter, IN a table as a semi join."""
    return df.join(wanted, key, "left_semi") if isinstance(wanted, DataFrame) else df.where(F.col(key).isin(wanted))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page in a total order, each row with whether the page is full."""
    got = df.orderBy(*order).offset(offset).limit(limit)
    return got.withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(1))) == limit)  # over one page of rows


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group (R55, R56, R80); only n rows a task and group are shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= n)


def best_match(left: DataFrame, right: DataFrame, on: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """Every left row with its best right row, if there is one."""
    best = first_per_group(right, on, order).select(*on, *keep)
    return left.join(best, on, "left")


def missing_or_stale(df: DataFrame, done: DataFrame, on: str, version: Column) -> DataFrame:
    """Rows that have no row in ``done``, or one of an older version."""
    held = done.select(F.col(on).alias("done_key"), version.alias("done_version"), "wanted_version")
    return df.join(held, F.col(on) == F.col("done_key"), "left").where(F.col("done_version").isNull() | (F.col("done_version") < F.col("wanted_version"))).drop("done_key", "wanted_version")


def retain(df: DataFrame, guard: Column, references: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """Rows that stay when all others that are not referenced may go, and only if the guard holds."""
    kept = reduce(lambda d, r: d.join(r[0].select(F.col(r[1]).alias(key)).distinct(), key, "left_anti"), references, df.where(guard))
    return df.join(kept.select(key), key, "left_anti")


def assign_bands(df: DataFrame, order: list[Column], bands: list[tuple[str, int, int]], otherwise: str) -> DataFrame:
    """A label by rank: (label, first rank, last rank), the first that holds; other rows get ``otherwise``.

    Only the top of the ranking is needed, so it is taken by a top-k and joined back.
    """
    last = max(b[2] for b in bands)
    keys = [c for c in df.columns]
    top = df.orderBy(*order).limit(last).select(*keys, F.row_number().over(Window.orderBy(*order)).alias("rank"))
    label = reduce(lambda acc, b: F.when(F.col("rank").between(b[1], b[2]), b[0]).otherwise(acc), reversed(bands), F.lit(otherwise))
    ranked = top.select(keys[0], "rank")
    return df.join(ranked, keys[0], "left").withColumn("band", F.when(F.col("rank").isNull(), otherwise).otherwise(label))


def upsert(current: DataFrame, incoming: DataFrame, key: str, update: dict[str, Column], insert: dict[str, Column]) -> DataFrame:
    """The next version of a table: rows of ``incoming`` update or are inserted, others stay.

    In the expressions the current row is ``c.<column>`` and the incoming one ``i.<column>``.
    """
    both = current.alias("c").join(incoming.alias("i"), F.col(f"c.{key}") == F.col(f"i.{key}"), "full")
    new, same = F.col(f"c.{key}").isNull(), F.col(f"i.{key}").isNull()
    pick = lambda c: F.when(new, insert.get(c, F.lit(None))).when(same, F.col(f"c.{c}")).otherwise(update.get(c, F.col(f"c.{c}")))
    return both.select(F.coalesce(F.col(f"c.{key}"), F.col(f"i.{key}")).alias(key), *[pick(c).alias(c) for c in current.columns if c != key])


def insert_absent(current: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first of equal incoming rows whose key the table doesn't have."""
    return first_per_group(incoming.where(F.col(key).isNotNull()), [key], order).drop("rank_in_group").join(current.select(key), key, "left_anti")


def classify_import(current: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """inserted, updated or skipped for each incoming row; arrays are compared in sorted order."""
    value = lambda side, c, kind: F.array_sort(F.col(f"{side}.{c}")) if kind.startswith("array") else F.col(f"{side}.{c}")
    kinds = dict(incoming.dtypes)
    same = reduce(Column.__and__, (value("c", c, kinds[c]).eqNullSafe(value("i", c, kinds[c])) for c in columns))
    both = incoming.alias("i").join(current.alias("c"), F.col(f"i.{key}") == F.col(f"c.{key}"), "left")
    return both.select("i.*", F.when(F.col(f"c.{key}").isNull(), "inserted").when(same, "skipped").otherwise("updated").alias("outcome"))


def replace_slice(current: DataFrame, incoming: DataFrame, slice_: Column) -> DataFrame:
    """Delete a slice of the table and put the incoming rows in its place."""
    return current.where(~F.coalesce(slice_, F.lit(False))).unionByName(incoming)


def validated(df: DataFrame, column: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with an allowed value, and the rejected ones with the reason."""
    ok = F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return df.where(ok), df.where(~ok).withColumn("error", F.concat(F.lit(f"invalid {column}: "), F.coalesce(F.col(column), F.lit("null"))))


def bump_version(current: DataFrame, incoming: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """Incoming rows with version + 1, and ``carried`` columns taken over where they are missing."""
    both = incoming.alias("i").join(current.alias("c"), key, "left")
    rest = [c for c in incoming.columns if c not in (key, *carried)]
    return both.select(key, *[F.col(f"i.{c}") for c in rest], *[F.coalesce(F.col(f"i.{c}"), F.col(f"c.{c}")).alias(c) for c in carried], (F.coalesce(F.col("c.version"), F.lit(0)) + 1).alias("version"))


def token_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str = "tokens", n: int = 10) -> DataFrame:
    """For each left row its ``n`` right rows with most shared tokens (R35, R36): an equi join on tokens, counted and ranked."""
    a, b = (d.select(key, F.explode(F.array_distinct(tokens)).alias("token")) for d, key in ((left, left_id), (right, right_id)))
    hits = a.join(b, "token").groupBy(left_id, right_id).agg(F.count("*").alias("overlap"))
    return first_per_group(hits, [left_id], [F.desc("overlap"), F.asc(right_id)], n)


def quoted_in(quotes: DataFrame, texts: DataFrame, quote_id: str, text_id: str) -> DataFrame:
    """In how many texts (``t``) each quotation (``s``) stands verbatim, and the first of them (T12); each text is read once."""
    counts = occurrences(texts, text_id, "t", quotes, "s", whole_words=False).groupBy("term").agg(F.count("*").alias("found_in"), F.min(text_id).alias("first_doc"))
    found = quotes.select(quote_id, F.col("s").alias("term")).join(counts, "term", "left")
    return found.select(quote_id, F.coalesce("found_in", F.lit(0)).alias("found_in"), "first_doc")


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A repeatable random sample of ``n`` rows, by a hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def diff(fetched: DataFrame, active: DataFrame, expired: DataFrame, key: str) -> DataFrame:
    """new, present, missing or reappeared for each key."""
    flag = lambda d, name: d.select(key).distinct().withColumn(name, F.lit(True))
    all_ = flag(fetched, "f").join(flag(active, "a"), key, "full").join(flag(expired, "e"), key, "full")
    f, a, e = (F.coalesce(F.col(c), F.lit(False)) for c in "fae")
    return all_.select(key, F.when(f & ~a & ~e, "new").when(f & a, "present").when(a & ~f, "missing").when(f & e, "reappeared").alias("state")).where("state is not null")
