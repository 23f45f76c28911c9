"""Secret scans with an incremental blob ledger, in DataFrame and SQL functions only.

Every version of a text is a blob addressed by its SHA-256; a path that has changed
is several rows, one for each version.  The ledger is a table in the shared folder
that lists which rule versions have been run over which blobs, and what they found.
A scan runs, over the distinct blobs of its input, the (blob, rule version) pairs
that the ledger doesn't have, appends them to it, and joins findings back to all
rows that hold the blob.  Equal texts are scanned once, a new rule alone is run over
old texts, and a scan of what has been scanned runs nothing.

Rules: ``assign`` (a secret's name, then a value of 12 characters or more),
``access`` (AKIA key ids of 18 characters or more), ``hex`` (runs of 16 or more
hexadecimal digits) and ``pem`` (a private key's first line).  Matches of a rule are
leftmost and don't overlap; those that are too short are dropped after matching.
Positions are in code points, ends exclusive.

Defined results: a null text is the empty text, which holds nothing; rows with a
null id and repeated rows each get their blob's findings; columns of any name stay
what they are (but for ``blob`` and ``spans`` in ``scan``); no rows give no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ensure_checkpoint_dir, packed


def either_case(word: str) -> str:
    """A pattern for the word with letters in either case, alike in all regex dialects."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``least`` characters are asked of capture ``group``.  A changed rule gets a new version."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
BASE_RULES = (
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}", 0, 16),
)
#: Rules that add to the base ones.
MORE_RULES = (Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<start:bigint,rule:int,end:bigint>>"
#: Matches of a rule in one text are fewer than 2 to this power.
MATCH_BITS = 26


def _with(value: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running_sums(x: Column) -> Column:
    """The sums of the first 1, 2, .. numbers of an array, by doubling, so that long arrays cost little more than short ones."""

    def step(reach: int):
        def add(s: Column) -> Column:
            zeros = F.array_repeat(F.lit(0).cast("bigint"), F.least(F.lit(reach), F.size(s)))
            shifted = F.concat(zeros, F.slice(s, F.lit(1), F.greatest(F.size(s) - reach, F.lit(0))))
            return F.when(F.size(s) > reach, F.zip_with(s, shifted, lambda a, b: a + b)).otherwise(s)

        return add

    def far(s: Column) -> Column:
        for bit in range(4, MATCH_BITS):
            s = _with(s, step(1 << bit))
        return s

    for bit in range(4):
        x = _with(x, step(1 << bit))
    return _with(x, lambda s: F.when(F.size(s) > 16, far(s)).otherwise(s))


def spans_of(text: Column, number: int, rule: Rule) -> Column:
    """start, rule (its number) and end of each match of a rule that is long enough."""
    lengths = lambda parts: F.transform(parts, lambda x: F.length(x).cast("bigint"))
    own = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    asked = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)))
    before = F.slice(lengths(F.split(text, rule.pattern, -1)), F.lit(1), F.size(own))
    ends = running_sums(F.zip_with(before, own, lambda a, b: a + b))
    found = F.zip_with(F.arrays_zip(ends.alias("end"), own.alias("own")), asked, lambda m, n: F.struct(F.struct((m["end"] - m["own"]).alias("start"), F.lit(number).alias("rule"), m["end"].alias("end")).alias("span"), n.alias("n")))
    kept = F.transform(F.filter(found, lambda f: f["n"] >= rule.least), lambda f: f["span"])
    return F.when(text.rlike(rule.pattern), kept).otherwise(F.array().cast(SPANS))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"], s["end"])))


LEDGER_DDL = "blob string, rules array<string>, spans array<struct<start:bigint,rule:string,end:bigint>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class Ledger:
    """A table of scans, a row for each scan of a blob: the rule versions run, and the spans found with them."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        """Open the ledger in ``folder``, or begin a new one below the shared folder."""
        self.spark, self.folder = spark, folder or f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
        self.fresh = folder is None
        if self.fresh:
            self.append(spark.createDataFrame([], LEDGER_DDL))
            self.fresh = True

    def append(self, scanned: DataFrame) -> None:
        """Add scans; they are there for readers once the whole write is done."""
        scanned.write.mode("append").parquet(self.folder)
        self.fresh = False

    def read(self) -> DataFrame:
        return self.spark.read.schema(LEDGER_DDL).parquet(self.folder)

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """blob and its spans under the rule versions ``rules``, by start and then by rule; scans that were made twice count once."""
        names = F.array(*[F.lit(r.name) for r in rules])
        numbered = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (F.array_position(names, s["rule"]) - 1).cast("int").alias("rule"), s["end"].alias("end")))
        rows = self.read().where(F.arrays_overlap("rules", names)).select("blob", F.filter(numbered, lambda s: s["rule"] >= 0).alias("spans"))
        return rows.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def scan_unseen(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Ledger rows of the (blob, rule version) pairs of ``versions`` that the ledger doesn't have."""
    blobs = versions.select(blob_of(F.col(f"`{text_col}`")).alias("blob"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    names, nothing = F.array(*[F.lit(r.name) for r in rules]), F.array().cast("array<string>")
    if ledger.fresh:
        todo = blobs.dropDuplicates(["blob"]).withColumn("rules", names)
    else:
        done = ledger.read().groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done"))
        known = blobs.select("blob").distinct().join(done, "blob", "left")
        pairs = known.select("blob", F.array_except(names, F.coalesce("done", nothing)).alias("rules")).where(F.size("rules") > 0)
        if pairs.isEmpty():
            return versions.sparkSession.createDataFrame([], LEDGER_DDL)
        todo = blobs.join(pairs, "blob").dropDuplicates(["blob"])
    text = F.col("text")
    each = [F.when(F.array_contains("rules", r.name), spans_of(text, i, r)).otherwise(F.array().cast(SPANS)) for i, r in enumerate(rules)]
    spans = F.transform(F.concat(*each), lambda s: F.struct(s["start"].alias("start"), F.element_at(names, s["rule"] + 1).alias("rule"), s["end"].alias("end")))
    return todo.select("blob", "rules", spans.alias("spans"))


def _scanned(versions: DataFrame, ledger: Ledger | None, rules: tuple[Rule, ...], text_col: str, rows: DataFrame) -> DataFrame:
    """``rows`` (which hold blob) with the blob's spans, after what is unseen has been added to the ledger.

    The ledger is a written table, so Spark can split the join where many rows hold one blob.
    """
    ledger = ledger or Ledger(versions.sparkSession)
    ledger.append(scan_unseen(versions, ledger, rules, text_col))
    return rows.join(ledger.findings(rules), "blob")


def scan(versions: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``versions`` with the columns blob and spans added (in place of any of these names), by way of the ledger."""
    rows = packed(versions, blob=blob_of(F.col(f"`{text_col}`")))
    others = [F.col(f"row.`{c}`") for c in versions.columns if c not in ("blob", "spans")]
    return _scanned(versions, ledger, rules, text_col, rows).select(*others, "blob", "spans")


def _is(number: int):
    return lambda rule: rule == number


def findings(df: DataFrame, ledger: Ledger | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, counts of the base rules, digest of the base spans and all spans of every row."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), blob_of(F.col(f"`{text_col}`")).alias("blob"))
    rows = _scanned(df, ledger, RULES, text_col, rows)
    base = F.filter("spans", lambda s: s["rule"] < len(BASE_RULES))
    rules = F.transform("spans", lambda s: s["rule"])
    counts = [F.size(F.filter(rules, _is(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return rows.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones as one) replaced by ``mark``."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], kept, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", ledger: Ledger | None = None) -> DataFrame:
    """``df`` with all secrets in its texts replaced, and the texts' lengths brought up to date where they change."""
    rows = _scanned(df, ledger, RULES, text_col, packed(df, blob=blob_of(F.col(f"`{text_col}`"))))
    # the new text is a step of its own: its length is then taken from it and not worked out again
    rows = rows.withColumn("fresh", redacted(F.col(f"row.`{text_col}`"), F.col("spans")))
    columns = {c: F.col(f"row.`{c}`") for c in df.columns}
    columns[text_col] = F.col("fresh")
    if length_col in df.columns:
        changed = F.length("fresh").cast(df.schema[length_col].dataType)
        columns[length_col] = F.when(F.size("spans") > 0, changed).otherwise(columns[length_col])
    return rows.select(*[c.alias(name) for name, c in columns.items()])


def _oracle() -> str:
    """The same findings as DuckDB SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = [
        f"SELECT doc_id, {i} AS rule, {r.least} AS least, list_transform(regexp_split_to_array(t, {quoted(r.pattern)}), lambda x: length(x)) AS before, "
        f"list_transform(regexp_extract_all(t, {quoted(r.pattern)}, 0), lambda x: length(x)) AS own, list_transform(regexp_extract_all(t, {quoted(r.pattern)}, {r.group}), lambda x: length(x)) AS asked FROM d"
        for i, r in enumerate(RULES)
    ]
    names = "[" + ", ".join(quoted(r.kind) for r in RULES) + "]"
    base = len(BASE_RULES)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({" UNION ALL ".join(parts)}),
    n AS (SELECT *, unnest(range(1, len(own) + 1)) AS i FROM m WHERE len(own) > 0),
    s AS (SELECT doc_id, rule, CAST(list_sum(before[1:i]) + coalesce(list_sum(own[1:i-1]), 0) AS BIGINT) AS s0, CAST(own[i] AS BIGINT) AS n0 FROM n WHERE asked[i] >= least),
    g AS (SELECT doc_id, count(*) FILTER (WHERE rule = 0) AS n_assign, count(*) FILTER (WHERE rule = 1) AS n_access, count(*) FILTER (WHERE rule = 2) AS n_hex,
          string_agg({names}[rule + 1] || ':' || s0 || ':' || (s0 + n0), ',' ORDER BY s0, rule) FILTER (WHERE rule < {base}) AS base,
          string_agg({names}[rule + 1] || ':' || s0 || ':' || (s0 + n0), ',' ORDER BY s0, rule) AS spans FROM s GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (doc_id)
    """


ORACLE_SQL = _oracle()
