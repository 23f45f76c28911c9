"""Years of experience that a posting asks for, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import rules as P
from tessera.functions.expressions import let


MARK = "\x01"


def years_label(low: Column, high: Column) -> Column:
    """``1 year``, ``2 years`` or ``1–2 years``."""
    text = lambda n: n.cast("string")
    return F.when((low == 1) & (high == 1), "1 year").when(low == high, F.concat(text(low), F.lit(" years"))).otherwise(F.concat(text(low), F.lit("–"), text(high), F.lit(" years")))


def stated_years(x: Column, pattern: str) -> Column:
    """low, high and whether it is open-ended, of each statement: the text is cut at the matches, so what stands around each is at hand."""
    p = f"(?is){pattern}"

    def one(m: Column) -> Column:
        plus = (m["high"] == "") & m["whole"].contains("+") & F.regexp_like(m["whole"], F.concat(F.lit(r"\b"), m["low"], F.lit(r"\s*\+")))
        around = m["before"].rlike(f"(?i){P.OPEN_BEFORE}") | m["after"].rlike(f"(?i){P.OPEN_AFTER}")
        low = m["low"].cast("int")
        return F.struct(low.alias("low"), F.coalesce(m["high"].try_cast("int"), low).alias("high"), (plus | around).alias("open"))

    def parts(whole: Column, around: Column) -> Column:
        group = lambda n: F.transform(whole, lambda w: F.regexp_extract(w, p, n))
        found = F.arrays_zip(whole.alias("whole"), group(1).alias("low"), group(2).alias("high"), F.slice(around, F.lit(1), F.size(whole)).alias("before"), F.slice(around, F.lit(2), F.size(whole)).alias("after"))
        return F.transform(found, one)

    # A text without a statement is searched once and not cut.
    marked = F.regexp_replace(F.translate(x, MARK, "\x02"), p, MARK)  # split() would compile the pattern for every row
    cut = lambda whole: F.when(F.size(whole) > 0, let(F.split(marked, MARK, -1), lambda around: parts(whole, around))).otherwise(F.array())
    return let(F.regexp_extract_all(x, F.lit(p), F.lit(0)), cut)


def entry_experience(x: Column) -> Column:
    """Years asked for, if all of the posting's statements ask for at most two and none is open-ended from two on."""
    def told(asked: Column) -> Column:
        ruled_out = F.exists(asked, lambda a: (a["high"] > 2) | (a["low"] > 2) | ((a["low"] >= 2) & a["open"]))
        low, high = F.array_min(F.transform(asked, lambda a: a["low"])), F.array_max(F.transform(asked, lambda a: a["high"]))
        return F.when((F.size(asked) > 0) & ~ruled_out, years_label(low, high))

    asked = F.concat(stated_years(x, P.YEARS_BEFORE_EXPERIENCE), stated_years(x, P.EXPERIENCE_BEFORE_YEARS))
    return F.when(x.isNull() | (x == "") | x.rlike(f"(?i){P.OPEN_ENDED_TWO_PLUS}"), None).when(x.rlike(f"(?i){P.NO_EXPERIENCE}"), "0 years").otherwise(let(asked, told))
