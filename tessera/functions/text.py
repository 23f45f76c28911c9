"""Text and key expressions: normalizers, canonical URLs, identity keys, labels, dates.  All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import rules as P
from tessera.functions.experience import years_label
from tessera.functions.expressions import let

# Query parameters that identify a record, and those that only track visits.
ID_PARAMS = ["gh_jid", "job_id", "jobid", "jid"]
TRACKING_PARAMS = ["gh_src", "iis", "iisn", "ref", "refid", "source", "trk", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]
US_STATES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
US_SUFFIX = rf"(?i)\s+-\s+([A-Za-z .'-]+,\s*)?({US_STATES}),?\s*(USA|US)?\s*$"


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def compact(x: Column) -> Column:
    """White space of every kind to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def identity_part(x: Column) -> Column:
    """Letters and digits in lower case, anything else to one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def matcher_norm(x: Column) -> Column:
    """Lower case with only a-z, 0-9, +, # and . kept."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9+#.]+", " "))


def verbatim_norm(x: Column) -> Column:
    """What quotations are compared in: no tags, plain quotes and dashes, one space, lower case."""
    entities = {"&nbsp;": " ", "&#160;": " ", "&quot;": '"', "&#34;": '"', "&#39;": "'", "&apos;": "'", "&rsquo;": "'", "&lsquo;": "'", "&ndash;": "-", "&mdash;": "-", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
    plain = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), entities.items(), F.coalesce(x, F.lit("")))
    untagged = F.translate(F.regexp_replace(plain, "<[^>]+>", " "), "‘’“”–— ", "''\"\"-- ")
    return F.lower(compact(untagged))


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(F.url_decode(x)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no slash at the end, and of the query only
    id parameters if there are any, else all but tracking ones (T06).  What isn't a URL is trimmed."""
    u = F.trim(url)
    scheme, host = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    items = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")
    pairs = F.transform(items, lambda x: F.struct(F.lower(F.url_decode(F.substring_index(x, "=", 1))).alias("name"), _encoded(F.substring_index(x, "=", 1)).alias("k"), _encoded(F.when(x.contains("="), F.regexp_extract(x, "^[^=]*=(.*)$", 1)).otherwise("")).alias("v")))
    ids = F.filter(pairs, lambda p: p["name"].isin(ID_PARAMS) & (p["v"] != ""))
    kept = F.when(F.size(ids) > 0, ids).otherwise(F.filter(pairs, lambda p: ~p["name"].isin(TRACKING_PARAMS)))
    query = F.array_join(F.transform(kept, lambda p: F.concat_ws("=", p["k"], p["v"])), "&")
    whole = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when((scheme != "") & (host != ""), whole).otherwise(blank_to_null(F.regexp_replace(u, "/+$", "")))


def identity_key(url: Column, company: Column, title: Column, location: Column) -> Column:
    """By canonical URL, else by company, title and location, else null."""
    c, t = identity_part(company), identity_part(title)
    role = F.when((c != "") & (t != ""), F.concat(F.lit("role:"), c, F.lit("|"), t, F.lit("|"), identity_part(location)))
    return F.coalesce(F.concat(F.lit("url:"), canonical_url(url)), role)


def queue_key(company: Column, title: Column, otherwise: Column) -> Column:
    """By company and title without its US location suffix."""
    c, t = identity_part(company), identity_part(F.regexp_replace(title, US_SUFFIX, ""))
    return F.when((c != "") & (t != ""), F.concat(F.lit("queue:"), c, F.lit("|"), t)).otherwise(otherwise)


def content_hash(title: Column, location: Column, text: Column) -> Column:
    """What decides whether a record has changed."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in (title, location, text))), 256)


def company_slugs(name: Column) -> Column:
    """Candidate keys of a company, first ones first, without repeats."""
    key = F.regexp_replace(F.regexp_replace(F.replace(F.lower(F.trim(name)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    joined = F.replace(key, F.lit("-"), F.lit(""))
    return F.array_distinct(F.array(key, joined, F.replace(key, F.lit("-"), F.lit("_")), F.concat(joined, F.lit("inc")), F.concat(joined, F.lit("jobs")), F.concat(joined, F.lit("careers"))))


def parse_moment(x: Column) -> Column:
    """Epoch milliseconds, ISO with or without Z, or month names; null if none of these."""
    iso = F.try_to_timestamp(F.regexp_replace(x, "Z$", "+00:00"))
    named = [F.try_to_timestamp(x, F.lit(f)) for f in ("MMMM d, yyyy", "MMM d, yyyy")]
    millis = F.when(x.rlike(r"^\d{11,}$"), F.timestamp_millis(x.try_cast("bigint")))
    return F.coalesce(millis, iso, *named)


def age_label(then: Column, now: Column) -> Column:
    """just now, minutes, hours or days."""
    seconds = F.greatest(F.timestamp_diff("SECOND", then, now), F.lit(0))

    def unit(n: Column, name: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    minutes, hours, days = F.floor(seconds / 60), F.floor(seconds / 3600), F.floor(seconds / 86400)
    return F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(minutes.cast("string"), F.lit(" min ago"))).when(seconds < 86400, unit(hours, "hour")).otherwise(unit(days, "day"))


def title_case(x: Column) -> Column:
    """A capital after anything that isn't a letter, small letters elsewhere (Q19)."""
    letters = F.split(F.lower(x), "")
    parts = F.transform(letters, lambda c, i: F.when((i == 0) | ~F.element_at(letters, F.greatest(i, F.lit(1))).rlike(r"\p{L}"), F.upper(c)).otherwise(c))
    return F.array_join(parts, "")


def salary(x: Column) -> Column:
    """A salary range, else a single rate, else the empty text."""
    ranged, single = F.regexp_extract(x, P.SALARY_RANGE, 1), F.regexp_extract(x, f"(?i){P.SALARY_RATE}", 1)
    return F.replace(F.regexp_replace(F.coalesce(blank_to_null(ranged), single, F.lit("")), r"\s+", " "), F.lit("$ "), F.lit("$"))


def experience_label(x: Column) -> Column:
    """The first stated years of experience, in words."""
    pattern = f"(?is){P.YEARS_STATED}"

    def stated(whole: Column) -> Column:
        # The groups are looked for in the statement alone, which holds all that the pattern matched.
        group = lambda i, j: F.coalesce(blank_to_null(F.regexp_extract(whole, pattern, i)), blank_to_null(F.regexp_extract(whole, pattern, j))).cast("int")
        years = F.struct(group(1, 3).alias("low"), group(2, 4).alias("high"))
        told = let(years, lambda y: F.when(whole.contains("+"), F.concat(y["low"].cast("string"), F.lit("+ years"))).otherwise(years_label(y["low"], F.coalesce(y["high"], y["low"]))))
        return F.when(whole == "", "Not stated").otherwise(told)

    return F.when(x.isNull() | (x == ""), "Not stated").when(x.rlike(f"(?i){P.NO_EXPERIENCE}"), "0 years").otherwise(let(F.regexp_extract(x, pattern, 0), stated))


def experience_bucket(label: Column) -> Column:
    """early, one-plus, two-plus, three-plus, mid, senior or unknown, of an experience label."""

    def of(t: Column, numbers: Column) -> Column:
        low = F.try_element_at(numbers, F.lit(1))
        high = F.coalesce(F.try_element_at(numbers, F.lit(2)), low)
        plus = F.when(low < 2, "one-plus").when(low == 2, "two-plus").when(low < 6, "three-plus").otherwise("senior")
        span = F.when(high <= 2, "early").when(low <= 5, "mid").otherwise("senior")
        return F.when(t.rlike("new grad"), "early").when(low.isNull(), "unknown").when(t.contains("+"), plus).otherwise(span)

    numbers = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int"))
    return let(F.lower(compact(label)), lambda t: let(numbers(t), lambda n: of(t, n)))


def metric_facts(x: Column) -> Column:
    """Derived percent reductions of all statements ``A ms -> B ms``."""
    pattern = F.lit(r"(?i)(\d+(?:\.\d+)?)\s*ms\s*(?:->|→|to)\s*(\d+(?:\.\d+)?)\s*ms")
    pairs = F.arrays_zip(F.regexp_extract_all(x, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(x, pattern, F.lit(2)).alias("b"))
    good = F.filter(pairs, lambda p: (p["a"].cast("double") > 0) & (p["b"].cast("double") < p["a"].cast("double")))
    return F.transform(good, lambda p: F.concat(F.bround(100 * (p["a"].cast("double") - p["b"].cast("double")) / p["a"].cast("double")).cast("int").cast("string"), F.lit("% reduction")))


def answer_variants(x: Column) -> Column:
    """A short, a medium and the full form of an answer."""
    sentences = F.split(compact(x), r"(?<=[.!?])\s+")
    words = F.split(compact(x), " ")
    return F.struct(F.element_at(sentences, 1).alias("short"), F.array_join(F.slice(words, 1, 60), " ").alias("medium"), compact(x).alias("full"))


def escape_html(x: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), x)


def escape_pipe(x: Column) -> Column:
    """A table cell: one line, pipes escaped."""
    return F.replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s*[\r\n]+\s*", " "), F.lit("|"), F.lit("\\|"))


def escape_latex(x: Column) -> Column:
    """Text that LaTeX sets as it stands."""
    marked = F.regexp_replace(x, r"([&%$#_{}])", r"\\$1")
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), (("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}")), marked)


def bool_text(x: Column) -> Column:
    """true or false in small letters if the text says so, else the text itself (F22); a column has one type, so both are text."""
    t = F.lower(F.trim(x))
    return F.when(t.isin("true", "false"), t).otherwise(x)


def token_estimate(x: Column, answer: Column) -> Column:
    """Tokens that a text and the longest answer to it may take: a quarter of its characters and all of the answer's."""
    return F.floor(F.length(F.coalesce(x, F.lit(""))) / 4) + answer


def display_company(x: Column) -> Column:
    """A company's name as shown: known spellings, the site of a piped address, else title case."""
    parts = F.filter(F.transform(F.split(F.trim(x), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    last = F.element_at(parts, -1)
    site = F.when(F.lower(last).isin("external", "global", "careers", "jobs"), F.get(parts, F.lit(1))).otherwise(last)
    piped = (F.size(parts) > 1) & F.contains(F.lower(F.get(parts, F.lit(0))), F.lit(".myworkdayjobs.com"))
    clean = F.trim(F.regexp_replace(F.when(piped, F.translate(site, "_-", "  ")).otherwise(F.trim(x)), r"\s+", " "))
    known = F.create_map(*[F.lit(v) for kv in P.COMPANY_NAMES.items() for v in kv])
    return F.coalesce(F.try_element_at(known, F.regexp_replace(F.lower(clean), "[^a-z0-9 ]", "")), title_case(clean))


def risky_claims(x: Column) -> Column:
    """kind and span of every phrase that claims a measure, a team, ownership, scale or a duration."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(x, F.lit(f"(?i){pattern}"), F.lit(0)), lambda span: F.struct(F.lit(kind).alias("kind"), span.alias("span")))

    return F.concat(*[of(kind, p) for kind, p in P.RISKS.items()])


def unsupported_claims(x: Column, facts: Column) -> Column:
    """The risky claims that occur in none of the allowed facts (an array of texts) and in no reduction derived from these."""
    allowed = F.transform(F.concat(facts, F.flatten(F.transform(facts, lambda f: metric_facts(f)))), lambda f: F.lower(f))
    return F.filter(risky_claims(x), lambda c: ~F.exists(allowed, lambda f: F.contains(f, F.lower(c["span"]))))


def json_body(x: Column) -> Column:
    """What stands between the outermost braces (F16)."""
    return blank_to_null(F.regexp_extract(x, r"(?s)(\{.*\})", 1))


def first_given(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(blank_to_null(F.trim(c)) for c in columns))


def backoff(attempts: Column, base: int, most: int) -> Column:
    """base * 2^attempts seconds, at most ``most``."""
    return F.least(F.lit(most), (F.lit(base) * F.pow(F.lit(2), attempts)).cast("bigint"))


def bag_index(token: Column, size: int = 768) -> Column:
    """The place of a token in a hashed bag of words."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint") % size).cast("int")


def keywords(x: Column, stop: list[str], least: int) -> Column:
    """Distinct lower-case words of at least ``least`` letters that aren't stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9+#.]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(",.()"))), lambda w: (F.length(w) >= least) & ~w.isin(stop)))


def split_keywords(x: Column, stop: list[str], least: int) -> Column:
    """The same of what stands between white space, without punctuation at its ends."""
    words = F.transform(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: F.lower(F.btrim(w, F.lit(",.()"))))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(stop)))


def keyword_score(words: Column, title: Column, body: Column) -> Column:
    """3 for each word in the title and 1 for each in the body."""
    t, b = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.when(t.contains(w), 3).otherwise(0) + F.when(b.contains(w), 1).otherwise(0))
