"""Record sources: raw payloads of several shapes to one schema, and files of pairs, pipes and tables.

Fetching is not part of this library; payloads are landed as JSON text, one row each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.html import html_to_text

_NAMED = "struct<name:string>"
#: The shape of each source's payload: where its rows are, and what a row looks like.
SHAPES = {
    "greenhouse": ("jobs", f"struct<id:bigint,title:string,location:{_NAMED},absolute_url:string,updated_at:string,content:string>"),
    "lever": ("", "struct<id:string,text:string,categories:struct<location:string>,hostedUrl:string,createdAt:bigint,description:string,lists:array<struct<text:string,content:string>>,additional:string>"),
    "ashby": ("jobs", "struct<id:string,title:string,location:string,jobUrl:string,publishedAt:string,descriptionHtml:string>"),
    "smartrecruiters": ("content", "struct<id:string,name:string,location:struct<city:string,region:string,country:string>,ref:string,releasedDate:string,description:string>"),
    "workable": ("jobs", "struct<shortcode:string,title:string,city:string,state:string,country:string,url:string,published_on:string,description:string>"),
    "workday": ("jobPostings", "struct<title:string,externalPath:string,jobReqId:string,locationsText:string,postedOn:string,jobDescription:string>"),
}


def rows_of(raw: DataFrame, source: str) -> DataFrame:
    """The rows of payloads (company, payload); a payload of another shape gives one row with an error."""
    path, row = SHAPES[source]
    shape = f"array<{row}>" if not path else f"struct<{path}:array<{row}>>"
    parsed = F.from_json("payload", shape, {"mode": "PERMISSIVE"})
    found = parsed if not path else parsed[path]
    return raw.select("company", F.explode_outer(found).alias("r"), F.when(found.isNull(), F.lit(f"payload is not of {source}'s shape")).alias("error"))


def _joined(*parts: Column) -> Column:
    return T.blank_to_null(F.concat_ws("; ", *[T.blank_to_null(F.trim(p)) for p in parts]))


def _sections(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _lever_text(r: Column) -> Column:
    lists = F.array_join(F.transform(F.coalesce(r["lists"], F.array()), lambda x: F.concat(F.lit("<h3>"), F.coalesce(x["text"], F.lit("")), F.lit("</h3><ul>"), F.coalesce(x["content"], F.lit("")), F.lit("</ul>"))), "\n")
    return _sections(r["description"], lists, r["additional"])


#: For each source: id, title, location, url, posted, description.
FIELDS: dict[str, Callable[[Column], tuple[Column, ...]]] = {
    "greenhouse": lambda r: (r["id"].cast("string"), r["title"], r["location"]["name"], r["absolute_url"], r["updated_at"], r["content"]),
    "lever": lambda r: (r["id"], r["text"], r["categories"]["location"], r["hostedUrl"], r["createdAt"].cast("string"), _lever_text(r)),
    "ashby": lambda r: (r["id"], r["title"], r["location"], r["jobUrl"], r["publishedAt"], r["descriptionHtml"]),
    "smartrecruiters": lambda r: (r["id"], r["name"], _joined(r["location"]["city"], r["location"]["region"], r["location"]["country"]), r["ref"], r["releasedDate"], r["description"]),
    "workable": lambda r: (r["shortcode"], r["title"], _joined(r["city"], r["state"], r["country"]), r["url"], r["published_on"], r["description"]),
    "workday": lambda r: (r["jobReqId"], r["title"], r["locationsText"], r["externalPath"], r["postedOn"], r["jobDescription"]),
}


def normalize(raw: DataFrame, source: str) -> DataFrame:
    """Records of one schema (T02, T03, T04, T09): external id, title, place, URL, date, text, hash and keys."""
    rows = rows_of(raw, source).where("error is null and r is not null")
    ident, title, place, url, posted, description = FIELDS[source](F.col("r"))
    named = rows.select("company", T.compact(ident).alias("id"), T.compact(title).alias("title"), T.blank_to_null(T.compact(place)).alias("location"), T.blank_to_null(F.trim(url)).alias("application_url"), T.parse_moment(posted).alias("date_posted"), description.alias("html"))
    texts = named.withColumn("description_text", html_to_text("html")).drop("html")
    prefix = F.concat_ws("_", F.lit(source), F.when(F.lit(source == "workday"), F.col("company")), F.col("id"))
    keyed = texts.withColumns({
        "external_id": prefix, "source": F.lit(source), "canonical_url": T.canonical_url(F.col("application_url")), "content_hash": T.content_hash(F.col("title"), F.col("location"), F.col("description_text")),
        "identity_key": T.identity_key(F.col("application_url"), F.col("company"), F.col("title"), F.col("location")), "description_status": F.when(F.col("description_text") == "", "pending").otherwise("ok"),
    })
    return keyed.withColumn("queue_key", T.queue_key(F.col("company"), F.col("title"), F.col("identity_key"))).drop("id")


def normalize_all(raw: DataFrame) -> DataFrame:
    """All known sources of (source, company, payload) in one table."""
    parts = [normalize(raw.where(F.col("source") == s).select("company", "payload"), s) for s in SHAPES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def config_pairs(text: DataFrame, known: list[str]) -> DataFrame:
    """(ats, slug) pairs of a JSON map of lists, whose items are names or objects with a slug or name."""
    maps = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("ats", "items")).where(F.col("ats").isin(known))
    item = maps.select("ats", F.explode("items").alias("item"))
    slug = F.coalesce(F.get_json_object("item", "$.slug"), F.get_json_object("item", "$.name"), F.when(~F.col("item").startswith("{"), F.col("item")))
    return item.select("ats", F.lower(F.trim(slug)).alias("slug")).where("slug <> ''").distinct()


def registry_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header; a byte-order mark before it doesn't matter."""
    df = spark.read.csv(path, header=True)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def piped_records(lines: DataFrame) -> DataFrame:
    """company|title|start|end|type|note lines; ``present`` is an open end."""
    f = F.split("value", r"\|")
    part = lambda i: T.blank_to_null(F.trim(F.try_element_at(f, F.lit(i + 1))))
    date = lambda c: F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    end = part(3)
    rows = lines.where(F.size(f) == 6)
    return rows.select(part(0).alias("company"), part(1).alias("title"), date(part(2)).alias("start_date"), date(F.when(F.lower(end) != "present", end)).alias("end_date"), part(4).alias("employment_type"), part(5).alias("note"), (F.lower(end) == "present").alias("is_current"))


def markdown_table(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a Markdown table; escaped pipes are part of a cell."""
    body = F.regexp_replace(F.trim("value"), r"^\||\|$", "")
    cells = F.transform(F.split(body, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    rows = lines.where(F.trim("value").startswith("|") & ~F.col("value").rlike(r"^\s*\|[\s:|-]+$")).select(cells.alias("c")).where(F.size("c") == len(columns))
    return rows.select(*[F.element_at("c", i + 1).alias(n) for i, n in enumerate(columns)]).where(F.col(columns[0]) != columns[0])


def fingerprint(urls: DataFrame, patterns: list[tuple[str, str, int]]) -> DataFrame:
    """The source that a site's URLs point to: of (name, pattern, points) the best match, first ones winning ties.

    ``urls`` has site and url; the slug is the pattern's first group.
    """
    tries = F.array(*[F.struct(F.lit(points).alias("points"), F.lit(-i).alias("order"), F.lit(name).alias("ats"), F.regexp_extract("url", p, 1).alias("slug")) for i, (name, p, points) in enumerate(patterns)])
    found = urls.select("site", F.explode(F.filter(tries, lambda t: t["slug"] != "")).alias("t"))
    return found.groupBy("site").agg(F.max("t").alias("t")).select("site", "t.ats", "t.slug", "t.points")
