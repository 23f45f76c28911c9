"""Registered queries that look for many terms in whole texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import ontology as O
from tessera.operators import resumes
from tessera.operators.scanning import occurrences
from tessera.plans.registry import query
from tessera.plans.relational import tab

_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_PLAIN = "trim(regexp_replace(replace(lower(text), '/', ' '), '[\\x09-\\x0D\\x20]+', ' ', 'g'))"
#: Syllables and words of the invented texts, which hold few of the ontology's terms.
EXTRA = ["the", "and", "station", "ement", "von", "que", "thing", "para", "in the", "of the", "ed", "für", "é"]
SCANNED = sorted({" ".join(t.split()) for t in [*O.KNOWN, *EXTRA]})


_W = "\\p{L}\\p{N}_"


def _whole(term: str) -> str:
    """The SQL condition that a term stands in ``t`` as whole words."""
    edge = lambda c, end: f"(?:{end}|[^{_W}])" if c.isalnum() or c == "_" else f"[{_W}]"
    escaped = "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)
    return f"contains(t, '{term}') AND regexp_matches(t, '{edge(term[0], '^')}{escaped}{edge(term[-1], '$')}')"


@query(
    "q_known_terms",
    f"WITH d AS MATERIALIZED (SELECT doc_id, {_PLAIN} AS t FROM documents) SELECT term, count(*) AS n, min(doc_id) AS first_doc FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS term, doc_id FROM d WHERE {_whole(x)}" for x in SCANNED) + ") GROUP BY 1",
)
def known_terms(spark, sf_dir):
    """In how many texts each known term occurs as whole words (T18): one pass over the texts; the SQL tries a pattern for each term."""
    (documents,) = tab(spark, sf_dir, "documents")
    terms = spark.createDataFrame([(t,) for t in SCANNED], "term string")
    texts = documents.select("doc_id", O.plain(F.col("text")).alias("t"))
    return occurrences(texts, "doc_id", "t", terms, "term", whole_words=True).groupBy("term").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


_ANY = lambda words: " OR ".join(f"contains(lower(t), '{w}')" for w in words)


@query(
    "q_resume_fallback",
    f"""WITH d AS (SELECT doc_id, text AS t FROM documents), l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: trim(x, ' ' || chr(9))), lambda x: regexp_full_match(x, '[A-Za-z][A-Za-z .''-]+') AND len(regexp_split_to_array(x, '\\s+')) <= 5)[1] AS full_name FROM d)
    SELECT doc_id, full_name, concat_ws('|', {', '.join(f"CASE WHEN contains(lower(t), '{s.lower()}') THEN '{s}' END" for s in resumes.KNOWN_SKILLS)}) AS skills,
      coalesce(nullif(concat_ws('|', {', '.join(f"CASE WHEN {_ANY(words)} THEN '{role}' END" for role, words in resumes.ROLES)}), ''), '{resumes.OTHERWISE}') AS roles FROM d JOIN l USING (doc_id)""",
)
def resume_fallback(spark, sf_dir):
    """Every text read as a resume without a model."""
    (documents,) = tab(spark, sf_dir, "documents")
    found = resumes.fallback_profiles(documents, "doc_id", "text")
    return found.select("doc_id", "full_name", F.array_join("skills", "|").alias("skills"), F.array_join("roles", "|").alias("roles"))
