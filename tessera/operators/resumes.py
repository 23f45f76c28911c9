"""What can be told of a resume without a model: known skills, roles and a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.scanning import occurrences

# The skills looked for, and the roles that some of them, or words, stand for.
KNOWN_SKILLS = ["Python", "C++", "C", "JavaScript", "TypeScript", "SQL", "PostgreSQL", "Docker", "FastAPI", "React", "Next.js", "ROS2", "PyBullet", "Gazebo", "PX4", "RLlib", "CTDE-MAPPO", "Multi-Agent Reinforcement Learning", "Git"]
ROLES = [("Autonomous Systems Engineer", ["ros2", "pybullet", "gazebo", "px4"]), ("Software Developer", ["python", "c++", "fastapi", "sql"]), ("Researcher", ["research", "reinforcement learning"])]
OTHERWISE, NAME_WORDS = "Software Developer", 5
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def guessed_name(text: Column) -> Column:
    """The first line of at most ``NAME_WORDS`` words that is made of letters, blanks, points, hyphens and apostrophes; null if there is none."""
    lines = F.filter(F.transform(F.split(text, LINE_ENDS, -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.rlike(r"^[A-Za-z][A-Za-z .'-]+$") & (F.size(F.split(x, r"\s+")) <= NAME_WORDS))
    return F.get(lines, F.lit(0))


def fallback_profiles(resumes: DataFrame, key: str, text: str) -> DataFrame:
    """key, full_name, skills and roles of every resume; skills and role words count wherever they stand, in any case.

    Skills come in the order of ``KNOWN_SKILLS``; a text without a role word is of the role ``OTHERWISE``.  Null texts have
    neither name nor skill.  Rows are told apart by their key, so keys have to be distinct.
    """
    spark = resumes.sparkSession
    words = sorted({s.lower() for s in KNOWN_SKILLS} | {w for _, known in ROLES for w in known})
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    lowered = resumes.select(key, F.lower(text).alias("lowered"))
    found = occurrences(lowered, key, "lowered", terms, "term", whole_words=False).groupBy(key).agg(F.collect_set("term").alias("terms"))
    both = resumes.select(key, F.col(text).alias("text")).join(found, key, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    has = lambda w: F.array_contains("terms", w.lower())
    skills = F.array_compact(F.array(*[F.when(has(s), s) for s in KNOWN_SKILLS]))
    roles = F.array_compact(F.array(*[F.when(F.arrays_overlap("terms", F.array(*map(F.lit, known))), role) for role, known in ROLES]))
    return both.select(key, guessed_name(F.col("text")).alias("full_name"), skills.alias("skills"), F.when(F.size(roles) > 0, roles).otherwise(F.array(F.lit(OTHERWISE))).alias("roles"))
