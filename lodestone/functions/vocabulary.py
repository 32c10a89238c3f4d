"""Reference tables: fixed lists, and a small dictionary for the synthetic texts of the queries; ``dictionary`` has that for real ones."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: (canonical, alias, case_sensitive): words of the synthetic test texts; aliases of up to two characters are case-sensitive.
TERMS = (
    ("that", "that", False), ("with", "with", False), ("from", "from", False), ("from", "avec", False), ("und", "und", False),
    ("of the", "of the", False), ("de la", "de la", False), ("in", "In", True), ("is", "IS", True), ("der", "der", False), ("que", "que", False),
    ("des", "des", False), ("tion", "tion", False), ("this", "this", False), ("this", "este", False), ("by", "by", True), ("was", "was", False), ("heat", "heat", False),
)
IMPLIES = (("that", "with"), ("with", "from"), ("from", "und"), ("der", "des"), ("this", "was"))
#: (priority, kind, pattern): the first that is found in a heading names its kind.
HEADING_RULES = ((1, "ignore", "(^|[^a-z])(to|zu|pour)([^a-z]|$)"), (2, "preferred", "(^|[^a-z])(of|des|que)([^a-z]|$)"), (3, "required", "(the|ch|re)"), (4, "duties", "(an|en|in)"))
WEIGHTS = {"required": 10, "preferred": 5, "duties": 5, "other": 3, "ignore": 0}
#: A line that matches this inside a required section only counts as preferred.
PREFERRED_LINE = "(^|[^a-z])(bonus|a plus|preferred|for)([^a-z]|$)"
#: How headings and lines of the synthetic texts are read.
SAMPLE = {"rules": HEADING_RULES, "preferred": PREFERRED_LINE}
#: Names of roles in the titles of the synthetic texts, a pattern.
ROLE_NAMES = "(?:heat|that|tion|with)s?\\b"
ROLES = (("projects", ("project", "tion")), ("experience", ("experience", "the")), ("other", ("education", "an")))

# Words without content, suffixes in the order tried, number words, multipliers.
STOP = (
    "a an the and or but of in on at to for from by with without via into onto over under as is are was were be been being this that these those it its their them they "
    "he she his her our we i my me you your up down out off than then so such very more most less least same across while during after before about per each all any both "
    "either neither not no nor only own also"
).split()
SUFFIXES = ("ations", "ation", "ising", "izing", "ised", "ized", "ings", "ing", "edly", "ed", "es", "s", "ly")
NUMBER_WORDS = {
    "zero": 0, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
}
MULTIPLIERS = {"K": 1e3, "k": 1e3, "M": 1e6, "B": 1e9, "bn": 1e9}


def terms(spark: SparkSession, rows=TERMS) -> DataFrame:
    """(canonical, alias, lead, pattern): ``lead`` is the alias's first run of word characters, ``pattern`` its bounded form."""
    out = []
    for canonical, alias, exact in rows:
        flag = "" if exact or len(alias) <= 2 else "(?i)"
        lead = re.search(r"[A-Za-z0-9_]+", alias)
        out.append((canonical, alias, lead[0].lower() if lead else "", f"{flag}(?<![\\w+#.]){re.escape(alias)}(?![\\w+#])"))
    return spark.createDataFrame(out, "canonical string, alias string, lead string, pattern string")


def implies(spark: SparkSession, rows=IMPLIES) -> DataFrame:
    """(canonical, implied): the transitive closure, by a recursive query over this small table."""
    pairs = spark.createDataFrame(list(rows), "canonical string, implied string")
    return spark.sql(
        """WITH RECURSIVE c(canonical, implied, n) AS (SELECT canonical, implied, 1 FROM {pairs}
           UNION ALL SELECT c.canonical, i.implied, n + 1 FROM c JOIN {pairs} i ON i.canonical = c.implied WHERE n < 20)
           SELECT DISTINCT canonical, implied FROM c""",
        pairs=pairs,
    )


def values_sql(rows) -> str:
    """Literal rows for the SQL twins."""
    def lit(v) -> str:
        return str(v) if isinstance(v, int | float) and not isinstance(v, bool) else f"'{str(v).lower() if isinstance(v, bool) else str(v).replace(chr(39), chr(39) * 2)}'"

    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
