"""Queries on term extraction over ``documents`` and friends."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodestone.functions import vocabulary as V
from lodestone.functions.text import numbers, stems
from lodestone.operators import terms as op
from lodestone.plans.catalog import query
from lodestone.durable import new_folder
from lodestone.sources import quarantined_json, table, write_partitions

_LIM = 20_000


def sql_pattern(alias: str, exact: bool) -> str:
    return ("" if exact or len(alias) <= 2 else "(?i)") + "(^|[^\\w+#.])" + re.escape(alias).replace("\\ ", " ") + "($|[^\\w+#])"


TERMS_SQL = "terms(canonical, pattern) AS (VALUES " + V.values_sql([(c, sql_pattern(a, x)) for c, a, x in V.TERMS]) + ")"
CLOSURE_SQL = (
    "implies(canonical, implied) AS (VALUES " + V.values_sql(V.IMPLIES) + "), closure(canonical, implied) AS (SELECT canonical, implied FROM implies UNION "
    "SELECT c.canonical, i.implied FROM closure c JOIN implies i ON i.canonical = c.implied)"
)
LINES_SQL = "lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, regexp_replace(unnest(l), '\\s+$', '') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def count_words_sql(x: str) -> str:
    return f"(CASE WHEN trim({x}) = '' THEN 0 ELSE len(regexp_split_to_array(trim({x}), '\\s+')) END)"


_S = "trim(regexp_replace(line, '^[()]+|[()]+$', '', 'g'))"
_BARE = "regexp_replace(s, ':+$', '')"
_RULES = " ".join(f"WHEN regexp_matches(lower(s), '{p}') THEN '{k}'" for _, k, p in sorted(V.HEADING_RULES))
HEADINGS_SQL = f"""trimmed AS (SELECT doc_id, line_no, trim(line) AS line FROM lines WHERE trim(line) <> ''),
stripped AS (SELECT *, {_S} AS s FROM trimmed),
headings AS (SELECT doc_id, line_no, line, CASE WHEN s = '' OR len(s) > 70 OR regexp_matches(s, '[.!?]$') OR contains({_BARE}, ':') THEN NULL
  WHEN lower(trim({_BARE})) IN ('skills', 'job details') THEN 'other'
  WHEN ends_with(s, ':') OR {count_words_sql(_BARE)} <= 6 OR (upper(s) = s AND regexp_matches(s, '\\p{{L}}')) THEN CASE {_RULES} WHEN ends_with(s, ':') THEN 'other' END END AS heading FROM stripped),
filled AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'other') AS kind FROM headings)"""
WEIGHTS_SQL = f"""weighted AS (SELECT * FROM (SELECT doc_id, line_no, line, CASE WHEN kind = 'required' AND regexp_matches(lower(line), '{V.PREFERRED_LINE}') THEN 5
  ELSE CASE kind WHEN 'required' THEN 10 WHEN 'preferred' THEN 5 WHEN 'duties' THEN 5 WHEN 'other' THEN 3 ELSE 0 END END AS w10 FROM filled WHERE heading IS NULL) WHERE w10 > 0)"""
TERM_WEIGHTS_SQL = "tw AS (SELECT doc_id, canonical AS term, max(w10) AS w10 FROM weighted, terms WHERE regexp_matches(line, pattern) GROUP BY ALL)"
WITH_LINES = f"WITH {LINES_SQL}, {HEADINGS_SQL}, {WEIGHTS_SQL}"
WITH_TERMS = f"WITH RECURSIVE {LINES_SQL}, {HEADINGS_SQL}, {WEIGHTS_SQL}, {TERMS_SQL}, {CLOSURE_SQL}, {TERM_WEIGHTS_SQL}"


def stems_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in V.STOP)
    cases = " ".join(f"WHEN ends_with(v, '{x}') AND len(v) - {len(x)} >= 4 THEN left(v, len(v) - {len(x)})" for x in V.SUFFIXES)
    words = f"list_filter(regexp_extract_all({x}, '[A-Za-z][A-Za-z''-]+'), lambda w: len(w) > 2 AND lower(w) NOT IN ({stop}))"
    low = f"list_transform({words}, lambda w: regexp_replace(lower(w), '^[''-]+|[''-]+$', '', 'g'))"
    return f"list_transform({low}, lambda v: CASE {cases} ELSE v END)"


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def weights(spark, sf):
    return op.term_weights(docs(spark, sf), V.terms(spark), **V.SAMPLE)


@query("a1_split_lines", f"WITH {LINES_SQL} SELECT doc_id, line_no::INT AS line_no, line FROM lines")
def a1(spark, sf):
    return op.split_lines(docs(spark, sf))


@query("a2_length_limit", f"SELECT doc_id, coalesce(len(text), 0)::INT AS n, CASE WHEN len(text) > {_LIM} THEN 'JD_TOO_LONG' END AS reason FROM documents")
def a2(spark, sf):
    return op.length_limit(docs(spark, sf))


@query("a3_heading_kind", f"WITH {LINES_SQL}, {HEADINGS_SQL} SELECT doc_id, line_no::INT AS line_no, heading FROM headings")
def a3(spark, sf):
    lines = op.split_lines(docs(spark, sf)).withColumn("line", F.trim("line")).where("line <> ''")
    return lines.select("doc_id", "line_no", op.heading_kind(F.col("line"), V.HEADING_RULES).alias("heading"))


@query("a4_section_fill", f"WITH {LINES_SQL}, {HEADINGS_SQL} SELECT doc_id, line_no::INT AS line_no, line, heading, kind FROM filled")
def a4(spark, sf):
    return op.section_fill(docs(spark, sf), V.HEADING_RULES)


@query("a5_line_weight", f"{WITH_LINES} SELECT doc_id, line_no::INT AS line_no, line, w10::INT AS w10 FROM weighted")
def a5(spark, sf):
    return op.line_weight(docs(spark, sf), **V.SAMPLE)


@query("a6_requirement_text", f"{WITH_LINES} SELECT doc_id, string_agg(line, ' ' ORDER BY line_no) AS requirement FROM weighted WHERE w10 >= 5 GROUP BY doc_id")
def a6(spark, sf):
    return op.requirement_text(docs(spark, sf), **V.SAMPLE)


@query("a7_match_terms", f"WITH {TERMS_SQL} SELECT DISTINCT doc_id, canonical FROM documents, terms WHERE regexp_matches(text, pattern)")
def a7(spark, sf):
    return op.match_terms(docs(spark, sf), V.terms(spark), ["doc_id"])


@query("a8_term_weights", f"{WITH_TERMS} SELECT doc_id, term, w10::INT AS w10 FROM tw")
def a8(spark, sf):
    return weights(spark, sf)


def titles_sql(role: str | None = None) -> str:
    """(doc_id, title) of every document, after ``trimmed``."""
    p = {k: v.replace("\\u2013", "\u2013") for k, v in (op.title_patterns(role) if role else op.title_patterns()).items()}
    fine = f"NOT regexp_matches(line, '{p['boilerplate']}')"
    made = f"regexp_replace(trim(regexp_replace(x, '{p['adjective']}', '')), '{p['plural']}', '\\1')"
    return f"""head AS (SELECT * FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS i FROM trimmed) WHERE i < 40),
labels AS (SELECT *, regexp_extract(line, '{p['label']}', 1) AS label, trim(regexp_extract(line, '{p['area']}', 1)) AS area FROM head),
phrases AS (SELECT doc_id, i, j, upper(left(t, 1)) || substr(t, 2) AS t FROM (SELECT doc_id, i, j, {made} AS t FROM (SELECT doc_id, i, generate_subscripts(x, 1) AS j, unnest(x) AS x FROM (SELECT doc_id, i, regexp_extract_all(line, '{p['phrase']}', 1) AS x FROM head)))),
options AS (SELECT doc_id, 1 AS rule, i, 0 AS j, label AS title FROM labels WHERE label <> '' AND regexp_matches(label, '(?i){p['role']}')
UNION ALL SELECT doc_id, 2, i, 0, line FROM labels WHERE i < 3 AND regexp_matches(line, '(?i)\\b{p['role']}') AND len(line) <= 90 AND {count_words_sql('line')} <= 10 AND NOT regexp_matches(line, '[.!?]$') AND NOT regexp_matches(line, '{p['phrase']}') AND {fine}
UNION ALL SELECT doc_id, 3, i, 0, area FROM labels WHERE i < 8 AND area <> '' AND {fine}
UNION ALL SELECT doc_id, CASE WHEN {count_words_sql('t')} >= 2 THEN 4 ELSE 5 END, i, j, t FROM phrases),
titles AS (SELECT doc_id, coalesce(title, '') AS title FROM documents LEFT JOIN (SELECT doc_id, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule, i, j, title) AS r FROM options) WHERE r = 1) USING (doc_id))"""


@query("a8_titled_weights", f"""{WITH_TERMS}, {titles_sql(V.ROLE_NAMES)}, named AS (SELECT doc_id, term, w10 FROM tw UNION ALL SELECT doc_id, canonical, 10 FROM titles, terms WHERE regexp_matches(title, pattern))
SELECT doc_id, term, max(w10)::INT AS w10 FROM named GROUP BY ALL""")
def a8t(spark, sf):
    """As ``a8_term_weights``, and the terms of a document's title weigh 10, even where their line does not count."""
    return op.term_weights(docs(spark, sf), V.terms(spark), op.extract_title(docs(spark, sf), V.ROLE_NAMES), **V.SAMPLE)


@query("a9_extract_title", f"WITH {LINES_SQL}, {HEADINGS_SQL}, {titles_sql()} SELECT doc_id, title FROM titles")
def a9(spark, sf):
    return op.extract_title(docs(spark, sf))


@query("a10_implied_terms", f"""WITH RECURSIVE {TERMS_SQL}, {CLOSURE_SQL}, m AS (SELECT DISTINCT doc_id, canonical FROM documents, terms WHERE regexp_matches(text, pattern))
SELECT doc_id, canonical FROM m UNION SELECT doc_id, implied FROM m JOIN closure USING (canonical)""")
def a10(spark, sf):
    return op.implied_terms(op.match_terms(docs(spark, sf), V.terms(spark), ["doc_id"]), V.implies(spark), ["doc_id"])


@query("a11_top_terms", f"""{WITH_TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w10 DESC, term) AS r FROM tw)
SELECT doc_id, string_agg(term, ', ' ORDER BY r) AS top FROM r WHERE r <= 5 GROUP BY doc_id""")
def a11(spark, sf):
    return op.top_terms(weights(spark, sf))


_UNKNOWN = """SELECT * FROM (SELECT DISTINCT {key}, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+#.]*')) AS token FROM {table})
WHERE ((regexp_matches(token, '[a-z]') AND regexp_matches(token, '[A-Z]')) OR regexp_matches(token, '[.+#0-9]') OR regexp_matches(token, '^[A-Z]{{2,6}}$'))
AND NOT regexp_matches(token, '{aliases}')"""
_ALIASES = "|".join(f"({sql_pattern(a, x).replace('(?i)', '(?i:', 1) + ')' if sql_pattern(a, x).startswith('(?i)') else sql_pattern(a, x)})" for _, a, x in V.TERMS)


@query("a13_unknown_terms", _UNKNOWN.format(key="doc_id", table="documents", aliases=_ALIASES))
def a13(spark, sf):
    return op.unknown_terms(docs(spark, sf), V.terms(spark), ["doc_id"])


@query("a14_term_queue", f"""WITH n AS ({_UNKNOWN.format(key="doc_id", table="documents", aliases=_ALIASES)}),
q AS ({_UNKNOWN.format(key="conv_id", table="conversations", aliases=_ALIASES)}),
u AS (SELECT token AS term, min(conv_id) AS first_seen, count(*) AS count, 'reviewed' AS status, 1 AS old FROM q GROUP BY token
UNION ALL SELECT token, min(doc_id), count(*), 'new', 0 FROM n GROUP BY token)
SELECT term, min(first_seen) AS first_seen, sum(count)::BIGINT AS count, max_by(status, old) AS status FROM u GROUP BY term""")
def a14(spark, sf):
    """The queue of terms seen in conversations, updated with those of documents; ids stand for times."""
    old = op.unknown_terms(table(spark, sf, "conversations"), V.terms(spark), ["conv_id"]).groupBy(F.col("token").alias("term"))
    queue = old.agg(F.min("conv_id").alias("first_seen"), F.count("*").alias("count")).withColumn("status", F.lit("reviewed"))
    new = op.unknown_terms(docs(spark, sf), V.terms(spark), ["doc_id"]).select(F.col("token").alias("term"), F.col("doc_id").alias("seen"))
    return op.term_queue(new, queue)


@query("a15_order_items_by_weight", f"""{WITH_TERMS}, f AS (SELECT doc_id, min_by(line, line_no) AS detail FROM trimmed WHERE contains(line, ',') GROUP BY doc_id),
i AS (SELECT * FROM (SELECT doc_id, generate_subscripts(l, 1) AS pos, trim(unnest(l)) AS item FROM (SELECT doc_id, string_split(detail, ',') AS l FROM f)) WHERE item <> ''),
b AS (SELECT i.doc_id, pos, max(w10) AS w10 FROM i, terms, tw WHERE regexp_matches(item, pattern) AND tw.doc_id = i.doc_id AND tw.term = canonical GROUP BY ALL)
SELECT doc_id, string_agg(item, ', ' ORDER BY coalesce(w10, 0) DESC, pos) AS ordered FROM i LEFT JOIN b USING (doc_id, pos) GROUP BY doc_id""")
def a15(spark, sf):
    """The detail of a document is its first line with a comma."""
    lines = op.split_lines(docs(spark, sf)).withColumn("line", F.trim("line")).where(F.contains("line", F.lit(",")))
    detail = lines.groupBy("doc_id").agg(F.min_by("line", "line_no").alias("detail"))
    return op.order_items_by_weight(detail, weights(spark, sf), V.terms(spark))


@query("a16_fingerprint", f"""{WITH_TERMS}, l AS (SELECT doc_id, string_agg(term || '=' || w10, chr(10) ORDER BY term || '=' || w10) AS body FROM tw GROUP BY doc_id)
SELECT doc_id, sha256(source || chr(10) || coalesce(body, '')) AS fingerprint FROM documents LEFT JOIN l USING (doc_id)""")
def a16(spark, sf):
    """The source stands for the title."""
    titles = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"))
    return op.fingerprint(docs(spark, sf), weights(spark, sf), titles)


@query("a17_section_role", """WITH h AS (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages)
SELECT page_id, heading, CASE WHEN regexp_replace(lower(heading), '\\s+', '', 'g') = 'thaninhethhewh.' THEN 'projects' WHEN contains(lower(heading), 'project') OR contains(lower(heading), 'tion') THEN 'projects'
WHEN contains(lower(heading), 'experience') OR contains(lower(heading), 'the') THEN 'experience' ELSE 'other' END AS role FROM h""")
def a17(spark, sf):
    overrides = spark.createDataFrame([("Thaninhe  Thhewh.", "projects")], "heading string, role string")
    headings = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"))
    return op.section_role(headings, overrides, V.ROLES)


@query("a18_normalise_text", """SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS text, len(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) > 1000 AS too_long FROM conversations""")
def a18(spark, sf):
    out = table(spark, sf, "conversations").select("conv_id", "turn", op.normalise_text(F.col("text")).alias("text"))
    return out.withColumn("too_long", F.length("text") > 1000)


@query("a19_ending_convention", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT doc_id, CASE WHEN count_if(trim(line) <> '') > 0 THEN count_if(ends_with(trim(line), '.')) * 2 > count_if(trim(line) <> '') END AS convention FROM l GROUP BY doc_id),
t AS (SELECT doc_id, convention, regexp_replace(line, '\\s+$', '') AS t, line FROM l JOIN c USING (doc_id))
SELECT doc_id, convention, count(*) AS lines, count_if(line <> CASE WHEN convention THEN CASE WHEN regexp_matches(t, '[A-Za-z0-9)%]$') THEN t || '.' ELSE t END
WHEN NOT convention THEN CASE WHEN regexp_matches(t, '(^|[^.])\\.$') THEN left(t, len(t) - 1) ELSE t END ELSE line END)::BIGINT AS changed FROM t GROUP BY doc_id, convention""")
def a19(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    both = lines.join(op.ending_convention(lines, "doc_id", "line"), "doc_id")
    changed = F.count_if(op.apply_ending(F.col("line"), F.col("convention")) != F.col("line"))
    return both.groupBy("doc_id", "convention").agg(F.count("*").alias("lines"), changed.alias("changed"))


@query("a20_resolve_labels")
def a20(spark, sf):
    titles = {"the": "Library", "the-of": "Search", "of": "Index"}
    return table(spark, sf, "conversations").select("conv_id", "turn", op.resolve_labels(F.col("text"), titles).alias("text"))


@query("a21_stems", f"SELECT doc_id, generate_subscripts(s, 1)::INT - 1 AS pos, unnest(s) AS stem FROM (SELECT doc_id, {stems_sql('text')} AS s FROM documents)")
def a21(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(stems(F.col("text"))).alias("pos", "stem"))


def numbers_sql(rows: str, keys: str) -> str:
    """(keys, value, version), distinct, of the numbers in ``text`` of ``rows``.

    DuckDB's patterns look neither ahead nor behind, so all marks are doubled: a border takes one and leaves one to the next match.
    """
    words = "|".join(V.NUMBER_WORDS)
    pattern = f"(?i)(?:^|[^\\w.])(\\d+(?:(?:\\.\\.|,,)\\d+)*)(?:(?:\\s\\s)?([A-Za-z]{{1,4}}))?(?:\\W|$)|(?:^|[^\\w-])({words})(?:[^\\w-]|$)"
    raw, unit, word = (f"unnest(regexp_extract_all(t, '{pattern}', {i}))" for i in (1, 2, 3))
    value = "CASE lower(word) " + " ".join(f"WHEN '{w}' THEN {n}.0" for w, n in V.NUMBER_WORDS.items()) + " END"
    factor = "CASE unit " + " ".join(f"WHEN '{u}' THEN {x}" for u, x in V.MULTIPLIERS.items()) + " ELSE 1.0 END"
    return f"""SELECT DISTINCT {keys}, CASE WHEN word <> '' THEN {value}::DOUBLE WHEN dots <= 1 THEN replace(raw, ',', '')::DOUBLE * ({factor})::DOUBLE END AS value, CASE WHEN word = '' AND dots > 1 THEN raw END AS version
FROM (SELECT *, len(raw) - len(replace(raw, '.', '')) AS dots FROM (SELECT {keys}, replace(replace(coalesce({raw}, ''), '..', '.'), ',,', ',') AS raw, coalesce({unit}, '') AS unit, coalesce({word}, '') AS word
FROM (SELECT {keys}, regexp_replace(text, '(\\W)', '\\1\\1', 'g') AS t FROM {rows})))"""


@query("a22_numbers", numbers_sql("documents", "doc_id"))
def a22(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(numbers(F.col("text"))).alias("n")).select("doc_id", "n.value", "n.version")


@query("i1_explode_variants", "SELECT conv_id AS owner_id, role AS cand_id, turn::INT AS length, text FROM conversations WHERE turn % 3 <> 2")
def i1(spark, sf):
    """Turns as texts by length, packed to JSON and taken apart again; every third key has no leading integer."""
    key = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("turn "), F.col("turn"))).otherwise(F.concat(F.col("turn"), F.lit(" lines")))
    packed = table(spark, sf, "conversations").select(F.col("conv_id").alias("owner_id"), F.col("role").alias("cand_id"), F.to_json(F.create_map(key, "text")).alias("variants"))
    return op.explode_variants(packed)


_NOTES = "SELECT conv_id AS owner_id, role AS cand_id, turn::INT AS length, text FROM conversations WHERE text IS NOT NULL"


@query("i1_json_notes", f"SELECT owner_id, cand_id, length, text FROM ({_NOTES}) WHERE (owner_id + length) % 11 <> 5")
def i1j(spark, sf):
    """Turns written as JSON lines, every eleventh cut off as by a failed writer; what parses is kept in partitions by role and read again."""
    return _json_notes(spark, sf)[0]


@query("i1_json_quarantine", f"SELECT count(*) AS broken FROM ({_NOTES}) WHERE (owner_id + length) % 11 = 5")
def i1q(spark, sf):
    """The lines that did not parse, kept whole in a table of their own."""
    return _json_notes(spark, sf)[1].agg(F.count("*").alias("broken"))


def _json_notes(spark, sf):
    turns = table(spark, sf, "conversations").where("text is not null")
    line = F.to_json(F.struct(F.col("conv_id").alias("owner_id"), F.col("role").alias("cand_id"), F.col("turn").alias("length"), "text"))
    cut = F.when((F.col("conv_id") + F.col("turn")) % 11 == 5, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line)
    folder, kept = new_folder(spark, "notes"), new_folder(spark, "kept")
    turns.select(cut.alias("value")).write.text(folder)
    good, bad = quarantined_json(spark, folder, "owner_id long, cand_id string, length int, text string")
    write_partitions(good, kept, "cand_id")
    return spark.read.schema(good.schema).parquet(kept).select("owner_id", "cand_id", "length", "text"), bad
