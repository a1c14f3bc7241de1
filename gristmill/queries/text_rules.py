"""Scrubbing, clipping, page and label predicates, log formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import logs, scrub
from gristmill.queries._base import query, table


def _docs(spark: SparkSession, sf_dir: str, made: Column, name: str = "x") -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", made.alias(name))


def _sql(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


_TREE = "concat('-LRB- ', substr(coalesce(text, ''), 1, 300), ' -RRB- , ``a_b'''' ; -LSB- c ( d ) .')"
_REPLACED = "x"
for _a, _b in scrub.BRACKETS:
    _REPLACED = f"replace({_REPLACED}, {_sql(_a)}, {_sql(_b)})"


@query(f"WITH d AS (SELECT doc_id, {_TREE} AS x FROM documents) SELECT doc_id, replace(regexp_replace(regexp_replace(trim(regexp_replace({_REPLACED}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' ([,.;:!?%)])', '\\1', 'g'), '[(] ', '(', 'g'), '_', ' ') AS clean FROM d")
def bracket_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.lit("-LRB- "), F.substring(F.coalesce("text", F.lit("")), 1, 300), F.lit(" -RRB- , ``a_b'' ; -LSB- c ( d ) ."))
    return _docs(spark, sf_dir, x).select("doc_id", scrub.plain_brackets(F.col("x")).alias("clean"))


_HEADS = ("[Bug] ", "🛑 (ui) <win> ", "fix: ", "【x】: [a] [b] [c] ", "", "⚠️ Feature request: ")
_TITLED = f"([{', '.join(_sql(h) for h in _HEADS)}])[(doc_id % 6 + 1)::INT] || substr(coalesce(text, ''), 1, 60)"
_TAGS = "x"
for _ in range(3):
    _TAGS = f"regexp_replace({_TAGS}, {_sql(scrub.TITLE_TAG)}, '')"
_BODIED = "'## Steps' || chr(10) || coalesce(text, '') || chr(10) || '<!-- a' || chr(10) || 'b -->' || chr(10) || chr(10) || chr(10) || '  ' || chr(10) || '- [x] done' || chr(10) || '**Expected**:' || chr(10) || '_No response_' || chr(10) || 'end  '"


@query(f"""WITH d AS (SELECT doc_id, regexp_replace({_TITLED}, {_sql(scrub.LEAD_SYMBOLS)}, '') AS x, {_BODIED} AS b FROM documents)
SELECT doc_id, trim(regexp_replace({_TAGS}, {_sql(scrub.TITLE_PREFIX)}, '')) AS title, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, {_sql(scrub.COMMENT)}, '', 'g'), {_sql(scrub.HEADING)}, '', 'g'), '\\n\\s*\\n(\\s*\\n)+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS body FROM d""")
def issue_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without tags and prefixes; bodies without what a template wrote."""
    text = F.coalesce(F.col("text"), F.lit(""))
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % 6 + 1).cast("int"))
    made = F.struct(F.concat(head, F.substring(text, 1, 60)).alias("t"), F.concat(F.lit("## Steps\n"), text, F.lit("\n<!-- a\nb -->\n\n\n  \n- [x] done\n**Expected**:\n_No response_\nend  ")).alias("b"))
    return _docs(spark, sf_dir, made).select("doc_id", scrub.title(F.col("x.t")).alias("title"), F.md5(scrub.body(F.col("x.b"))).alias("body"))


@query("""WITH d AS (SELECT doc_id, lang, string_split('choice: ' || lang || chr(10) || substr(coalesce(text, ''), 1, 200) || chr(10) || '  choice: xx ' || chr(10) || chr(9) || 'choice:  yes' || chr(10) || 'choice is yes', chr(10)) AS l FROM documents),
k AS (SELECT doc_id, list_filter(l, lambda x: NOT (regexp_matches(x, '^[ \\t]*choice:') AND list_contains(['yes', lang], regexp_extract(x, '^[ \\t]*choice:[ \\t]*(.*?)[ \\t]*$', 1)))) AS l FROM d)
SELECT doc_id, len(l) AS lines, md5(regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS state FROM k""")
def choice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed choices that name an option go; others stay."""
    x = F.concat(F.lit("choice: "), F.col("lang"), F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, 200), F.lit("\n  choice: xx \n\tchoice:  yes\nchoice is yes"))
    out = _docs(spark, sf_dir, x)
    state = scrub.without_choices(F.col("x"), F.array(F.lit("yes "), F.col("lang")))
    return out.select("doc_id", (F.size(F.split("x", "\n")) - 2).cast("long").alias("lines"), F.md5(state).alias("state"))


@query("""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS x FROM documents), h AS (SELECT doc_id, x, substr(x, 1, 160) AS head FROM d), e AS (SELECT *, length(regexp_extract(head, '(?s)^(.*\\.)[ \\n]', 1)) AS stop FROM h)
SELECT doc_id, CASE WHEN length(x) <= 160 THEN x WHEN stop - 1 > 80 THEN substr(head, 1, stop) ELSE head END AS clipped FROM e""")
def clip_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, scrub.clip_sentence(F.coalesce(F.col("text"), F.lit("")), 160), "clipped").select("doc_id", "clipped")


@query(f"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {_sql(scrub.PICTURE)}, ' ', 'g') AS x FROM documents), l AS (SELECT doc_id, list_transform(regexp_split_to_array(x, '\\r?\\n'), lambda l: len(regexp_extract_all(l, '[A-Za-z]{{3,}}'))) AS n FROM d)
SELECT doc_id, coalesce(list_sum(list_filter(n, lambda k: k >= 8)), 0)::BIGINT AS prose_words FROM l""")
def prose_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, scrub.prose_words(F.coalesce(F.col("text"), F.lit(""))), "prose_words").select("doc_id", "prose_words")


_TAILS = ("", "\n## References\n", "\n[1] Smith\n[2] Jones\n- [3] Brown\n[14] Lee\n", "\nProc. Conference Journal 2001 2002 2003 2004 2005 2006 2007 2008a 2009 2010 1999", "\nAppendix B.\n", "\n" + "[3] x\n" * 8 + "1. Smith, a\nBrown, A.\n")
_TAILED = f"coalesce(text, '') || ([{', '.join('replace(' + _sql(t.replace(chr(10), '|')) + ', ' + _sql('|') + ', chr(10))' for t in _TAILS)}])[(doc_id % 6 + 1)::INT]"


@query(f"""WITH d AS (SELECT doc_id, {_TAILED} AS x FROM documents), c AS (SELECT doc_id, x, len(regexp_extract_all(x, {_sql(scrub.VENUE)})) AS v, len(regexp_extract_all(x, {_sql(scrub.YEAR)})) AS y, list_filter(regexp_split_to_array(x, '\\r?\\n'), lambda l: trim(l) <> '') AS l, len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) AS w FROM d)
SELECT doc_id, regexp_matches(x, {_sql(scrub.BACK_HEAD)}) OR len(regexp_extract_all(x, {_sql(scrub.BIB_ENTRY)})) >= 4 OR (v >= 3 AND y >= 10) OR (v >= 6 AND v + y >= w / 25) AS back_matter, len(l) >= 8 AND len(list_filter(l, lambda s: regexp_matches(s, {_sql(scrub.CITED_LINE)}))) >= greatest(4, 0.2 * len(l)) AS reference_page FROM c""")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are or begin back matter, and pages of citations."""
    x = F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("doc_id") % 6 + 1).cast("int")))
    return _docs(spark, sf_dir, x).select("doc_id", scrub.is_back_matter(F.col("x")).alias("back_matter"), scrub.is_reference_page(F.col("x")).alias("reference_page"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 4 > 0 THEN repeat(chr(10), 3) || 'Statement' || chr(10) || lang ELSE '' END AS x FROM documents) SELECT doc_id, length(x) AS characters, md5(x) AS state FROM d WHERE contains(x, repeat(chr(10), 3) || 'Statement' || chr(10)) AND length(x) <= 4000""")
def fit_or_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States over the budget, or without their statement, are dropped and never cut."""
    x = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("\n\n\nStatement\n"), F.col("lang"))).otherwise(""))
    made = _docs(spark, sf_dir, x).withColumn("x", scrub.fit(F.col("x"), 4000, "\n\n\nStatement\n")).where("x is not null")
    return made.select("doc_id", F.length("x").cast("long").alias("characters"), F.md5("x").alias("state"))


_LABELS = ("Bug", "status/triage", "kind/bug ", "Feature Request", "⭐ enhancement", "needs-repro | wontfix", "Priority:Low", "docs", "area/ui", "crash-report", "ready for review", "Regression!")
_NORMED = "trim(regexp_replace(regexp_replace(lower({0}), '\\p{{S}}', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"""WITH l AS (SELECT p_partkey, ([{', '.join(_sql(x) for x in _LABELS)}])[(p_partkey % 12 + 1)::INT] || CASE WHEN p_size % 5 = 0 THEN ' ' || lower(p_brand) ELSE '' END AS label FROM part),
p AS (SELECT *, len(list_filter(regexp_split_to_array(label, '[/|]'), lambda s: regexp_matches({_NORMED.format('s')}, {_sql(scrub.WORKFLOW)}))) > 0 AS process, {_NORMED.format('label')} AS n FROM l)
SELECT p_partkey, label, process, regexp_matches(n, {_sql(scrub.BUG_WORDS)}) AND NOT process AS bug, regexp_matches(n, {_sql(scrub.FEATURE_WORDS)}) AND NOT process AS feature FROM p""")
def label_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of workflow, of bugs and of features."""
    label = F.concat(F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % 12 + 1).cast("int")), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(" "), F.lower("p_brand"))).otherwise(""))
    x = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))
    return x.select("p_partkey", "label", scrub.is_process_label(F.col("label")).alias("process"), scrub.is_bug_label(F.col("label")).alias("bug"), scrub.is_feature_label(F.col("label")).alias("feature"))


@query("""WITH d AS (SELECT o_orderkey, o_orderdate, 'Opened. Update 2020-13-45: odd. Update ' || strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') || ': before. ' || 'Update ' || strftime(o_orderdate + to_days((o_orderkey % 3)::INT), '%Y-%m-%d') || ': then. Update 2999-01-01: last' AS x FROM orders),
l AS (SELECT *, list_filter(regexp_extract_all(x, 'Update (\\d{4}-\\d{2}-\\d{2})', 1), lambda d: try_cast(d AS DATE) > o_orderdate::DATE) AS late FROM d) SELECT o_orderkey, CASE WHEN len(late) > 0 THEN rtrim(substr(x, 1, strpos(x, 'Update ' || late[1]) - 1)) ELSE x END AS description FROM l""")
def cut_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text after the first update that is dated after the close goes."""
    day = lambda n: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), n), "yyyy-MM-dd")
    x = F.concat(F.lit("Opened. Update 2020-13-45: odd. Update "), day(-1), F.lit(": before. Update "), day((F.col("o_orderkey") % 3).cast("int")), F.lit(": then. Update 2999-01-01: last"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scrub.cut_after_close(x, F.col("o_orderdate")).alias("description"))


@query("""WITH p AS (SELECT p_partkey, '[''' || p_brand || ''', ''' || p_type || ''']' AS themes FROM part) SELECT t.theme, count(*) AS parts FROM (SELECT p_partkey, unnest(regexp_extract_all(themes, '''([^'']*)''', 1)) AS theme FROM p) t GROUP BY 1""")
def theme_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists stored in printed form, exploded."""
    themes = F.concat(F.lit("['"), F.col("p_brand"), F.lit("', '"), F.col("p_type"), F.lit("']"))
    return table(spark, sf_dir, "part").select(F.explode(scrub.repr_list(themes)).alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).alias("parts"))


_PROTECTED, _GENERATED = ("Brand#1", "Brand#22"), ("Brand#3", "Brand#4")


@query("""SELECT p_brand AS task, starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#22') AS protected, coalesce(CASE WHEN min(p_size) = 1 THEN max(p_size) > 49 END, NOT (starts_with(p_brand, 'Brand#3') OR starts_with(p_brand, 'Brand#4'))) AS real FROM part GROUP BY p_brand""")
def task_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected tasks by prefix; real ones by the corpus's flag or else by prefix."""
    t = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("task")).agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"))
    return t.select("task", scrub.starts_with_any(F.col("task"), _PROTECTED).alias("protected"), scrub.is_real(F.col("task"), F.when(F.col("low") == 1, F.col("high") > 49), _GENERATED).alias("real"))


@query("SELECT e AS epoch, (7::BIGINT * 1000003 + e) % 2147483648 AS seed FROM (SELECT DISTINCT user_id AS e FROM events)")
def epoch_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("epoch")).distinct().select("epoch", scrub.epoch_seed(F.lit(7).cast("long"), F.col("epoch")).alias("seed"))


_NRM = "lower(regexp_replace(trim({0}), '\\s+', ' ', 'g'))"


@query(f"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' short ' ELSE substr(coalesce(text, ''), 1, 10 + (doc_id % 500)::INT) END AS q, ['Yes', 'No way', lang] AS o, CASE WHEN doc_id % 7 = 0 THEN ['one'] ELSE [' yes ', CASE WHEN doc_id % 3 = 0 THEN NULL ELSE repeat(coalesce(lang, ''), 200) END, CASE WHEN doc_id % 2 = 0 THEN 'no  way' ELSE 'meaning ' || source END] END AS d FROM documents),
t AS (SELECT doc_id, trim(q) AS q, o, d, list_transform(range(1, len(d) + 1), lambda i: CASE WHEN trim(coalesce(d[i], '')) = '' OR {_NRM.format("trim(coalesce(d[i], ''))")} = {_NRM.format('o[i]')} OR (list_contains(list_transform(o, lambda k: {_NRM.format('k')}), {_NRM.format("trim(coalesce(d[i], ''))")}) AND length(trim(coalesce(d[i], ''))) < 25) THEN NULL ELSE substr(trim(d[i]), 1, 300) END) AS m FROM a)
SELECT doc_id, md5(q) AS question, CASE WHEN len(d) = len(o) AND len(list_filter(m, lambda x: x IS NOT NULL)) > 0 THEN array_to_string(list_transform(m, lambda x: coalesce(x, '-')), '|') END AS descriptions FROM t WHERE length(q) BETWEEN 10 AND 400""")
def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated questions and descriptions, kept where they are usable."""
    k = F.col("doc_id")
    q = F.when(k % 5 == 0, " short ").otherwise(F.substr(F.coalesce("text", F.lit("")), F.lit(1), (10 + k % 500).cast("int")))
    options = F.array(F.lit("Yes"), F.lit("No way"), F.col("lang"))
    d = F.when(k % 7 == 0, F.array(F.lit("one"))).otherwise(F.array(F.lit(" yes "), F.when(k % 3 > 0, F.repeat(F.coalesce("lang", F.lit("")), F.lit(200))), F.when(k % 2 == 0, "no  way").otherwise(F.concat(F.lit("meaning "), F.col("source")))))
    out = table(spark, sf_dir, "documents").select("doc_id", scrub.clean_answer(q, options, d).alias("a")).where("a is not null")
    return out.select("doc_id", F.md5("a.question").alias("question"), F.array_join("a.descriptions", "|", "-").alias("descriptions"))


@query()
def licence_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without a licence's names; lookarounds aren't in the other engine's patterns, so a test holds it against plain Python."""
    x = F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 200), F.lit(" See https://www.gnu.org/licenses/gpl-3.0 or LGPL; the GNU General Public License v3.0 only (GPL-3.0-only), GPLv3, version 3.0."))
    return _docs(spark, sf_dir, scrub.licence(x, "GPL-3.0-only", "GNU General Public License v3.0 only"), "text").select("doc_id", "text")


@query("""SELECT event_id, '[COMPONENT] [LEVEL] ' || 'svc' || user_id % 7 || 'x started; [COMPONENT] /svc' || '/' || user_id % 7 || ' [COMPONENT]' AS shown FROM events""")
def span_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field that an answer was read from, the padding after it, and all whole mentions of the answer."""
    name = F.concat(F.lit("svc"), (F.col("user_id") % 7).cast("string"))
    level = F.upper(F.col("event_type"))
    line = F.concat(name, F.lit(" "), F.rpad(level, 12, " "), name, F.lit("x started; "), F.upper(name), F.lit(" /svc/"), (F.col("user_id") % 7).cast("string"), F.lit(" "), name)
    start = F.length(name) + 1
    blank = scrub.blank_span(line, start, start + F.length(level), "[LEVEL]", eat_padding=True)
    return table(spark, sf_dir, "events").select("event_id", scrub.blank_token(blank, name, "[COMPONENT]").alias("shown"))


#: One line of each format, from a component, a level and a content.
_LINES = {
    "HDFS": "081109 203615 148 {l} {c}: {t}", "Hadoop": "2015-10-18 18:01:47,978 {l} [main] {c}: {t}", "Spark": "17/06/09 20:10:40 {l} {c}: {t}", "Zookeeper": "2015-07-29 17:41:44,747 - {l}  [n1:{c}@774] - {t}",
    "OpenStack": "nova.log 2017-05-16 00:00:00.008 25746 {l} {c} [req-1 a b] {t}", "BGL": "- 1117838570 2005.06.03 R02-M1 2005-06-03-15.42.50 R02-M1 RAS {c} {l} {t}", "HPC": "134681 node-246 {c} state 1077804742 1 {t}",
    "Thunderbird": "- 1131566461 2005.11.09 dn228 Nov 9 12:01:01 dn228/dn228 {c}[2915]: {t}", "Windows": "2016-09-28 04:30:30, {l}                  {c}    {t}", "Linux": "Jun 14 15:16:01 combo {c}[19939]: {t}",
    "Mac": "Jul  1 09:00:55 host {c}[0]: {t}", "Android": "03-17 16:13:38.811  1702  2395 {l} {c}: {t}", "HealthApp": "20171223-22:15:29:606|{c}|30002312|{t}", "Apache": "[Sun Dec 04 04:47:44 2005] [{l}] {t}",
    "OpenSSH": "Dec 10 06:55:46 {c} sshd[24200]: {t}", "Proxifier": "[10.30 16:49:06] {c} - {t}",
}
_SYSTEMS = sorted(_LINES)
_LEVELLED = [s for s in _SYSTEMS if "{l}" in _LINES[s]]
_NAMED = [s for s in _SYSTEMS if "{c}" in _LINES[s]]


@query(f"""WITH e AS (SELECT ([{', '.join(map(_sql, _SYSTEMS))}])[(event_id % 16 + 1)::INT] AS system, event_id % 11 = 0 AS broken, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN' ELSE 'INFO' END AS level FROM events)
SELECT system, count(*) AS lines, sum((NOT broken)::INT)::BIGINT AS parsed, sum((NOT broken AND list_contains([{', '.join(map(_sql, _NAMED))}], system))::INT)::BIGINT AS components, sum((NOT broken AND list_contains([{', '.join(map(_sql, _LEVELLED))}], system) AND level = 'ERROR')::INT)::BIGINT AS errors, sum((NOT broken AND list_contains([{', '.join(map(_sql, _LEVELLED))}], system) AND level = 'WARN')::INT)::BIGINT AS warnings,
sum((NOT broken AND list_contains([{', '.join(map(_sql, _LEVELLED))}], system) AND level = 'INFO')::INT)::BIGINT AS infos FROM e GROUP BY system""")
def log_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sixteen formats parsed back: how many fit, and each system's components and severities."""
    system = F.element_at(F.array(*map(F.lit, _SYSTEMS)), (F.col("event_id") % 16 + 1).cast("int"))
    level = F.when(F.col("event_type") == "error", "err").when(F.col("event_type") == "click", "WARNING").otherwise("I")
    forms = F.create_map(*(F.lit(x) for pair in _LINES.items() for x in pair))
    line = F.element_at(forms, system)
    for a, b in (("{l}", level), ("{c}", F.concat(F.lit("svc.Part"), (F.col("user_id") % 7).cast("string"))), ("{t}", F.concat(F.lit("value: "), F.col("props")))):
        line = F.replace(line, F.lit(a), b)
    rows = table(spark, sf_dir, "events").select(system.alias("system"), F.when(F.col("event_id") % 11 == 0, "??").otherwise(line).alias("line"))
    part = lambda f: logs.parsed(F.col("system"), F.col("line"), f)
    read = rows.select("system", part("Content").alias("content"), F.regexp_like(part("Component"), F.lit("^svc[.]Part[0-6]$")).alias("component"), logs.severity(part("Level")).alias("level"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return read.groupBy("system").agg(
        F.count(F.lit(1)).alias("lines"), count(F.startswith("content", F.lit("value: {"))).alias("parsed"), count(F.col("component")).alias("components"),
        *(count(F.col("level") == v).alias(n) for v, n in (("ERROR", "errors"), ("WARN", "warnings"), ("INFO", "infos"))),
    )
