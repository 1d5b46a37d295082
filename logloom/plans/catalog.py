"""All queries of the log operators and their DuckDB counterparts.

Two log relations are derived alike in both engines: ``log_ev`` (a line per event, five templates) for relational operators, and
``log_doc`` (a line per line of a document) for mining.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import variables as V
from ..operators import anonymize, cluster, edit, evaluate, generate, grouping, hosts, ids, search, stats, tags
from ..sources.views import document_log, event_log

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

EV = r"""log_ev AS (SELECT event_id + 1 AS lid, date_trunc('second', ts) AS dt,
 'R' || lpad((user_id % 4)::varchar, 2, '0') || '-M' || (user_id % 2) || '-N' || (user_id % 16) AS host,
 [event_type, 'user', user_id::varchar, 'value', floor(value)::bigint::varchar, 'k', regexp_extract(props, '(\d+)', 1)] AS w FROM events),
t AS (SELECT *, [CASE WHEN regexp_matches(x, '^\d+$') THEN '**' ELSE x END for x in w] AS tpl FROM log_ev),
k AS (SELECT tpl, min(lid) AS f, count(*) AS c FROM t GROUP BY tpl),
lt AS (SELECT dense_rank() OVER (ORDER BY f) - 1 AS ltid, tpl, c, f FROM k),
log AS (SELECT lid, ltid, dt, host, w, t.tpl FROM t JOIN lt ON t.tpl = lt.tpl),
ltg AS (SELECT ltid, ltid // 2 AS ltgid FROM lt)"""
DOC = r"""doc_lines AS (SELECT doc_id, source AS host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
doc_split AS (SELECT doc_id, host, pos, string_split(line, ' ') AS s FROM doc_lines WHERE line <> ''),
log_doc AS (SELECT row_number() OVER (ORDER BY doc_id, pos) AS lid, host, [regexp_replace(x, '([\\*@])', '\\\1', 'g') for x in s] AS w FROM doc_split)"""
RULES = tags.TagRules(
    {"fault": [(["err"], False), (["fail"], True)], "trade": [(["PURCHASE", "user$"], True)], "web": [(["click$"], False), (["view$"], False)]},
    {"operations": ["fault"], "business": ["trade", "web"]},
)
TAGS = """tagged AS (SELECT ltid, CASE WHEN len([x for x in tpl if regexp_matches(x, '^(?:err)')]) > 0 OR len([x for x in tpl if regexp_matches(x, '(?i)^(?:fail)')]) > 0 THEN 'fault'
 WHEN len([x for x in tpl if regexp_matches(x, '(?i)^(?:PURCHASE)')]) > 0 AND len([x for x in tpl if regexp_matches(x, '(?i)^(?:user$)')]) > 0 THEN 'trade'
 WHEN len([x for x in tpl if regexp_matches(x, '^(?:click$|view$)')]) > 0 THEN 'web' END AS label FROM lt),
tag AS (SELECT ltid, CASE label WHEN 'fault' THEN 'operations' WHEN 'trade' THEN 'business' WHEN 'web' THEN 'business' END AS tag FROM tagged WHERE label IS NOT NULL)"""
TIERS = [hosts.Tier("midplane", [{"pattern": r"^(R\d+-M\d)"}]), hosts.Tier("rack", [{"pattern": r"^(R\d+)", "replacement": r"\1/all"}])]
HG = r"""hg AS (SELECT 'midplane' AS tier, host, regexp_extract(host, '^(R\d+-M\d)', 1) AS hgid FROM (SELECT DISTINCT host FROM log)
 UNION ALL SELECT 'rack', host, regexp_extract(host, '^(R\d+)', 1) || '/all' FROM (SELECT DISTINCT host FROM log))"""
TOP, END = "2024-01-03 00:00:00", "2024-01-10 12:00:00"


class Ev:
    """The event log with templates by rule, groups, tags and host groups."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.lines = event_log(spark, sf_dir)
        self.log, self.lt = ids.assign(generate.by_rules(self.lines))
        self.ltg = self.lt.select("ltid", F.floor(F.col("ltid") / 2).cast("long").alias("ltgid"))

    @property
    def tags(self) -> DataFrame:
        return tags.tag_templates(self.lt, RULES, "group")

    @property
    def hg(self) -> DataFrame:
        return hosts.host_groups(stats.hosts(self.log), TIERS)


def query(sql: str | None = None, *, ev: str = "", doc: bool = False):
    """Register a query by its function's name. sql follows the CTEs: ``ev`` those of the event log and more, ``doc`` those of documents."""

    def kept(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql is not None:
            parts = [x for x in (EV if ev else "", ev if ev and ev != "ev" else "", DOC if doc else "") if x]
            ORACLES[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql
        return f

    return kept


def _text(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.array_join(n, " "))
    return df


LINE = "SELECT lid, ltid, dt, host, array_to_string(w, ' ') AS words FROM log"


def _lines(df: DataFrame) -> DataFrame:
    return _text(df.select("lid", "ltid", "dt", "host", "words"), "words")


# --- searches


@query("SELECT host, ltid, count(*) AS n FROM log GROUP BY ALL", ev="ev")
def host_template_counts(spark, d):
    return Ev(spark, d).log.groupBy("host", "ltid").agg(F.count(F.lit(1)).alias("n"))


@query(f"{LINE} WHERE dt >= '{TOP}' AND dt < '{END}' AND host = 'R01-M1-N5'", ev="ev")
def log_filter_time_host(spark, d):
    return _lines(search.search(Ev(spark, d).log, dts=TOP, dte=END, host="R01-M1-N5"))


@query(f"{LINE} WHERE ltid = 1", ev="ev")
def log_by_ltid(spark, d):
    return _lines(search.search(Ev(spark, d).log, ltid=1))


@query(f"{LINE} WHERE lid = 77", ev="ev")
def log_line(spark, d):
    return _lines(search.line(Ev(spark, d).log, 77))


@query(f"{LINE} WHERE dt >= '2024-01-05' AND dt < '2024-01-06'", ev="ev")
def log_by_date(spark, d):
    return _lines(search.search(Ev(spark, d).log, **search.parse_conditions(["date=2024-01-05"])))


@query(f"{LINE} WHERE host ILIKE 'r02-m%'", ev="ev")
def log_host_ilike(spark, d):
    return _lines(search.search(Ev(spark, d).log, host_like="r02-m%"))


@query(f"{LINE} WHERE regexp_matches(host, 'M1-N1[0-9]$')", ev="ev")
def log_host_regexp(spark, d):
    return _lines(search.search(Ev(spark, d).log, host_regexp="M1-N1[0-9]$"))


@query(f"{LINE} WHERE host IN ('R00-M0-N0', 'R03-M1-N15')", ev="ev")
def log_host_in(spark, d):
    return _lines(search.search(Ev(spark, d).log, host_in=["R00-M0-N0", "R03-M1-N15"]))


@query(f"{LINE} WHERE false", ev="ev")
def log_host_in_empty(spark, d):
    return _lines(search.search(Ev(spark, d).log, host_in=[]))


@query(f"{LINE} WHERE ltid IN (SELECT ltid FROM ltg WHERE ltgid = 1)", ev="ev")
def log_by_ltgid_semi(spark, d):
    e = Ev(spark, d)
    return _lines(search.search(e.log, groups=e.ltg, ltgid=1))


@query(f"{LINE} WHERE host IN (SELECT host FROM hg WHERE tier = 'midplane' AND hgid = 'R02-M0')", ev=HG)
def log_by_hostgroup(spark, d):
    e = Ev(spark, d)
    return _lines(search.search(e.log, host_groups=e.hg, hg=("midplane", "R02-M0")))


@query(f"{LINE} WHERE host = 'R02-M0-N2'", ev="ev")
def log_by_hostgroup_identity(spark, d):
    e = Ev(spark, d)
    return _lines(search.search(e.log, host_groups=e.hg, hg=("never made", "R02-M0-N2")))


@query(f"{LINE} WHERE ltid = 0 ORDER BY lid LIMIT 25", ev="ev")
def log_limit(spark, d):
    return _lines(search.search(Ev(spark, d).log, ltid=0, limit=25))


@query(f"{LINE} ORDER BY lid", ev="ev")
def log_all(spark, d):
    return _lines(Ev(spark, d).log).orderBy("lid")


@query("SELECT lid, array_to_string(w, ' ') AS words FROM log WHERE ltid = 2", ev="ev")
def log_words(spark, d):
    return _text(search.search(Ev(spark, d).log, ltid=2).select("lid", "words"), "words")


@query("SELECT lid, host, array_to_string(w, ' ') AS words FROM log WHERE NOT contains(array_to_string(w, ' '), 'click') AND NOT contains(array_to_string(w, ' '), 'k 9')", ev="ev")
def log_drop_messages(spark, d):
    from ..sources.parse import drop_messages

    lines = Ev(spark, d).log.withColumn("value", F.array_join("words", " "))
    return drop_messages(lines, ["click", "k 9"]).select("lid", "host", F.col("value").alias("words"))


# --- projections


@query("SELECT lid, array_to_string([w[i] for i in generate_series(1, len(w)) if tpl[i] = '**'], ' ') AS vars FROM log", ev="ev")
def message_vars(spark, d):
    joined = search.with_templates(*(lambda e: (e.log, e.lt))(Ev(spark, d)))
    return joined.select("lid", F.array_join(T.variables(F.col("words"), F.col("ltw")), " ").alias("vars"))


@query("SELECT ltid, array_to_string([i - 1 for i in generate_series(1, len(tpl)) if tpl[i] = '**'], ' ') AS places, array_to_string([x for x in tpl if x <> '**'], ' ') AS description, c AS n FROM lt", ev="ev")
def template_parts(spark, d):
    lt = Ev(spark, d).lt
    return lt.select("ltid", F.array_join(T.variable_places(F.col("ltw")), " ").alias("places"), F.array_join(T.description(F.col("ltw")), " ").alias("description"), F.col("count").alias("n"))


@query(
    "SELECT lid, strftime(dt, '%Y-%m-%d %H:%M:%S') || ' ' || host || ' <' || array_to_string(w, ' ') || '>' AS line FROM log",
    ev="ev",
)
def restore_line(spark, d):
    e = Ev(spark, d)
    symbols = F.transform(F.sequence(F.lit(0), F.size("ltw")), lambda i: F.when(i == 0, "<").when(i == F.size("ltw"), ">").otherwise(" "))
    return search.messages(search.with_templates(e.log, e.lt.withColumn("lts", symbols))).select("lid", "line")


@query("SELECT lid, array_to_string([replace(replace(replace(x, '\\\\', chr(1)), '\\', ''), chr(1), '\\') for x in w], ' ') AS plain, len(w) AS n FROM log_doc", doc=True)
def unescaped_words(spark, d):
    lines = document_log(spark, d)
    return lines.select("lid", F.array_join(F.transform("words", T.unescape), " ").alias("plain"), F.size("words").cast("long").alias("n"))


@query("SELECT ltid, ltid || coalesce(' (' || tag || ')', '') || ' ' || array_to_string(tpl, ' ') || ' (' || c || ')' AS text FROM lt LEFT JOIN tag USING (ltid)", ev=TAGS)
def template_lines(spark, d):
    e = Ev(spark, d)
    return search.template_lines(e.lt, e.tags)


@query(
    """, p AS (SELECT ltid, unnest(tpl) AS word, generate_subscripts(tpl, 1) - 1 AS wid FROM lt)
SELECT ltid, wid, word, CASE WHEN word = '**' THEN sum((word = '**')::int) OVER (PARTITION BY ltid ORDER BY wid)::bigint - 1 END AS vid FROM p""",
    ev="ev",
)
def template_places(spark, d):
    return search.template_places(Ev(spark, d).lt)


# --- joins


@query("SELECT lid, host, ltid, ltgid, array_to_string(tpl, ' ') AS tpl FROM log JOIN ltg USING (ltid)", ev="ev")
def log_with_templates(spark, d):
    e = Ev(spark, d)
    return search.with_templates(e.log, e.lt, e.ltg).select("lid", "host", "ltid", "ltgid", F.array_join("ltw", " ").alias("tpl"))


@query("SELECT ltid, coalesce(ltgid, ltid) AS ltgid, c AS n FROM lt LEFT JOIN (SELECT * FROM ltg WHERE ltid <> 3) USING (ltid)", ev="ev")
def templates_with_groups(spark, d):
    e = Ev(spark, d)
    return search.templates_with_groups(e.lt, e.ltg.where("ltid != 3")).select("ltid", "ltgid", F.col("count").alias("n"))


@query("SELECT ltid, CASE WHEN coalesce(ltgid, 0) <> 0 THEN ltgid ELSE ltid END AS ltgid FROM lt LEFT JOIN ltg USING (ltid)", ev="ev")
def templates_with_groups_compat(spark, d):
    e = Ev(spark, d)
    return search.templates_with_groups(e.lt, e.ltg, zero_is_missing=True).select("ltid", "ltgid")


@query("SELECT DISTINCT tag FROM ltg LEFT JOIN tag USING (ltid) WHERE ltgid = 0 AND tag IS NOT NULL", ev=TAGS)
def group_tags(spark, d):
    e = Ev(spark, d)
    return stats.group_tags(e.ltg, e.tags, 0)


@query("SELECT ltid, ltgid, array_to_string(tpl, ' ') AS tpl FROM ltg JOIN lt USING (ltid) WHERE ltgid = 1", ev="ev")
def group_members(spark, d):
    e = Ev(spark, d)
    return e.ltg.where("ltgid = 1").join(e.lt, "ltid").select("ltid", "ltgid", F.array_join("ltw", " ").alias("tpl"))


@query(
    """, a(token, alias) AS (VALUES ('r00-m0-n0', 'core'), ('r01-m1-n1', 'edge'))
SELECT lid, coalesce(alias, host) AS host FROM log LEFT JOIN a ON lower(host) = token""",
    ev="ev",
)
def host_normalised(spark, d):
    from ..sources.parse import normalise_hosts

    aliases = spark.createDataFrame([("r00-m0-n0", "core"), ("r01-m1-n1", "edge")], "token string, alias string")
    return normalise_hosts(Ev(spark, d).log, aliases).select("lid", "host")


@query(
    """, a(token, alias) AS (VALUES ('r00-m0-n0', 'core'), ('r01-m1-n1', 'edge'))
SELECT lid, alias AS host FROM log JOIN a ON lower(host) = token""",
    ev="ev",
)
def host_known_only(spark, d):
    from ..sources.parse import normalise_hosts

    aliases = spark.createDataFrame([("r00-m0-n0", "core"), ("r01-m1-n1", "edge")], "token string, alias string")
    return normalise_hosts(Ev(spark, d).log, aliases, drop_undefined=True).select("lid", "host")


# --- aggregations


@query("SELECT coalesce(max(lid), 0) AS last_lid, count(*) AS n_lines FROM log", ev="ev")
def line_count(spark, d):
    return stats.line_count(Ev(spark, d).log)


@query("SELECT min(dt) AS first_dt, max(dt) AS last_dt, date_trunc('day', min(dt))::timestamp AS top, (date_trunc('day', max(dt)) + INTERVAL 1 DAY)::timestamp AS \"end\" FROM log", ev="ev")
def whole_term(spark, d):
    return stats.term(Ev(spark, d).log)


@query("SELECT (SELECT count(*) FROM log) AS n_lines, (SELECT min(dt) FROM log) AS first_dt, (SELECT max(dt) FROM log) AS last_dt, (SELECT count(DISTINCT host) FROM log) AS n_hosts, (SELECT count(*) FROM lt) AS n_templates, (SELECT max(ltgid) + 1 FROM ltg) AS n_groups", ev="ev")
def db_info(spark, d):
    e = Ev(spark, d)
    return stats.info(e.log, e.lt, e.ltg)


@query(f"SELECT count(*) AS n_lines, count(DISTINCT ltid) AS n_templates, count(DISTINCT ltgid) AS n_groups, count(DISTINCT host) AS n_hosts FROM log LEFT JOIN ltg USING (ltid) WHERE dt >= '{TOP}' AND dt < '{END}'", ev="ev")
def db_info_term(spark, d):
    e = Ev(spark, d)
    return stats.term_info(e.log, e.ltg, TOP, END)


@query("SELECT DISTINCT host FROM log", ev="ev")
def whole_host(spark, d):
    return stats.hosts(Ev(spark, d).log)


@query(f"SELECT DISTINCT host, ltid FROM log WHERE dt >= '{TOP}' AND dt < '{END}'", ev="ev")
def whole_host_lt(spark, d):
    return stats.host_templates(search.search(Ev(spark, d).log, dts=TOP, dte=END))


@query("SELECT DISTINCT host, ltgid FROM log JOIN ltg USING (ltid)", ev="ev")
def whole_host_ltg(spark, d):
    e = Ev(spark, d)
    return stats.host_groups_of_templates(e.log, e.ltg)


@query("SELECT DISTINCT ltgid FROM ltg", ev="ev")
def group_ids(spark, d):
    return Ev(spark, d).ltg.select("ltgid").distinct()


@query("SELECT ltgid, count(*) AS n_templates, sum(c)::bigint AS n_lines, min(tags) AS tags FROM lt JOIN ltg USING (ltid) LEFT JOIN (SELECT ltgid, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM ltg JOIN tag USING (ltid) GROUP BY ltgid) USING (ltgid) GROUP BY ltgid", ev=TAGS)
def group_summary(spark, d):
    e = Ev(spark, d)
    return stats.group_summary(e.lt, e.ltg, e.tags)


@query("SELECT tag, count(*) AS n_templates, sum(c)::bigint AS n_lines FROM lt JOIN tag USING (ltid) GROUP BY tag", ev=TAGS)
def tag_stats(spark, d):
    e = Ev(spark, d)
    return stats.tag_summary(e.lt, e.tags)


@query("SELECT tier, hgid, count(DISTINCT host) AS n_hosts, sum(e)::bigint AS n_events FROM hg JOIN (SELECT host, count(DISTINCT ltid) AS e FROM log GROUP BY host) USING (host) GROUP BY tier, hgid", ev=HG)
def hostgroup_summary(spark, d):
    e = Ev(spark, d)
    return stats.host_group_summary(e.log, e.hg)


@query("SELECT word, count(*) AS count FROM (SELECT unnest(w) AS word FROM log) GROUP BY word", ev="ev")
def word_counts_all(spark, d):
    e = Ev(spark, d)
    return stats.word_counts(e.log, e.lt)


@query("SELECT word, sum(c)::bigint AS count FROM (SELECT unnest(tpl) AS word, c FROM lt) WHERE word <> '**' GROUP BY word", ev="ev")
def word_counts_description(spark, d):
    e = Ev(spark, d)
    return stats.word_counts(e.log, e.lt, "description")


VARS = "v AS (SELECT lid, ltid, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS vid FROM (SELECT lid, ltid, [w[i] for i in generate_series(1, len(w)) if tpl[i] = '**'] AS v FROM log))"


@query("SELECT value AS word, count(*) AS count FROM v GROUP BY value", ev=VARS)
def word_counts_variable(spark, d):
    e = Ev(spark, d)
    return stats.word_counts(e.log, e.lt, "variable")


@query("SELECT regexp_replace(x, '[0-9]+', '\\\\d', 'g') AS word, count(*) AS count FROM (SELECT 'n' || value AS x FROM v) GROUP BY 1", ev=VARS)
def word_counts_digit_fold(spark, d):
    e = Ev(spark, d)
    named = e.log.withColumn("words", F.transform("words", lambda w: F.when(w.rlike("^[0-9]+$"), F.concat(F.lit("n"), w)).otherwise(w)))
    return stats.word_counts(named, e.lt, "variable", fold=True)


@query("SELECT ltid, vid, value, count, first_lid, rank FROM (SELECT *, row_number() OVER (PARTITION BY ltid, vid ORDER BY count DESC, first_lid) AS rank FROM (SELECT ltid, vid, value, count(*) AS count, min(lid) AS first_lid FROM v GROUP BY ALL)) WHERE rank <= 5", ev=VARS)
def lt_breakdown_topn(spark, d):
    e = Ev(spark, d)
    return generate.top_values(stats.variable_values(e.log, e.lt), 5)


@query("SELECT ltid, vid, count(DISTINCT value) AS variety FROM v GROUP BY ltid, vid HAVING count(DISTINCT value) <= 100", ev=VARS)
def lt_stable_variables(spark, d):
    e = Ev(spark, d)
    return stats.stable_variables(e.log, e.lt, 100)


@query("SELECT word, occurrences, (SELECT count(*) FROM log_doc) AS n_lines FROM (SELECT word, count(*) AS occurrences FROM (SELECT unnest(w) AS word FROM log_doc) GROUP BY word)", doc=True)
def word_statistics(spark, d):
    return generate.word_statistics(document_log(spark, d))


@query(
    """SELECT ltid, string_agg(CASE WHEN lo = hi THEN lo ELSE '**' END, ' ' ORDER BY p) AS tpl FROM (
SELECT ltid, p, min(x) FILTER (x <> '**') AS lo, max(x) FILTER (x <> '**') AS hi FROM (SELECT ltid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM log) GROUP BY ltid, p) GROUP BY ltid""",
    ev="ev",
)
def tpl_common_from_messages(spark, d):
    return _text(generate.common_template(Ev(spark, d).log), "tpl")


# --- template generators


@query("SELECT lid, array_to_string([CASE WHEN regexp_matches(x, '^\\d+$') THEN '**' ELSE x END for x in w], ' ') AS tpl FROM log_doc", doc=True)
def tpl_re(spark, d):
    return _text(generate.by_rules(document_log(spark, d)).select("lid", "tpl"), "tpl")


@query(
    """, dt AS (SELECT lid, [CASE WHEN regexp_matches(x, '^\\d+$') THEN '**' ELSE x END for x in w] AS tpl FROM log_doc),
g AS (SELECT tpl, min(lid) AS f, count(*) AS c FROM dt GROUP BY tpl)
SELECT dense_rank() OVER (ORDER BY f) - 1 AS ltid, array_to_string(tpl, ' ') AS tpl, c AS count, f AS first_lid FROM g""",
    doc=True,
)
def tpl_re_ids(spark, d):
    return _text(ids.template_table(generate.by_rules(document_log(spark, d))).select("ltid", F.col("ltw").alias("tpl"), "count", "first_lid"), "tpl")


VA = """, p AS (SELECT lid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM log_doc),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x), c AS (SELECT lid, p, p.x, n FROM p JOIN n ON p.x = n.x)"""


@query(VA + " SELECT lid, string_agg(CASE WHEN n > 5 THEN x ELSE '**' END, ' ' ORDER BY p) AS tpl FROM c GROUP BY lid", doc=True)
def tpl_va_static(spark, d):
    return _text(generate.by_frequency(document_log(spark, d), "static", 5).select("lid", "tpl"), "tpl")


@query(VA + " SELECT lid, string_agg(CASE WHEN n > 0.01 * (SELECT count(*) FROM log_doc) THEN x ELSE '**' END, ' ' ORDER BY p) AS tpl FROM c GROUP BY lid", doc=True)
def tpl_va_relative_line(spark, d):
    return _text(generate.by_frequency(document_log(spark, d), "relative-line", 0.01).select("lid", "tpl"), "tpl")


@query(
    VA + ", h AS (SELECT lid, list_sort(list(n))[floor(0.4 * count(*))::int + 1] AS th FROM c GROUP BY lid) SELECT c.lid, string_agg(CASE WHEN n >= th THEN x ELSE '**' END, ' ' ORDER BY p) AS tpl FROM c JOIN h ON c.lid = h.lid GROUP BY c.lid",
    doc=True,
)
def tpl_va_relative_variable(spark, d):
    return _text(generate.by_frequency(document_log(spark, d)).select("lid", "tpl"), "tpl")


RUNNING = """, p AS (SELECT lid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM log_doc),
c AS (SELECT lid, p, x, count(*) OVER (PARTITION BY x ORDER BY lid RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM p)"""


@query(RUNNING + " SELECT lid, string_agg(CASE WHEN n > 0.01 * lid THEN x ELSE '**' END, ' ' ORDER BY p) AS tpl FROM c GROUP BY lid", doc=True)
def tpl_va_online_line(spark, d):
    return _text(generate.by_running_frequency(document_log(spark, d), "relative-line", 0.01).select("lid", "tpl"), "tpl")


@query(
    RUNNING + ", h AS (SELECT lid, list_sort(list(n))[floor(0.4 * count(*))::int + 1] AS th FROM c GROUP BY lid) SELECT c.lid, string_agg(CASE WHEN n >= th THEN x ELSE '**' END, ' ' ORDER BY p) AS tpl FROM c JOIN h ON c.lid = h.lid GROUP BY c.lid",
    doc=True,
)
def tpl_va_online_variable(spark, d):
    return _text(generate.by_running_frequency(document_log(spark, d)).select("lid", "tpl"), "tpl")


DEFINITIONS = ["** user ** value ** k **", "click user ** value ** k **", "** user 7 value ** k **", "view user ** value ** ** 5", "error ** **"]
DEFS = "defs(defid, d) AS (VALUES " + ", ".join(f"({i}::bigint, string_split('{x}', ' '))" for i, x in enumerate(DEFINITIONS)) + """),
fits AS (SELECT lid, defid, d, array_to_string([CASE WHEN x = '**' THEN '0' ELSE '1' END for x in d], '') AS bits FROM log_ev JOIN defs ON len(w) = len(d)
 AND len([i for i in generate_series(1, len(w)) if d[i] = '**' OR d[i] = w[i]]) = len(w))"""


def _definitions(spark):
    return spark.createDataFrame([(i, x.split()) for i, x in enumerate(DEFINITIONS)], "defid long, tpl array<string>")


@query("SELECT lid, min(f.defid) AS defid FROM log_ev LEFT JOIN fits f USING (lid) GROUP BY lid", ev=DEFS)
def tpl_import_table(spark, d):
    return generate.match_definitions(event_log(spark, d), _definitions(spark), "table").select("lid", "defid")


@query("SELECT lid, defid FROM (SELECT l.lid, f.defid, row_number() OVER (PARTITION BY l.lid ORDER BY bits DESC, f.defid) AS r FROM log_ev l LEFT JOIN fits f ON l.lid = f.lid) WHERE r = 1", ev=DEFS)
def tpl_import_tree(spark, d):
    return generate.match_definitions(event_log(spark, d), _definitions(spark)).select("lid", "defid")


@query("SELECT lid, min(f.defid) AS defid FROM log_ev LEFT JOIN (SELECT * FROM fits WHERE defid <> 0) f USING (lid) GROUP BY lid", ev=DEFS)
def tpl_import_removed(spark, d):
    left = generate.remove_definition(_definitions(spark), DEFINITIONS[0].split())
    return generate.match_definitions(event_log(spark, d), left, "table").select("lid", "defid")


@query("SELECT lid, CASE WHEN w[1] = 'click' THEN 'click user ** value ** k **' WHEN w[3] = '7' THEN '** user 7 value ** k **' END AS tpl FROM log_ev", ev="ev")
def tpl_import_ext(spark, d):
    lines = event_log(spark, d).withColumn("statement", F.array_join("words", " "))
    return _text(generate.by_external(lines, ["click user <*> value <*> k <*>", "<*> user 7 value <*> k <*>"]).select("lid", "tpl"), "tpl")


@query("SELECT lid, CASE WHEN f.defid IS NOT NULL THEN 0 ELSE 1 END AS method FROM log_ev LEFT JOIN (SELECT DISTINCT lid, 1 AS defid FROM fits WHERE defid = 1) f USING (lid)", ev=DEFS)
def tpl_joint(spark, d):
    one = _definitions(spark).where("defid = 1")
    made = generate.chain(event_log(spark, d), lambda x: generate.match_definitions(x, one), generate.by_rules)
    return made.select("lid", "method")


@query()  # its SQL pairs all words of a line, too slow on whole texts; tests compare with an independent miner
def tpl_dlog(spark, d):
    return _text(cluster.merged_prefixes(document_log(spark, d)), "tpl")


def _mined(df: DataFrame) -> DataFrame:
    return _text(ids.template_table(df, "cid", "tpl").select("ltid", F.col("ltw").alias("tpl"), "count", "first_lid"), "tpl")


@query()
def tpl_drain(spark, d):
    return _mined(cluster.drain(document_log(spark, d)))


@query()
def tpl_lenma(spark, d):
    return _mined(cluster.lenma(event_log(spark, d)))


@query()
def tpl_shiso(spark, d):
    return _mined(cluster.shiso(event_log(spark, d)))


@query()
def tpl_fttree(spark, d):
    return _mined(cluster.frequent_tree(document_log(spark, d), message_type="length"))


@query()
def tpl_fttree_online(spark, d):
    return _mined(cluster.frequent_tree(document_log(spark, d), message_type="length", online=True))


@query()
def tpl_joint_feedback(spark, d):
    """Two definitions, and drain for the rest of the event log, with feedback."""
    given = [(i, x.split()) for i, x in enumerate(DEFINITIONS[1:3])]
    return _mined(cluster.joint(event_log(spark, d), given, cluster.Drain, cluster.leaf_of(), rules=V.DIGITS))


@query()
def tpl_crf(spark, d):
    """The tagger learns from a documented bounded sample: 1,000 random lines of the whole log, labelled by rule."""
    from ..operators import crf

    lines = event_log(spark, d)
    model = crf.train(generate.by_rules(lines))
    return _text(crf.tag(lines, model).select("lid", "tpl"), "tpl")


@query("SELECT ltid, ltid AS ltgid FROM lt", ev="ev")
def group_identity(spark, d):
    return grouping.identity(Ev(spark, d).lt)


@query()
def group_shiso(spark, d):
    return grouping.by_ngrams(Ev(spark, d).lt)


@query()
def group_fuzzy(spark, d):
    return grouping.by_fuzzy_text(Ev(spark, d).lt)


# --- streams: what a stream over the table gives once it has seen all of it


def _streamed(spark, d, made, mode: str, key: str):
    """The rows of a streaming query over the events, run to the end into memory."""
    import uuid

    name = f"{key}_{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/[e]vents.parquet")  # a pattern, as the table may be one file or a folder
    made(events).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("SELECT date_trunc('day', ts)::timestamp AS start, event_type AS host, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, d):
    from ..streaming import online

    lines = lambda e: e.select(F.col("ts").alias("dt"), F.col("event_type").alias("host"))
    made = _streamed(spark, d, lambda e: online.counts_by_window(lines(e), "1 day"), "complete", "stream_windowed_counts")
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "host", "n")


@query("SELECT event_id + 1 AS lid, event_type || ' user ** value ** k **' AS tpl FROM events")
def stream_drain(spark, d):
    """Drain over the stream of the event log: every line with its template at the end of the stream."""
    from ..streaming import online

    def lines(e: DataFrame) -> DataFrame:
        words = F.array("event_type", F.lit("user"), F.col("user_id").cast("string"), F.lit("value"), F.floor("value").cast("long").cast("string"), F.lit("k"), F.regexp_extract("props", r"(\d+)", 1))
        return e.select(F.lpad((F.col("event_id") + 1).cast("string"), 20, "0").alias("at"), words.alias("words"))

    made = _streamed(spark, d, lambda e: online.drain_stream(lines(e)), "append", "stream_drain")
    return made.select(F.col("at").cast("long").alias("lid"), F.array_join("tpl", " ").alias("tpl"))


# --- edits


def _tables(log: DataFrame, lt: DataFrame) -> DataFrame:
    """Templates with their counts, and the lines that the log has for them."""
    n = log.groupBy("ltid").agg(F.count(F.lit(1)).alias("n_lines"))
    return lt.join(n, "ltid", "left").select("ltid", F.array_join("ltw", " ").alias("tpl"), F.col("count").alias("n"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


PLAIN = "SELECT ltid, array_to_string(tpl, ' ') AS tpl, c AS n, c AS n_lines FROM lt"


@query(
    """SELECT 0 AS ltid, array_to_string([CASE WHEN a.tpl[i] = b.tpl[i] THEN a.tpl[i] ELSE '**' END for i in generate_series(1, 7)], ' ') AS tpl, a.c + b.c AS n, a.c + b.c AS n_lines
FROM lt a, lt b WHERE a.ltid = 0 AND b.ltid = 2 UNION ALL """
    + PLAIN
    + " WHERE ltid NOT IN (0, 2)",
    ev="ev",
)
def edit_merge(spark, d):
    e = Ev(spark, d)
    return _tables(*edit.merge(e.log, e.lt, 0, 2))


REBUILD = """ml AS (SELECT nltid AS ltid, w FROM moved), mp AS (SELECT ltid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM ml),
mt AS (SELECT ltid, string_agg(CASE WHEN lo = hi THEN lo ELSE '**' END, ' ' ORDER BY p) AS tpl FROM (SELECT ltid, p, min(x) AS lo, max(x) AS hi FROM mp GROUP BY ltid, p) GROUP BY ltid)
SELECT ltid, tpl, n, n AS n_lines FROM mt JOIN (SELECT ltid, count(*) AS n FROM ml GROUP BY ltid) USING (ltid)"""


@query(", moved AS (SELECT CASE WHEN w[3] = '8' THEN 5 ELSE 1 END AS nltid, w FROM log WHERE ltid = 1), " + REBUILD + " UNION ALL " + PLAIN + " WHERE ltid <> 1", ev="ev")
def edit_separate(spark, d):
    e = Ev(spark, d)
    return _tables(*edit.separate(e.log, e.lt, 1, 0, "8"))


@query(
    """, fv AS (SELECT w[7] AS x, row_number() OVER (ORDER BY min(lid)) - 1 AS r FROM log WHERE ltid = 1 GROUP BY w[7]),
moved AS (SELECT CASE WHEN r = 0 THEN 1 ELSE r - 1 + 5 END AS nltid, w FROM log JOIN fv ON w[7] = x WHERE ltid = 1), """
    + REBUILD
    + " UNION ALL "
    + PLAIN
    + " WHERE ltid <> 1",
    ev="ev",
)
def edit_split(spark, d):
    e = Ev(spark, d)
    return _tables(*edit.split(e.log, e.lt, 1, 2))


@query(
    """, one AS (SELECT min(w[3]) AS u, count(DISTINCT w[3]) AS n FROM log WHERE ltid = 1)
SELECT ltid, CASE WHEN ltid = 1 AND n = 1 THEN array_to_string([CASE WHEN i = 3 THEN u ELSE tpl[i] END for i in generate_series(1, 7)], ' ') ELSE array_to_string(tpl, ' ') END AS tpl, c AS n
FROM lt, one""",
    ev="ev",
)
def edit_fix(spark, d):
    e = Ev(spark, d)
    _, lt = edit.fix(e.log, e.lt, 1, [0])
    return lt.select("ltid", F.array_join("ltw", " ").alias("tpl"), F.col("count").alias("n"))


@query("SELECT ltid, array_to_string([CASE WHEN ltid = 3 AND i IN (2, 4) THEN '**' ELSE tpl[i] END for i in generate_series(1, 7)], ' ') AS tpl, c AS n, c AS n_lines FROM lt", ev="ev")
def edit_free(spark, d):
    e = Ev(spark, d)
    return _tables(*edit.free(e.log, e.lt, 3, [1, 3]))


@query("SELECT min(ltid) AS ltid, '** user ** value ** k **' AS tpl, sum(c)::bigint AS n, sum(c)::bigint AS n_lines FROM lt", ev="ev")
def edit_merge_dup(spark, d):
    e = Ev(spark, d)
    same = e.lt.withColumn("ltw", F.transform("ltw", lambda t, i: F.when(i == 0, T.WILDCARD).otherwise(t)))
    return _tables(*edit.merge_duplicates(e.log, same))


@query("SELECT ltid, CASE WHEN ltid = 2 THEN 'a **' ELSE array_to_string(tpl, ' ') END AS tpl, CASE WHEN ltid = 2 THEN 9 ELSE c END AS n FROM lt", ev="ev")
def edit_update_template(spark, d):
    lt = edit.update_template(Ev(spark, d).lt, 2, ltw=["a", "**"], count=9)
    return lt.select("ltid", F.array_join("ltw", " ").alias("tpl"), F.col("count").alias("n"))


@query("SELECT ltid, ltgid FROM lt JOIN ltg USING (ltid) WHERE ltid <> 4", ev="ev")
def edit_remove_template(spark, d):
    e = Ev(spark, d)
    lt, ltg = edit.remove_template(e.lt, e.ltg, 4)
    return lt.join(ltg, "ltid").select("ltid", "ltgid")


@query(f"SELECT lid, CASE WHEN host = 'R00-M0-N0' AND dt < '{END}' THEN 99 ELSE ltid END AS ltid FROM log", ev="ev")
def edit_update_lines(spark, d):
    condition = (F.col("host") == "R00-M0-N0") & (F.col("dt") < F.lit(END).cast("timestamp_ntz"))
    return edit.update_lines(Ev(spark, d).log, condition, ltid=99).select("lid", "ltid")


@query("SELECT lid, ltid FROM log UNION ALL SELECT lid + (SELECT max(lid) FROM log), ltid FROM log", ev="ev")
def append_dataset(spark, d):
    log = Ev(spark, d).log.select("lid", "ltid")
    return ids.append(log, log)


# --- tags, hosts, anonymised logs, variables


@query("SELECT ltid, tag FROM tag", ev=TAGS)
def tags_by_group(spark, d):
    return Ev(spark, d).tags


@query("SELECT ltid, 'label_' || label AS tag FROM tagged WHERE label IS NOT NULL UNION ALL SELECT ltid, 'group_' || tag FROM tag", ev=TAGS)
def tags_all(spark, d):
    return tags.tag_templates(Ev(spark, d).lt, RULES, "all")


@query("SELECT tier, host, hgid FROM hg", ev=HG)
def hostgroup_materialize(spark, d):
    return Ev(spark, d).hg


@query("SELECT hgid, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts FROM hg WHERE tier = 'rack' GROUP BY hgid", ev=HG)
def hostgroup_members(spark, d):
    e = Ev(spark, d)
    return hosts.group_members(e.hg, stats.hosts(e.log), "rack")


CROSS = r"""x AS (SELECT DISTINCT host, regexp_extract(host, '^(R\d+)', 1) AS fine, regexp_extract(host, '(\d)$', 1) AS coarse FROM log)"""


@query("SELECT fine, count(DISTINCT coarse) AS n_coarse FROM x GROUP BY fine HAVING count(DISTINCT coarse) > 1", ev=CROSS)
def hostgroup_nesting(spark, d):
    tiers = [hosts.Tier("fine", [{"pattern": r"^(R\d+)"}]), hosts.Tier("coarse", [{"pattern": r"(\d)$"}])]
    return hosts.nesting_violations(hosts.host_groups(stats.hosts(Ev(spark, d).log), tiers), "fine", "coarse")


@query("SELECT DISTINCT host FROM log WHERE NOT regexp_matches(host, 'M1')", ev="ev")
def hostgroup_ordering(spark, d):
    tiers = [hosts.Tier("fine", [{"pattern": "(M1)"}], "drop"), hosts.Tier("coarse", [{"pattern": r"^(R\d+)"}])]
    return hosts.ordering_violations(hosts.host_groups(stats.hosts(Ev(spark, d).log), tiers), "fine", "coarse")


@query("SELECT DISTINCT host FROM log WHERE NOT regexp_matches(host, 'N1[0-9]$')", ev="ev")
def hostgroup_unmatched(spark, d):
    return hosts.unmatched_hosts(stats.hosts(Ev(spark, d).log), hosts.Tier("t", [{"pattern": "(N1[0-9])$"}]))


ANON = "am AS (SELECT host, 'host' || lpad((row_number() OVER (ORDER BY host) - 1)::varchar, length(count(*) OVER ()::varchar)::int, '0') AS a FROM (SELECT DISTINCT host FROM log))"


@query("SELECT lid, a AS host, array_to_string([CASE WHEN x = '**' THEN x ELSE '##' END for x in tpl], ' ') AS words FROM log JOIN am USING (host)", ev=ANON)
def anonymize_log(spark, d):
    e = Ev(spark, d)
    return _text(anonymize.anonymize(e.log, e.lt)[0].select("lid", "host", "words"), "words")


@query("SELECT ltid, array_to_string([CASE WHEN x = '**' THEN x ELSE '##' END for x in tpl], ' ') AS tpl, '|' || repeat(' |', 6) || '' AS symbols FROM lt", ev="ev")
def anonymize_lt(spark, d):
    lt = Ev(spark, d).lt.withColumn("lts", F.array_repeat(F.lit("x"), 8))
    hidden = anonymize.template_mapping(lt)
    return hidden.select("ltid", F.array_join("ltw", " ").alias("tpl"), F.array_join("lts", "|").alias("symbols"))


@query("SELECT lid, host FROM log", ev="ev")
def anonymize_restored(spark, d):
    e = Ev(spark, d)
    log, _, mapping = anonymize.anonymize(e.log, e.lt)
    return anonymize.restore_hosts(log, mapping).select("lid", "host")


@query("SELECT lid, w[1] || ' user ' || CASE WHEN len(w[3]) = 1 THEN '*digit*' ELSE '*number*' END || ' value ' || CASE WHEN len(w[5]) = 1 THEN '*digit*' ELSE '*number*' END || ' k ' || CASE WHEN len(w[7]) = 1 THEN '*digit*' ELSE '*number*' END AS tpl FROM log", ev="ev")
def labelled_variables(spark, d):
    e = Ev(spark, d)
    rules = V.VariableRules(["ipaddr"], {"digit": r"\d$", "number": r"\d+$"})
    joined = search.with_templates(e.log, e.lt)
    return _text(joined.select("lid", V.label_variables(F.col("words"), F.col("ltw"), rules).alias("tpl")), "tpl")


@query("SELECT lid, CASE WHEN regexp_matches(w[1], '^\\d{1,3}(\\.\\d{1,3}){3}$') THEN 'ipaddr' WHEN regexp_matches(w[1], '^\\d+$') THEN 'digit' ELSE 'unknown' END AS label FROM log_doc", doc=True)
def word_labels(spark, d):
    rules = V.VariableRules(["ipaddr"], {"digit": r"\d+$"})
    return document_log(spark, d).select("lid", rules.label(F.element_at("words", 1)).alias("label"))


@query("SELECT lid, len(w) AS n, CASE WHEN len(w) < 3 THEN 0 ELSE len(w) - 2 END AS n_grams FROM log_doc", doc=True)
def word_ngrams(spark, d):
    lines = document_log(spark, d)
    return lines.select("lid", F.size("words").cast("long").alias("n"), F.size(T.ngrams(F.col("words"), 3)).cast("long").alias("n_grams"))


@query("SELECT a.ltid AS a, b.ltid AS b, len([i for i in generate_series(1, 7) if a.tpl[i] <> b.tpl[i]]) AS distance FROM lt a, lt b WHERE a.ltid < b.ltid", ev="ev")
def template_distances(spark, d):
    lt = Ev(spark, d).lt.select("ltid", "ltw")
    other = lt.select(F.col("ltid").alias("b"), F.col("ltw").alias("w"))
    return lt.join(other, F.col("ltid") < F.col("b")).select(F.col("ltid").alias("a"), "b", T.word_edit_distance(F.col("ltw"), F.col("w")).cast("long").alias("distance"))


# --- evaluation: the true cluster is the template, the predicted one depends on the value's size


PAIRS = """lab AS (SELECT lid AS line_no, ltid AS tid_true, tpl AS tpl_true, ltid // 2 * 10 + (w[5]::int > 20)::int AS tid_pred,
 [CASE WHEN i = 5 AND w[5]::int > 20 THEN w[5] WHEN i = 2 AND ltid = 1 THEN '**' ELSE tpl[i] END for i in generate_series(1, 7)] AS tpl_pred FROM log),
cells AS (SELECT tid_true, tid_pred, count(*) AS n FROM lab GROUP BY ALL), rw AS (SELECT tid_true, sum(n) AS nt, count(*) AS parts FROM cells GROUP BY 1),
cl AS (SELECT tid_pred, sum(n) AS np, count(*) AS owners FROM cells GROUP BY 1),
pc AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells)::double AS tp, (SELECT sum(nt * (nt - 1) / 2) FROM rw)::double AS pt, (SELECT sum(np * (np - 1) / 2) FROM cl)::double AS pp, (SELECT sum(n) FROM cells)::double AS total),
pq AS (SELECT tp, pp - tp AS fp, pt - tp AS fn, total * (total - 1) / 2 - pt - pp + tp AS tn FROM pc)"""


def _labels(spark, d) -> DataFrame:
    e = Ev(spark, d)
    value = F.element_at("words", 5)
    large = value.cast("int") > 20
    joined = search.with_templates(e.log, e.lt)
    answer = joined.select("lid", F.col("ltid").alias("tid"), F.col("ltw").alias("tpl"))
    changed = F.transform("ltw", lambda t, i: F.when((i == 4) & large, value).when((i == 1) & (F.col("ltid") == 1), T.WILDCARD).otherwise(t))
    trial = joined.select("lid", (F.floor(F.col("ltid") / 2) * 10 + large.cast("int")).cast("long").alias("tid"), changed.alias("tpl"))
    return evaluate.pair_labels(answer, trial)


@query("SELECT tid_true, tid_pred, n FROM cells", ev=PAIRS)
def contingency(spark, d):
    return evaluate.contingency(_labels(spark, d))


@query("SELECT tp, fp, fn, tn FROM pq", ev=PAIRS)
def pair_confusion(spark, d):
    return evaluate.pair_counts(_labels(spark, d))


@query(
    """SELECT round((tp + tn) / (tp + fp + fn + tn), 9) AS rand, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1,
round((tp - (tp + fp) * (tp + fn) / (tp + fp + fn + tn)) / ((2 * tp + fp + fn) / 2 - (tp + fp) * (tp + fn) / (tp + fp + fn + tn)), 9) AS adjusted_rand FROM pq""",
    ev=PAIRS,
)
def rand_scores(spark, d):
    made = evaluate.rand_scores(_labels(spark, d))
    return made.select(*(F.round(c, 9).alias(c) for c in made.columns))


@query(
    """, e AS (SELECT -sum(n / total * ln(n / np)) AS htp, -sum(n / total * ln(n / nt)) AS hpt, -sum(n / total * ln(nt / total)) AS ht, -sum(n / total * ln(np / total)) AS hp
FROM (SELECT n::double AS n, nt::double AS nt, np::double AS np, total FROM cells JOIN rw USING (tid_true) JOIN cl USING (tid_pred), pc)), s AS (SELECT 1 - htp / ht AS h, 1 - hpt / hp AS c FROM e)
SELECT round(h, 9) AS homogeneity, round(c, 9) AS completeness, round(2 * h * c / (h + c), 9) AS v_measure FROM s""",
    ev=PAIRS,
)
def v_measure(spark, d):
    made = evaluate.v_measure(_labels(spark, d))
    return made.select(*(F.round(c, 9).alias(c) for c in made.columns))


@query(
    """SELECT (SELECT coalesce(sum(n), 0) FROM cells JOIN rw USING (tid_true) JOIN cl USING (tid_pred) WHERE parts = 1 AND owners = 1)::double / (SELECT total FROM pc) AS parsing_accuracy,
(SELECT count(*) FROM cells JOIN rw USING (tid_true) JOIN cl USING (tid_pred) WHERE parts = 1 AND owners = 1)::double / (SELECT count(*) FROM rw) AS cluster_accuracy,
(SELECT count(*) FROM rw WHERE parts > 1)::double / (SELECT count(*) FROM rw) AS over_division, (SELECT count(*) FROM cl WHERE owners > 1)::double / (SELECT count(*) FROM cl) AS over_aggregation""",
    ev=PAIRS,
)
def cluster_scores(spark, d):
    return evaluate.cluster_scores(_labels(spark, d))


@query("SELECT count(*) AS n_messages, count(DISTINCT tid_true) AS n_answer_clusters, count(DISTINCT tid_pred) AS n_trial_clusters FROM lab", ev=PAIRS)
def cluster_inventory(spark, d):
    return evaluate.cluster_inventory(_labels(spark, d))


STRUCTURE = """m AS (SELECT tid_true, (tpl_true = tpl_pred)::int AS line, len(tpl_true) AS n, len([i for i in generate_series(1, 7) if tpl_true[i] = tpl_pred[i]]) AS ok,
 len([i for i in generate_series(1, 7) if tpl_true[i] <> '**']) AS nd, len([i for i in generate_series(1, 7) if tpl_true[i] <> '**' AND tpl_true[i] = tpl_pred[i]]) AS okd,
 len([i for i in generate_series(1, 7) if tpl_true[i] = '**']) AS nv, len([i for i in generate_series(1, 7) if tpl_true[i] = '**' AND tpl_true[i] = tpl_pred[i]]) AS okv FROM {lab}),
per AS (SELECT tid_true, count(*)::double AS lines, sum(line)::double AS line, sum(n)::double AS n, sum(ok)::double AS ok, sum(nd)::double AS nd, sum(okd)::double AS okd, sum(nv)::double AS nv, sum(okv)::double AS okv FROM m GROUP BY 1)
SELECT round(sum(ok) / sum(n), 9) AS word_accuracy, round(sum(line) / sum(lines), 9) AS line_accuracy, round(avg(line / lines), 9) AS template_accuracy, round(avg(ok / n), 9) AS template_word_accuracy,
 round(avg(okd / nd), 9) AS description_accuracy, round(avg(okv / nv), 9) AS variable_accuracy FROM per"""


@query(", " + STRUCTURE.format(lab="lab"), ev=PAIRS)
def structure_scores(spark, d):
    made = evaluate.structure_scores(_labels(spark, d))
    return made.select(*(F.round(c, 9).alias(c) for c in made.columns))


@query(", fi AS (SELECT tid_pred, max_by(tpl_pred, line_no) AS l FROM lab GROUP BY 1), lab2 AS (SELECT tid_true, tpl_true, l AS tpl_pred FROM lab JOIN fi USING (tid_pred)), " + STRUCTURE.format(lab="lab2"), ev=PAIRS)
def structure_scores_final(spark, d):
    made = evaluate.final_structure_scores(_labels(spark, d))
    return made.select(*(F.round(c, 9).alias(c) for c in made.columns))


@query("SELECT tid_pred, array_to_string(max_by(tpl_pred, line_no), ' ') AS tpl FROM lab GROUP BY 1", ev=PAIRS)
def final_templates(spark, d):
    return _text(evaluate.final_templates(_labels(spark, d)), "tpl")


@query("SELECT line_no, tid_true FROM (SELECT *, row_number() OVER (PARTITION BY tid_true ORDER BY line_no) AS r FROM lab) WHERE r = 1 AND tpl_true <> tpl_pred", ev=PAIRS)
def first_failures(spark, d):
    return evaluate.first_failures(_labels(spark, d)).select("line_no", "tid_true")


@query("SELECT tid_true, tid_pred, line_no, r AS sample FROM (SELECT *, row_number() OVER (PARTITION BY tid_true, tid_pred ORDER BY line_no) AS r FROM lab JOIN (SELECT tid_true FROM rw WHERE parts > 1) USING (tid_true)) WHERE r <= 2", ev=PAIRS)
def samples_of_divided(spark, d):
    return evaluate.samples_of_divided(_labels(spark, d), 2).select("tid_true", "tid_pred", "line_no", "sample")


@query("SELECT tid_true, tid_pred, line_no, r AS sample FROM (SELECT *, row_number() OVER (PARTITION BY tid_pred, tid_true ORDER BY line_no) AS r FROM lab JOIN (SELECT tid_pred FROM cl WHERE owners > 1) USING (tid_pred)) WHERE r <= 1", ev=PAIRS)
def samples_of_aggregated(spark, d):
    return evaluate.samples_of_divided(_labels(spark, d), 1, aggregated=True).select("tid_true", "tid_pred", "line_no", "sample")


@query("SELECT line_no FROM lab WHERE tpl_true <> tpl_pred", ev=PAIRS)
def differing_lines(spark, d):
    labels = _labels(spark, d)
    return evaluate.differing_lines(labels.withColumn("tpl_pred", F.col("tpl_true")), labels).select("line_no")


@query("SELECT line_no, array_to_string([CASE WHEN x = '**' THEN 'V' ELSE 'D' END for x in tpl_pred], '') AS labels FROM lab", ev=PAIRS)
def label_texts(spark, d):
    return _labels(spark, d).select("line_no", evaluate.label_text(F.col("tpl_true"), F.col("tpl_pred")).alias("labels"))
