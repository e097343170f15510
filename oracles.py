"""DuckDB SQL that computes what ``queries()`` computes, on the same parquet tables.

The statement log is derived from ``events`` with the same templates; labels come from the
plain patterns, pairs from a plain range join.
"""

from __future__ import annotations

from stmtlog.functions import patterns as P
from stmtlog.operators import insights, labels
from stmtlog.operators.remediation import PLAN_LISTS
from stmtlog.sources.events_log import TEMPLATES, VARIED


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(pairs, default) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in pairs) + f" ELSE {default} END"


_RULE = _case(
    [(f"regexp_matches(s, {_q(r[3])})", i) for i, r in enumerate(P.PURPOSE_RULES, 1)], 0
)


def _by_rule(values, default) -> str:
    return f"CASE rule {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(values, 1))} ELSE {default} END"


def _tables() -> str:
    words = [*P.TABLE_KEYWORDS, r"DELETE\s+FROM"]
    found = " || ".join(f"regexp_extract_all(u, {_q(w + chr(92) + 's+(' + chr(92) + 'w+)')}, 1)" for w in words)
    return f"list_sort(list_distinct({found}))"


_OPERATION = _case([(f"starts_with(s, {_q(o)})", _q(o)) for o in P.OPERATIONS], "'OTHER'")


def log_ctes(clock: str = "dense") -> str:
    time = "TIMESTAMP '2024-01-01' + to_seconds(20 * event_id)" if clock == "dense" else "ts::TIMESTAMP"
    rows = ", ".join(f"({i}, {_q(t)})" for i, t in enumerate(TEMPLATES))
    text = "t"
    for table in VARIED:
        text = f"replace({text}, '{table}', '{table}' || CASE WHEN user_id % 3 = 0 THEN '' ELSE '_' || (user_id % 3)::VARCHAR END)"
    return rf"""
    templates(i, t) AS (VALUES {rows}),
    log AS (
      SELECT 'S' || lpad(event_id::VARCHAR, 12, '0') AS sql_id, {text} AS sql_fulltext,
             CASE WHEN event_id % 97 <> 5 THEN 'APP' || (user_id % 4)::VARCHAR END AS sch, {time} AS tm
      FROM events JOIN templates ON i = (2 * event_id) % {len(TEMPLATES)}),
    folded AS (SELECT *, upper(sql_fulltext) AS u, regexp_replace(upper(sql_fulltext), '^\s+|\s+$', '', 'g') AS s FROM log),
    numbered AS (SELECT *, {_RULE} AS rule, {_tables()} AS tables, {_OPERATION} AS operation FROM folded),
    labelled AS (
      SELECT *, {_by_rule([_q(r[0]) for r in P.PURPOSE_RULES], "'unknown'")} AS purpose,
             {_by_rule([_q(r[1]) for r in P.PURPOSE_RULES], "''")} AS sub_type,
             ({_by_rule([r[2] for r in P.PURPOSE_RULES], '0.0')})::DOUBLE AS confidence
      FROM numbered)"""


_ISSUE = _case(
    [(f"c.sub_type = {_q(c)} AND f.sub_type = {_q(f)}", _q(i)) for c, f, i in P.ISSUE_TYPES], _q(P.DEFAULT_ISSUE_TYPE)
)

PAIRS = f""",
    pairs AS (
      SELECT c.sql_id || '_' || f.sql_id AS sequence_id, c.sch, c.tm AS check_tm, f.tm AS fix_tm,
             c.sql_id AS check_id, f.sql_id AS fix_id, c.sql_fulltext AS check_sql, f.sql_fulltext AS fix_sql,
             c.sub_type AS check_pattern, f.sub_type AS fix_pattern,
             list_sort(list_intersect(c.tables, f.tables)) AS tables,
             array_to_string(c.tables, ',') AS check_tables, array_to_string(f.tables, ',') AS fix_tables,
             {_ISSUE} AS issue_type, least(c.confidence, f.confidence) AS confidence
      FROM labelled c JOIN labelled f
        ON c.sch = f.sch AND f.tm > c.tm AND f.tm <= c.tm + INTERVAL 5 MINUTE AND list_has_any(c.tables, f.tables)
      WHERE c.purpose = 'integrity_check' AND f.purpose = 'integrity_fix')"""

DISCOVERY = "first_tm, sch, check_tm, fix_tm, check_tables, fix_tables, sequence_id, check_pattern, fix_pattern, tables"

SEQUENCES = PAIRS + f""",
    first_seen AS (SELECT sch, min(tm) AS first_tm FROM log GROUP BY sch),
    placed AS (
      SELECT p.*, first_tm,
             row_number() OVER (PARTITION BY check_pattern, fix_pattern, tables
               ORDER BY first_tm, sch, check_tm, fix_tm, check_tables, fix_tables, check_id, fix_id) AS place,
             count(*) OVER (PARTITION BY check_pattern, fix_pattern, tables) AS occurrence_count
      FROM pairs p JOIN first_seen USING (sch)),
    sequences AS (SELECT * EXCLUDE (place) FROM placed WHERE place = 1)"""

_W = r"(\w+)"
_RELATED = rf"t || '\s+\w*\s*JOIN\s+(\w+)|(\w+)\s+\w*\s*JOIN\s+' || t"
_JOINED = rf"t || '\.(\w+)\s*=\s*\w+\.\w+|\w+\.\w+\s*=\s*' || t || '\.(\w+)'"

PER_TABLE = rf""",
    used AS (SELECT sql_id, u, purpose, operation, unnest(tables) AS t FROM labelled),
    used_columns AS (
      SELECT DISTINCT sql_id, t, unnest(regexp_extract_all(u, t || '\.(\w+)', 1)) AS c FROM used),
    used_related AS (
      SELECT DISTINCT sql_id, t, r FROM (
        SELECT sql_id, t, unnest(regexp_extract_all(u, {_RELATED}, 1)) AS r FROM used UNION ALL
        SELECT sql_id, t, unnest(regexp_extract_all(u, {_RELATED}, 2)) AS r FROM used) WHERE r <> ''),
    used_joins AS (
      SELECT sql_id, t, c FROM (
        SELECT sql_id, t, unnest(regexp_extract_all(u, {_JOINED}, 1)) AS c FROM used UNION ALL
        SELECT sql_id, t, unnest(regexp_extract_all(u, {_JOINED}, 2)) AS c FROM used) WHERE c <> '')"""

_COUNT_BY_OPERATION = ", ".join(
    f"count(*) FILTER (operation = {_q(o)}) AS n_{o.lower()}" for o in [*P.OPERATIONS, "OTHER"]
)

PROFILES = PER_TABLE + f""",
    usage_of AS (
      SELECT t AS table_name, count(*) AS usage, {_COUNT_BY_OPERATION},
             count(*) FILTER (purpose = 'integrity_check') AS n_checks,
             count(*) FILTER (purpose = 'integrity_fix') AS n_fixes
      FROM used GROUP BY t),
    profiles AS (
      SELECT o.*, coalesce(n_columns, 0) AS n_columns, coalesce(n_related, 0) AS n_related,
             coalesce(n_join_columns, 0) AS n_join_columns
      FROM usage_of o
      LEFT JOIN (SELECT t, count(DISTINCT c) AS n_columns FROM used_columns GROUP BY t) x ON x.t = table_name
      LEFT JOIN (SELECT t, count(DISTINCT r) AS n_related FROM used_related GROUP BY t) y ON y.t = table_name
      LEFT JOIN (SELECT t, count(DISTINCT c) AS n_join_columns FROM used_joins GROUP BY t) z ON z.t = table_name),
    tops AS (
      SELECT greatest(max(usage), 1) AS top_usage, greatest(max(n_checks + n_fixes), 1) AS top_integrity,
             greatest(max(n_related), 1) AS top_related FROM profiles),
    important AS (
      SELECT p.*, 0.3::DOUBLE * (usage / top_usage) + 0.4::DOUBLE * ((n_checks + n_fixes) / top_integrity)
                + 0.3::DOUBLE * (n_related / top_related) AS importance
      FROM profiles p, tops)"""

_CATEGORY = _case([(f"regexp_matches(upper(check_sql), {_q(p)})", _q(c)) for c, p in P.CATEGORY_RULES], "'custom'")
_SEVERITY = _case(
    [("len(tables) = 0", "'low'"), ("m IS NULL", "'medium'")] + [(f"m > {b}", _q(s)) for b, s in P.SEVERITY_ABOVE], "'low'"
)
_IMPACT = _case(
    [
        (
            "(" + " OR ".join(f"contains(array_to_string(tables, ','), {_q(w)})" for w in words) + ")",
            f"{_q(level + ' - Affects ')} || replace(issue_type, '_', ' ')",
        )
        for level, words in P.IMPACT_KEYWORDS
    ],
    _q(P.DEFAULT_IMPACT),
)
_TITLE = "array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(issue_type, '_')], ' ')"
_PRIORITY = (
    _case([(f"severity = {_q(s)}", n) for s, n in P.SEVERITY_SCORE.items()], 0)
    + " + least(frequency / 10, 5.0::DOUBLE) + confidence * 5"
)
_EFFORT = _case([(f"severity = {_q(s)}", n) for s, n in P.EFFORT_DAYS.items()], "1.0")

RULES = SEQUENCES + PROFILES + f""",
    means AS (
      SELECT check_pattern, fix_pattern, tables, list_sum(list(importance ORDER BY t)) / count(*) AS m
      FROM (SELECT check_pattern, fix_pattern, tables, unnest(tables) AS t FROM sequences)
      JOIN important ON table_name = t GROUP BY ALL),
    rated AS (
      SELECT s.* RENAME (occurrence_count AS frequency), {_CATEGORY} AS category, {_SEVERITY} AS severity
      FROM sequences s LEFT JOIN means USING (check_pattern, fix_pattern, tables)),
    rules AS (
      SELECT *, 'RULE_' || category || '_' || array_to_string(tables[1:2], '_') || '_' || sequence_id[1:8] AS rule_id,
             {_TITLE} || ' Rule' AS rule_name,
             'Detects and fixes ' || issue_type || ' in ' || array_to_string(tables, ', ') AS description,
             check_sql AS example_check_sql, fix_sql AS example_fix_sql,
             {_IMPACT} AS business_impact, {_PRIORITY} AS priority_score
      FROM rated)"""

RULE_ORDER = f"priority_score DESC, {DISCOVERY}"
_T = "array_to_string(tables, ',')"
_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _dense(select: str, ctes: str = "") -> str:
    return f"WITH RECURSIVE {log_ctes()}{ctes}\n{select}"


def _real(select: str) -> str:
    return f"WITH {log_ctes('real')}\n{select}"


_REPORT = f"""rule_id, sequence_id, {_T} AS tables_key, rule_name AS name, description, severity, {_T} AS tables, frequency,
    fix_pattern <> '' AS has_automated_fix, business_impact"""

_REQUEST = f"""{_q(labels.LABEL_REQUEST_HEAD)} || sql_fulltext || {_q(labels.LABEL_REQUEST_TAIL)}"""

# the responses that __spark_entry__ derives for the asking statements
_RESPONSE = "CAST(substr(sql_id, 2) AS BIGINT) % 5"

SCHEMA = r""",
    qualified AS (
      SELECT DISTINCT table_name, column_name FROM (
        SELECT unnest(regexp_extract_all(u, '(\w+)\.(\w+)', 1)) AS table_name,
               unnest(regexp_extract_all(u, '(\w+)\.(\w+)', 2)) AS column_name FROM labelled
        UNION ALL SELECT table_name, column_name FROM inserted)),
    edges AS (
      SELECT DISTINCT table_name, column_name, other_table, other_column FROM statement_edges),
    named AS (SELECT sql_id, purpose, operation, unnest(names) AS table_name FROM real_names)"""

PARTS = r""",
    inserted AS (
      SELECT sql_id, t AS table_name, trim(unnest(string_split(c, ','))) AS column_name FROM (
        SELECT sql_id, unnest(regexp_extract_all(u, 'INSERT\s+INTO\s+(\w+)\s*\(([^)]+)\)', 1)) AS t,
               unnest(regexp_extract_all(u, 'INSERT\s+INTO\s+(\w+)\s*\(([^)]+)\)', 2)) AS c FROM labelled)),
    equalities AS (
      SELECT sql_id, unnest(regexp_extract_all(u, '(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)', 1)) AS a,
             unnest(regexp_extract_all(u, '(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)', 2)) AS b,
             unnest(regexp_extract_all(u, '(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)', 3)) AS c,
             unnest(regexp_extract_all(u, '(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)', 4)) AS d FROM labelled),
    statement_edges AS (
      SELECT sql_id, a AS table_name, b AS column_name, c AS other_table, d AS other_column FROM equalities WHERE a <> c
      UNION SELECT sql_id, c, d, a, b FROM equalities WHERE a <> c),
    real_names AS (
      SELECT sql_id, purpose, operation, list_sort(list_distinct(list_transform(
        regexp_extract_all(u, '(?:FROM|JOIN|INTO|UPDATE|TABLE)\s+((?:\w+\.)*\w+)', 1),
        lambda x: string_split(x, '.')[-1]))) AS names FROM labelled)"""

def _walk(text: str) -> str:
    """Tables and operation of each different text, one token at a time."""
    part = r"""(?:\w+|"[^"]*"?|`[^`]*`?)"""
    token = rf"""'[^']*'?|--[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|/\*(?s:.*)|{part}(?:\s*\.\s*{part})*|[^\s]"""
    keywords, passed, ends, operations = (
        f"[{', '.join(map(_q, words))}]" for words in (P.REAL_NAME_KEYWORDS, P.PASSED_OVER, P.LIST_ENDS, P.OPERATIONS)
    )
    return rf""",
    different AS (SELECT DISTINCT {text} AS v FROM folded),
    lexed AS (
      SELECT v, list_filter(regexp_extract_all(v, {_q(token)}), lambda x: NOT starts_with(x, '--') AND NOT starts_with(x, '/*')) AS l
      FROM different),
    walk AS (
      SELECT v, l, 0 AS i, 0 AS depth, false AS want, false AS listing, CAST(NULL AS VARCHAR) AS operation, CAST([] AS VARCHAR[]) AS names
      FROM lexed
      UNION ALL
      SELECT v, l, i + 1, CASE x WHEN '(' THEN depth + 1 WHEN ')' THEN greatest(depth - 1, 0) ELSE depth END,
             CASE WHEN x = '(' THEN want AND depth > 0 WHEN depth > 0 OR x = ')' THEN want WHEN x IN {keywords} THEN true
                  WHEN x = ',' THEN listing ELSE want AND x IN {passed} END,
             CASE WHEN taken THEN true WHEN depth = 0 AND (x IN {ends} OR x = ';') THEN false ELSE listing END,
             CASE WHEN operation IS NULL AND depth = 0 AND x IN {operations} THEN x ELSE operation END,
             CASE WHEN taken THEN list_append(names, replace(regexp_extract(x, {_q("^(?:" + part + chr(92) + "s*[.]" + chr(92) + "s*)*(" + part + ")$")}, 1), '"', '')) ELSE names END
      FROM (
        SELECT *, l[i + 1] AS x, want AND depth = 0 AND l[i + 1] NOT IN {keywords} AND l[i + 1] NOT IN {ends}
               AND l[i + 1] NOT IN {passed} AND regexp_matches(l[i + 1], '^[A-Z_"`]') AS taken
        FROM walk WHERE i < len(l))),
    walked AS (
      SELECT v, list_sort(list_distinct(names)) AS names, coalesce(operation, 'OTHER') AS operation FROM walk WHERE i = len(l))"""


_ODD = "upper('/* update notes */ ' || sql_fulltext || ' -- from nowhere' || chr(10) || ', ''from x'', \"Own\".later')"

def _form(text: str) -> str:
    out = f"regexp_replace(upper({text}), {_q("'[^']*'?")}, '?', 'g')"
    out = f"regexp_replace({out}, {_q(r'(^|[^\w:])\d+(?:[.]\d+)?\b')}, {_q(r'\1?')}, 'g')"
    out = f"trim(regexp_replace({out}, {_q(r'\s+')}, ' ', 'g'))"
    return f"regexp_replace({out}, {_q(r'[?](?: ?, ?[?])+')}, '?', 'g')"


_PER_SCHEMA = PARTS + SCHEMA
_LIST_NAME = _case([(f"list = {i}", _q(v[0])) for i, v in PLAN_LISTS.items()], "''")

LISTED = """,
    listed AS (
      SELECT 1 AS list, * FROM rules WHERE severity = 'critical' UNION ALL
      SELECT 2 AS list, * FROM rules WHERE severity IN ('high', 'medium') AND frequency > 10 UNION ALL
      SELECT 3 AS list, * FROM rules WHERE confidence > 0.8 AND fix_pattern <> '' AND severity IN ('medium', 'low'))"""

_TOTALS = """count(*) FILTER (purpose = 'integrity_check') AS total_checks,
    count(*) FILTER (purpose = 'integrity_fix') AS total_fixes"""

_OVERALL_LINE = """'Issue type: ' || issue_type || chr(10) || 'Tables: ' || array_to_string(tables, ', ') || chr(10)
    || 'Check pattern: ' || check_pattern || chr(10) || 'Fix pattern: ' || fix_pattern || chr(10)
    || 'Occurrences: ' || occurrence_count"""


_RECOMMENDED = """SELECT * FROM (
                 SELECT 'high' AS priority, 'critical_tables' AS category,
                   'Focus immediate attention on ' || t || ' table with ' || n || ' critical issues' AS recommendation,
                   'Review and execute all critical fixes for ' || t || ' table' AS action
                 FROM (SELECT t, count(*) AS n FROM (SELECT unnest(tables) AS t FROM rules WHERE severity = 'critical')
                       GROUP BY t ORDER BY n DESC, t LIMIT 1)
                 UNION ALL SELECT 'medium', 'automation', 'Develop automated fixes for ' || n || ' recurring manual patterns',
                   'Create SQL templates or procedures for common manual fixes'
                 FROM (SELECT count(*) AS n FROM rules WHERE fix_pattern = '' AND frequency > 5) WHERE n > 0
                 UNION ALL SELECT 'low', 'quick_wins', 'Address ' || n || ' high-frequency minor issues for quick improvements',
                   'Schedule batch execution of low-risk automated fixes'
                 FROM (SELECT count(*) AS n FROM rules WHERE severity = 'low' AND frequency > 10) WHERE n > 0)"""

_MADE_RULES = """rules AS (
      SELECT 'R' || g AS rule_id, 'Q' || g AS sequence_id, 'N' || g AS rule_name, 'D' || g AS description, 'I' || g AS business_impact,
             ['critical', 'high', 'medium', 'low'][1 + g % 4] AS severity, ['T' || g, 'U' || g % 7] AS tables, frequency,
             ['', 'mend', 'mend'][1 + g % 3] AS fix_pattern, [0.75, 0.8, 0.85, 0.9, 0.95][1 + g % 5]::DOUBLE AS confidence
      FROM (SELECT user_id % 60 AS g, count(*) AS frequency FROM events GROUP BY 1))"""


def oracle_sql() -> dict[str, str]:
    health = (
        "((1 - least((n_checks + n_fixes) / greatest(usage, 1), 1)) + (1 - least(coalesce(issues, 0) / 10, 1))) / 2"
    )
    found = {
        "purpose_counts": _dense(
            """SELECT purpose, count(*) AS n_statements, count(*) / (SELECT count(*) FROM labelled) * 100 AS percentage
               FROM labelled GROUP BY purpose"""
        ),
        "classified_log": _dense(
            f"""SELECT sql_id, sch AS parsing_schema_name, {_TIME.format('tm')} AS last_load_time, purpose, sub_type, confidence,
                CASE WHEN sub_type = '' THEN '' ELSE 'Pattern: ' || sub_type END AS indicators FROM labelled"""
        ),
        "label_requests": _dense(
            f"SELECT sql_id, {_REQUEST} AS request FROM labelled WHERE purpose = 'unknown'"
        ),
        "label_merge": _dense(
            f"""SELECT sql_id,
                CASE WHEN NOT asks OR k IN (1, 3, 4) THEN purpose WHEN k = 0 THEN 'reporting' ELSE 'maintenance' END AS purpose,
                CASE WHEN NOT asks OR k IN (1, 3, 4) THEN sub_type WHEN k = 0 THEN 'year_report' ELSE '' END AS sub_type,
                CASE WHEN NOT asks OR k = 4 THEN confidence WHEN k = 0 THEN 0.9 WHEN k = 2 THEN 0.5 WHEN k = 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence,
                CASE WHEN NOT asks OR k = 4 OR k = 1 THEN CASE WHEN sub_type = '' THEN '' ELSE 'Pattern: ' || sub_type END
                     WHEN k = 0 THEN 'about ' || sql_id ELSE '' END AS indicators
                FROM (SELECT *, purpose = 'unknown' AS asks, {_RESPONSE} AS k FROM labelled)"""
        ),
        "form_label_requests": _dense(
            f"""SELECT md5(form) AS form_id, {_REQUEST} AS request, n_statements FROM (
                  SELECT {_form("own")} AS form, min(own) AS sql_fulltext, count(*) AS n_statements FROM (
                    SELECT sql_fulltext || ' /* ' || sql_id[2:13] || ', ''x'') */' AS own FROM labelled WHERE purpose = 'unknown')
                  GROUP BY form)"""
        ),
        "form_label_merge": _dense(
            f"""SELECT sql_id, CASE WHEN asks THEN 'reporting' ELSE purpose END AS purpose,
                  CASE WHEN asks THEN md5({_form("sql_fulltext")})[1:4] ELSE sub_type END AS sub_type,
                  CASE WHEN asks THEN 0.5 ELSE confidence END::DOUBLE AS confidence,
                  CASE WHEN asks OR sub_type = '' THEN '' ELSE 'Pattern: ' || sub_type END AS indicators
                FROM (SELECT *, purpose = 'unknown' AS asks FROM labelled)"""
        ),
        "statement_tables": _dense(f"SELECT sql_id, {_T} AS tables FROM labelled"),
        "operation_types": _dense("SELECT sql_id, operation FROM labelled"),
        "qualified_columns": _dense(
            r"""SELECT DISTINCT sql_id, table_name, column_name FROM (
                SELECT sql_id, unnest(regexp_extract_all(u, '(\w+)\.(\w+)', 1)) AS table_name,
                       unnest(regexp_extract_all(u, '(\w+)\.(\w+)', 2)) AS column_name FROM labelled)"""
        ),
        "insert_columns": _dense("SELECT DISTINCT sql_id, table_name, column_name FROM inserted", PARTS),
        "relationship_edges": _dense(
            "SELECT DISTINCT sql_id, table_name, column_name, other_table, other_column FROM statement_edges", PARTS
        ),
        "real_table_names": _dense("SELECT sql_id, array_to_string(names, ',') AS tables FROM real_names", PARTS),
        "walked_table_names": _dense(
            f"SELECT sql_id, array_to_string(names, ',') AS tables, w.operation FROM folded JOIN walked w ON v = {_ODD}", _walk(_ODD)
        ),
        "walked_table_operations": _dense(
            """SELECT table_name, operation AS operation_type, count(*) AS n
               FROM (SELECT w.operation, unnest(names) AS table_name FROM folded JOIN walked w ON v = u) GROUP BY ALL""",
            _walk("u"),
        ),
        "table_columns": _dense("SELECT DISTINCT t AS table_name, c AS column_name FROM used_columns", PER_TABLE),
        "related_tables": _dense("SELECT DISTINCT t AS table_name, r AS related_table FROM used_related", PER_TABLE),
        "join_columns": _dense(
            "SELECT t AS table_name, c AS column_name, count(*) AS uses FROM used_joins GROUP BY t, c", PER_TABLE
        ),
        "check_fix_pairs": _dense(
            f"""SELECT sequence_id, sch AS parsing_schema_name, check_id AS check_sql_id, fix_id AS fix_sql_id,
                check_pattern, fix_pattern, {_T} AS tables, issue_type, confidence, 1 AS occurrence_count FROM pairs""",
            PAIRS,
        ),
        "pair_counts": _dense(
            f"""SELECT sch AS parsing_schema_name, strftime(check_tm, '%Y-%m-%d') AS day, check_pattern, fix_pattern,
                {_T} AS tables, count(*) AS pairs FROM pairs GROUP BY ALL""",
            PAIRS,
        ),
        "integrity_sequences": _dense(
            f"""SELECT sequence_id, check_sql, fix_sql, check_pattern, fix_pattern, {_T} AS tables, issue_type,
                confidence, occurrence_count FROM sequences""",
            SEQUENCES,
        ),
        "csv_log": _dense(
            f"""SELECT sql_id, sql_fulltext, sch AS parsing_schema_name, {_TIME.format('tm')} AS last_load_time FROM log"""
        ),
        "written_rule_report": _dense(
            f"SELECT {_REPORT}, '2024-05-01 00:00:00' AS created FROM rules ORDER BY {RULE_ORDER} LIMIT 50", RULES
        ),
        "written_issue_totals": _dense(
            """SELECT issue_type, sum(occurrence_count)::BIGINT AS occurrences, '2024-05-01 00:00:00' AS created
               FROM sequences GROUP BY issue_type""",
            SEQUENCES,
        ),
        "overall_insight": _dense(
            """SELECT '["' || issue_type || '"]' AS common_issues, NULL AS root_causes, NULL AS prevention_recommendations,
               NULL AS priority_order FROM (SELECT issue_type FROM sequences GROUP BY 1 ORDER BY sum(occurrence_count) DESC, 1 LIMIT 1)""",
            SEQUENCES,
        ),
        "first_sequences": _dense(
            f"""SELECT sequence_id, issue_type, {_T} AS tables, occurrence_count AS occurrences, confidence,
                check_pattern, fix_pattern FROM sequences ORDER BY {DISCOVERY} LIMIT 50""",
            SEQUENCES,
        ),
        "issue_type_totals": _dense(
            "SELECT issue_type, sum(occurrence_count)::BIGINT AS occurrences FROM sequences GROUP BY issue_type", SEQUENCES
        ),
        "top_issue_types": _dense(
            f"""SELECT issue_type, sum(occurrence_count)::BIGINT AS occurrences,
                array_to_string(list_sort(list_distinct(flatten(list(tables)))), ',') AS tables,
                array_to_string(list_sort(list_distinct(list(check_pattern))), ',') AS patterns
                FROM sequences GROUP BY issue_type ORDER BY occurrences DESC, issue_type LIMIT 5""",
            SEQUENCES,
        ),
        "schema_counts": _dense(
            "SELECT sch AS parsing_schema_name, count(*) AS n_statements FROM labelled WHERE sch IS NOT NULL GROUP BY sch"
        ),
        "integrity_counts": _dense(
            f"""SELECT {_TOTALS}, (SELECT count(*) FROM sequences) AS discovered_sequences,
                (SELECT count(DISTINCT issue_type) FROM sequences) AS unique_issue_types FROM labelled""",
            SEQUENCES,
        ),
        "hourly_counts": _real("SELECT hour(tm)::INTEGER AS hour, count(*) AS n_statements FROM labelled GROUP BY 1"),
        "daily_counts": _real(
            "SELECT strftime(tm, '%Y-%m-%d') AS day, count(*) AS n_statements FROM labelled GROUP BY 1"
        ),
        "date_range": _real(
            """SELECT count(*) AS total_statements, strftime(min(tm), '%Y-%m-%d %H:%M:%S.%f') AS start_time,
               strftime(max(tm), '%Y-%m-%d %H:%M:%S.%f') AS end_time FROM labelled"""
        ),
        "hourly_pivot": _real(
            """SELECT hour(tm)::INTEGER AS hour, count(*) FILTER (purpose = 'integrity_check') AS integrity_check,
               count(*) FILTER (purpose = 'integrity_fix') AS integrity_fix
               FROM labelled WHERE purpose IN ('integrity_check', 'integrity_fix') GROUP BY 1"""
        ),
        "daily_pivot": _real(
            """SELECT strftime(tm, '%Y-%m-%d') AS day, count(*) FILTER (purpose = 'integrity_check') AS integrity_check,
               count(*) FILTER (purpose = 'integrity_fix') AS integrity_fix
               FROM labelled WHERE purpose IN ('integrity_check', 'integrity_fix') GROUP BY 1"""
        ),
        "analysis_summary": _dense(
            f"""SELECT count(*) AS total_statements, strftime(min(tm), '%Y-%m-%d %H:%M:%S.%f') AS start_time,
                strftime(max(tm), '%Y-%m-%d %H:%M:%S.%f') AS end_time, {_TOTALS},
                (SELECT count(*) FROM sequences) AS discovered_sequences,
                (SELECT count(DISTINCT issue_type) FROM sequences) AS unique_issue_types FROM labelled""",
            SEQUENCES,
        ),
        "statement_samples": _dense(
            """SELECT sql_id, sql_fulltext, sch AS parsing_schema_name, sub_type FROM (
                 SELECT *, row_number() OVER (PARTITION BY purpose ORDER BY
                   md5(concat_ws('|', '7', sql_id, sch, strftime(tm, '%Y-%m-%d %H:%M:%S'))), sql_fulltext) AS place
                 FROM labelled WHERE purpose IN ('integrity_check', 'integrity_fix')) WHERE place <= 100"""
        ),
        "table_usage": _dense("SELECT table_name, count(*) AS usage_count FROM named GROUP BY table_name", _PER_SCHEMA),
        "table_operations": _dense(
            """SELECT 'purpose' AS counted_by, table_name, purpose AS operation_type, count(*) AS n FROM named GROUP BY ALL
               UNION ALL SELECT 'operation', table_name, operation, count(*) FROM named GROUP BY ALL""",
            _PER_SCHEMA,
        ),
        "schema_columns": _dense("SELECT table_name, column_name FROM qualified", _PER_SCHEMA),
        "schema_edges": _dense("SELECT * FROM edges", _PER_SCHEMA),
        "schema_summary": _dense(
            """SELECT (SELECT count(*) FROM (SELECT table_name FROM named UNION SELECT table_name FROM qualified
                 UNION SELECT table_name FROM edges)) AS total_tables,
               (SELECT count(DISTINCT table_name) FROM edges) AS tables_with_relationships,
               (SELECT count(*) FROM (SELECT DISTINCT table_name, other_table FROM edges)) AS total_relationships""",
            _PER_SCHEMA,
        ),
        "top_tables": _dense(
            """SELECT table_name, sum(n)::BIGINT AS usage_count FROM (
                 SELECT table_name, 1 AS n FROM named UNION ALL SELECT table_name, 0 FROM qualified
                 UNION ALL SELECT table_name, 0 FROM edges)
               GROUP BY table_name ORDER BY usage_count DESC, table_name LIMIT 20""",
            _PER_SCHEMA,
        ),
        "table_profiles": _dense("SELECT * FROM profiles", PROFILES),
        "table_importance": _dense("SELECT table_name, importance FROM important", PROFILES),
        "top_profiles": _dense(
            """SELECT table_name, importance, n_checks + n_fixes AS integrity_issues, n_related AS relationships
               FROM important ORDER BY importance DESC, table_name LIMIT 20""",
            PROFILES,
        ),
        "integrity_rules": _dense(
            f"""SELECT rule_id, rule_name, description,
                {_T} AS affected_tables, check_pattern, fix_pattern, example_check_sql, example_fix_sql, severity,
                frequency, confidence, business_impact, priority_score FROM rules""",
            RULES,
        ),
        "rule_report": _dense(f"SELECT {_REPORT} FROM rules ORDER BY {RULE_ORDER} LIMIT 50", RULES),
        "rule_insight_requests": _dense(
            f"""SELECT check_pattern, occurrences, 'Check pattern: ' || check_pattern || chr(10) || 'Tables: '
                  || array_to_string(list_sort(list_distinct(flatten(list(tables)))), ', ') || chr(10) || chr(10)
                  || 'A check:' || chr(10) || arg_min(example_check_sql, place) || chr(10) || chr(10)
                  || 'Its fix:' || chr(10) || arg_min(example_fix_sql, place) || {_q(insights.RULE_REQUEST_TAIL)} AS request
                FROM (SELECT *, row_number() OVER (PARTITION BY check_pattern ORDER BY {DISCOVERY}) AS place,
                             (sum(frequency) OVER (PARTITION BY check_pattern))::BIGINT AS occurrences FROM rules)
                WHERE place <= 3 GROUP BY check_pattern, occurrences""",
            RULES,
        ),
        "rule_insight_merge": _dense(
            f"""SELECT rule_id, sequence_id, check_pattern, fix_pattern,
                CASE WHEN check_pattern IN ('orphan_check', 'duplicate_check') THEN 'About ' || check_pattern ELSE description END AS description,
                CASE WHEN check_pattern = 'orphan_check' THEN 'Orphans cost money' ELSE business_impact END AS business_impact
                FROM rules""",
            RULES,
        ),
        "common_patterns": _dense(
            "SELECT check_pattern, count(*) AS n_rules FROM rules GROUP BY 1 ORDER BY n_rules DESC, check_pattern LIMIT 5", RULES
        ),
        "plan_summary": _dense(
            f"""SELECT count(*) AS total_rules, count(*) FILTER (severity = 'critical') AS critical_issues,
                trunc(coalesce(sum(({_EFFORT})::DOUBLE), 0))::INTEGER AS estimated_effort_days FROM rules""",
            RULES,
        ),
        "plan_phases": _dense(
            f"""SELECT list AS phase, {_LIST_NAME} AS name, count(*) AS n_rules,
                count(*) * CASE list WHEN 1 THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END AS duration_days
                FROM listed WHERE list < 3 GROUP BY list""",
            RULES + LISTED,
        ),
        "plan_items": _dense(
            f"SELECT list, {_LIST_NAME} AS list_name, {_REPORT} FROM listed",
            RULES + LISTED,
        ),
        "monitor_overview": _dense(
            f"""SELECT count(*) AS total_integrity_rules, {', '.join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in P.SEVERITY_SCORE)},
                count(*) FILTER (fix_pattern <> '') AS automated_fix_available,
                coalesce(sum(frequency), 0)::BIGINT AS total_issue_occurrences,
                (SELECT count(DISTINCT t) FROM (SELECT unnest(tables) AS t FROM rules)) AS tables_with_issues FROM rules""",
            RULES,
        ),
        "weekly_trends": _real(
            """SELECT strftime(w, '%Y-%m-%d') || '/' || strftime(w + INTERVAL 6 DAY, '%Y-%m-%d') AS period, sub_type AS issue_type,
                 n AS n_statements, CASE WHEN n > avg(n) OVER () THEN 'increasing' ELSE 'stable' END AS trend
               FROM (SELECT date_trunc('week', tm) AS w, sub_type, count(*) AS n FROM labelled
                     WHERE purpose IN ('integrity_check', 'integrity_fix') GROUP BY ALL)
               ORDER BY n_statements DESC, period, issue_type LIMIT 10"""
        ),
        "table_health": _dense(
            f"""SELECT table_name, importance, format('{{:.2f}}', {health})::DOUBLE AS health_score
                FROM important LEFT JOIN (SELECT unnest(tables) AS t, count(*) AS issues FROM rules GROUP BY 1) ON t = table_name
                ORDER BY importance DESC, table_name LIMIT 20""",
            RULES,
        ),
        "recommendations": _dense(
            _RECOMMENDED,
            RULES,
        ),
        "executive_figures": _dense(
            f"""SELECT (SELECT count(*) FROM labelled) AS total_statements, count(*) AS total_rules,
                count(*) FILTER (severity = 'critical') AS critical_issues,
                trunc(coalesce(sum(({_EFFORT})::DOUBLE), 0))::INTEGER AS estimated_effort_days,
                count(*) FILTER (fix_pattern <> '') AS automated_fixes FROM rules""",
            RULES,
        ),
        "leading_critical_rules": _dense(
            f"""SELECT rule_name, description, {_T} AS affected_tables, frequency
                FROM (SELECT * FROM rules ORDER BY {RULE_ORDER} LIMIT 3) WHERE severity = 'critical'""",
            RULES,
        ),
        "overall_insight_request": _dense(
            f"""SELECT {_q(insights.OVERALL_REQUEST_HEAD)} || string_agg({_OVERALL_LINE}, chr(10) || chr(10) ORDER BY {DISCOVERY})
                  || {_q(insights.OVERALL_REQUEST_TAIL)} AS request
                FROM (SELECT * FROM sequences ORDER BY {DISCOVERY} LIMIT 10)""",
            SEQUENCES,
        ),
        "preventive_measures_request": _dense(
            f"""SELECT {_q(insights.MEASURES_REQUEST_HEAD)}
                  || string_agg('- ' || check_pattern || ': ' || n || ' occurrences', chr(10) ORDER BY n DESC, check_pattern)
                  || {_q(insights.MEASURES_REQUEST_TAIL)} AS request
                FROM (SELECT check_pattern, count(*) AS n FROM rules GROUP BY 1 ORDER BY n DESC, check_pattern LIMIT 5)""",
            RULES,
        ),
        "preventive_measures": _dense(
            """SELECT (row_number() OVER (ORDER BY check_pattern) - 1)::INTEGER AS position, 'Guard against ' || check_pattern AS measure
               FROM (SELECT check_pattern, count(*) AS n FROM rules GROUP BY 1 ORDER BY n DESC, check_pattern LIMIT 5)""",
            RULES,
        ),
    }
    made = f"WITH {_MADE_RULES}"
    same = {
        "published_rules": "rule_report", "published_table_health": "table_health", "published_overview": "monitor_overview",
        "kept_weekly_trends": "weekly_trends", "kept_daily_pivot": "daily_pivot", "kept_date_range": "date_range",
    }
    return found | {name: found[as_is] for name, as_is in same.items()} | {
        "made_plan_items": f"{made}{LISTED} SELECT list, {_LIST_NAME} AS list_name, {_REPORT} FROM listed",
        "made_recommendations": f"{made} {_RECOMMENDED}",
    }
