"""Rule patterns, word lists, scores and texts that results depend on.

Patterns are written in the plain dialect of Python's ``re`` and describe *what* is
recognised; ``stmtlog.functions.regex`` turns them into expressions Spark runs.
"""

# ---- fixed values: purpose rules in evaluation order --------------------------------
# (purpose, sub_type, confidence, pattern), searched in the upper-cased, stripped text
PURPOSE_RULES = [
    ("integrity_check", "duplicate_check", 0.8, r"SELECT.*COUNT.*HAVING.*COUNT.*>"),
    ("integrity_check", "orphan_check", 0.8, r"SELECT.*NOT\s+IN.*SELECT"),
    ("integrity_check", "missing_reference_check", 0.8, r"SELECT.*LEFT\s+JOIN.*WHERE.*IS\s+NULL"),
    ("integrity_check", "existence_check", 0.8, r"SELECT.*NOT\s+EXISTS"),
    ("integrity_check", "circular_reference_check", 0.8, r"WITH.*RECURSIVE.*SELECT"),
    ("integrity_check", "aggregation_anomaly_check", 0.8, r"SELECT.*GROUP\s+BY.*HAVING"),
    ("integrity_check", "set_difference_check", 0.8, r"SELECT.*MINUS\s+SELECT|SELECT.*EXCEPT\s+SELECT"),
    ("integrity_fix", "orphan_removal", 0.8, r"DELETE.*WHERE.*NOT\s+IN.*SELECT"),
    ("integrity_fix", "reference_correction", 0.8, r"UPDATE.*SET.*=.*\(.*SELECT"),
    ("integrity_fix", "data_synchronization", 0.8, r"MERGE\s+INTO.*WHEN\s+MATCHED.*UPDATE"),
    ("integrity_fix", "upsert_fix", 0.8, r"INSERT.*ON\s+CONFLICT.*UPDATE"),
    ("integrity_fix", "cascading_cleanup", 0.8, r"DELETE.*USING.*JOIN"),
    ("integrity_fix", "bulk_correction", 0.8, r"UPDATE.*FROM.*JOIN.*SET"),
    ("integrity_fix", "duplicate_removal", 0.8, r"DELETE.*WHERE.*IN.*\(.*SELECT.*GROUP\s+BY.*HAVING"),
    ("normal_usage", "parameterized_query", 0.7, r"^SELECT.*FROM.*WHERE.*=\s*:\w+$"),
    ("normal_usage", "single_record_fetch", 0.7, r"^SELECT.*FROM.*WHERE.*=\s*\d+$"),
    ("normal_usage", "single_insert", 0.7, r"^INSERT\s+INTO.*VALUES\s*\("),
    ("normal_usage", "single_update", 0.7, r"^UPDATE.*SET.*WHERE.*=\s*:\w+$"),
    ("normal_usage", "pagination_query", 0.7, r"SELECT.*ROWNUM\s*<|LIMIT\s+\d+|FETCH\s+FIRST"),
]

# ---- fixed values: rule categories in evaluation order, on the upper-cased check text --
CATEGORY_RULES = [
    ("orphan", r"SELECT.*FROM\s+(\w+).*NOT\s+IN.*SELECT.*FROM\s+(\w+)"),
    ("orphan", r"SELECT.*LEFT\s+JOIN.*WHERE.*IS\s+NULL"),
    ("orphan", r"SELECT.*NOT\s+EXISTS.*SELECT.*FROM"),
    ("duplicate", r"SELECT.*COUNT\(\*\).*GROUP\s+BY.*HAVING\s+COUNT.*>\s*1"),
    ("duplicate", r"SELECT.*ROW_NUMBER\(\).*OVER.*PARTITION\s+BY"),
    ("circular", r"WITH\s+RECURSIVE.*SELECT.*CONNECT\s+BY"),
    ("circular", r"WITH.*AS.*SELECT.*UNION\s+ALL.*SELECT"),
    ("inconsistent", r"SELECT.*CASE\s+WHEN.*THEN.*ELSE.*END"),
    ("inconsistent", r"SELECT.*WHERE.*<>.*SELECT"),
]
DEFAULT_CATEGORY = "custom"

# ---- fixed values: words after which a table name is read, in order of search -----------
TABLE_KEYWORDS = ["FROM", "JOIN", "INTO", "UPDATE"]
REAL_NAME_KEYWORDS = ["FROM", "JOIN", "INTO", "UPDATE", "TABLE"]
NOT_A_TABLE = ["SELECT", "SET", "VALUES"]
OPERATIONS = ["SELECT", "INSERT", "UPDATE", "DELETE", "MERGE"]

# Words that the walk over tokens never takes for a table: those it passes over between keyword and name, and those that
# end a list of tables.
PASSED_OVER = ["IF", "NOT", "EXISTS", "ONLY"]
LIST_ENDS = [
    "SELECT", "SET", "VALUES", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "FETCH", "UNION", "INTERSECT", "EXCEPT",
    "MINUS", "WHEN", "RETURNING", "WINDOW", "OF", "NOWAIT", "SKIP", "DEFAULT", "INSERT", "DELETE", "MERGE",
]

# ---- fixed values: issue type of a (check, fix) pair ------------------------------------
ISSUE_TYPES = [
    ("duplicate_check", "duplicate_removal", "duplicate_records"),
    ("orphan_check", "orphan_removal", "orphaned_records"),
    ("missing_reference_check", "reference_correction", "invalid_references"),
    ("circular_reference_check", "cascading_cleanup", "circular_dependencies"),
    ("existence_check", "bulk_correction", "missing_data"),
]
DEFAULT_ISSUE_TYPE = "data_inconsistency"

# ---- fixed values: business impact words in level order ----------------------------------
IMPACT_KEYWORDS = [
    ("Critical", ["CUSTOMER", "ORDER", "PAYMENT", "ACCOUNT", "SIGNAL"]),
    ("High", ["FIBER", "SPLICE", "EQUIPMENT", "PORT", "CABLE"]),
    ("Medium", ["SEGMENT", "SPAN", "ROUTE", "PATH"]),
    ("Low", ["LOG", "TEMP", "BACKUP", "ARCHIVE"]),
]
DEFAULT_IMPACT = "Medium - General data quality impact"

# ---- fixed values: scores and thresholds -------------------------------------------------
SEVERITY_ABOVE = [(0.7, "critical"), (0.5, "high"), (0.3, "medium")]
SEVERITY_SCORE = {"critical": 4, "high": 3, "medium": 2, "low": 1}
EFFORT_DAYS = {"critical": 2.0, "high": 1.5, "medium": 1.0, "low": 0.5}
WINDOW_MINUTES = 5

# ---- fixed values: wording of rules (category, tables, sequence; issue; issue, tables) ----
RULE_ID = "RULE_%s_%s_%s"
RULE_NAME = "%s Rule"
RULE_DESCRIPTION = "Detects and fixes %s in %s"
NO_FIX = "No fix SQL available"

# ---- fixed values: measures given when no usable response exists -------------------------
FALLBACK_MEASURES = [
    "Implement foreign key constraints on all reference columns",
    "Add unique constraints on business key combinations",
    "Create database triggers to validate data on insert/update",
    "Implement regular integrity check jobs with alerting",
    "Add application-level validation before database operations",
]

# ---- fixed values: texts a CSV reader takes as missing -----------------------------------
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
