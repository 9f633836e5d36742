"""Filters, predicates and projections.

Predicates are plain column expressions so Catalyst pushes the comparable ones into
the Parquet scan (time range, source equality, IN lists).  The "latest source" and
"fallback when empty" rules are decided by one value or one row before the plan is
built, so the scan itself filters on a literal.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import rules as R
from .joins import within_session

ANALYSIS_COLUMNS = ["id", "timestamp", "source", "event_id", "event_type", "severity", "message",
                    "hostname", "username", "process_name", "process_id"]


def time_window(df: DataFrame, start: datetime | None = None, end: datetime | None = None,
                ts_col: str = "timestamp") -> DataFrame:
    """Inclusive [start, end] on a timestamp column (either bound optional)."""
    if start is not None:
        df = df.filter(F.col(ts_col) >= X.ntz(start))
    if end is not None:
        df = df.filter(F.col(ts_col) <= X.ntz(end))
    return df


def analysis_scan(logs: DataFrame, start: datetime | None = None, end: datetime | None = None,
                  source: str | None = None) -> DataFrame:
    """The 11-column analysis projection with the reference's source rules.

    * ``None`` / '' / 'all' -> every source
    * 'latest'              -> the source of the row with the greatest ingestion_time
    * any other name        -> that source, or every source when it has no rows
    """
    base = time_window(logs, start, end)
    norm = (source or "").strip().lower()
    if not norm or norm == "all":
        out = base
    elif norm == "latest":
        # one value decides; as a literal it reaches the scan
        latest = logs.agg(F.max_by("source", F.struct("ingestion_time", "id"))).first()[0]
        out = base if latest is None else base.filter(F.col("source") == F.lit(latest))
    else:
        named = base.filter(F.col("source") == F.lit(source))
        out = base if named.limit(1).isEmpty() else named
    return out.select(*ANALYSIS_COLUMNS)


def search_logs(logs: DataFrame, q: str, columns=("message", "source", "severity")) -> DataFrame:
    """case-insensitive substring on any of the columns (no LIKE wildcards leak)."""
    needle = F.lower(F.lit(q))
    cond = None
    for c in columns:
        hit = F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
        cond = hit if cond is None else (cond | hit)
    return logs.filter(cond)


def high_risk_logs(logs: DataFrame, limit: int | None = 500) -> DataFrame:
    """severity critical/high/error or message like failed/unauthorized; newest first."""
    sev = F.lower(F.coalesce("severity", F.lit("")))
    msg = F.lower(F.coalesce("message", F.lit("")))
    out = logs.filter(sev.isin("critical", "high", "error") | msg.contains("failed") | msg.contains("unauthorized"))
    out = out.orderBy(F.desc_nulls_last("timestamp"), F.desc("id"))
    return out.limit(limit) if limit else out


def error_logs(logs: DataFrame) -> DataFrame:
    """F06 saved query."""
    return (logs.filter(F.col("severity").isin("CRITICAL", "HIGH", "ERROR"))
            .select("timestamp", "source", "event_type", "message")
            .orderBy(F.desc_nulls_last("timestamp")))


def login_failures(logs: DataFrame) -> DataFrame:
    """F07 saved query: case-sensitive LIKE patterns on event_type."""
    et = F.col("event_type")
    return (logs.filter(et.like("%Failed%Login%") | et.like("%Failed%Logon%"))
            .select("timestamp", "hostname", "username", "message")
            .orderBy(F.desc_nulls_last("timestamp")))


def recent_logs(logs: DataFrame, limit: int = 100) -> DataFrame:
    """F08 saved query: newest ``limit`` rows (id breaks timestamp ties)."""
    return (logs.orderBy(F.desc_nulls_last("timestamp"), F.desc("id")).limit(limit)
            .select("timestamp", "source", "event_type", "severity", "message"))


def list_anomalies(anomalies: DataFrame, logs: DataFrame, sessions: DataFrame | None = None,
                   session_id: str | None = None, severity: str | None = None, limit: int = 100) -> DataFrame:
    """F10 (+J01, J07): anomalies joined to their log, optional session lower bound and severity."""
    a = anomalies
    if session_id is not None and sessions is not None:
        a = within_session(a, sessions, session_id, None, open_ended=True)
    if severity:
        a = a.filter(F.col("severity") == severity.upper())
    j = a.join(logs.select(F.col("id").alias("_lid"), "timestamp", "source", "event_type", "message"),
               F.col("log_id") == F.col("_lid")).drop("_lid")
    return (j.select("id", "anomaly_score", "algorithm", "severity", "mitre_technique_id", "mitre_tactic",
                     "detected_at", "timestamp", "source", "event_type", "message")
            .orderBy(F.desc("anomaly_score"), F.asc("id")).limit(limit))


def min_severity(df: DataFrame, minimum: str = "INFO", min_score: float = 0.0,
                 severity_col: str = "severity", score_col: str = "anomaly_score") -> DataFrame:
    """rank(severity) >= rank(minimum) and score >= min_score (unknown severity ranks 0)."""
    rank = F.coalesce(X.severity_rank(severity_col), F.lit(0))
    floor = dict(R.SEVERITY_RANK).get(minimum.upper(), 0)
    return df.filter((rank >= F.lit(floor)) & (F.coalesce(F.col(score_col), F.lit(0.0)) >= F.lit(min_score)))


def lookup_key(df: DataFrame, key_col: str, value) -> DataFrame:
    """key look-up (technique by id, node by id, session by id)."""
    return df.filter(F.col(key_col) == F.lit(value))


def retention_split(logs: DataFrame, start: datetime | None = None, end: datetime | None = None,
                    source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(survivors, deleted) of a retention delete.

    No condition deletes everything; a NULL predicate keeps the row (SQL DELETE
    semantics).  Writing the survivors back is the caller's (an overwrite of the
    affected partitions).
    """
    conds = []
    if start is not None:
        conds.append(F.col("timestamp") >= X.ntz(start))
    if end is not None:
        conds.append(F.col("timestamp") <= X.ntz(end))
    if source is not None:
        conds.append(F.col("source") == F.lit(source))
    pred = F.lit(True)
    for c in conds:
        pred = pred & c
    deleted = logs.filter(F.coalesce(pred, F.lit(False)))
    survivors = logs.filter(~F.coalesce(pred, F.lit(False)))
    return survivors, deleted


_WRITE_WORDS = ["INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "REPLACE",
                "MERGE", "GRANT", "REVOKE", "COPY", "EXPORT", "IMPORT", "INSTALL", "PRAGMA", "SET", "CALL", "ATTACH", "DETACH", "LOAD_EXTENSION"]
_QUOTED = re.compile(r"`(?:[^`]|``)*`|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", re.S)
#: Kinds of plan nodes that a read of views is made of, as Spark's parser names them.
_NODES = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Join", "LateralJoin", "SubqueryAlias", "Distinct", "Union",
          "Except", "Intersect", "UnresolvedWith", "UnresolvedHaving", "WithWindowDefinition", "Generate", "OneRowRelation", "UnresolvedInlineTable", "LocalRelation",
          "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedHint", "UnresolvedTableValuedFunction", "Pivot", "Unpivot"}
#: Built-in functions that reach outside the query's rows.
_REFUSED_FUNCTIONS = {"reflect", "try_reflect", "java_method", "input_file_name", "input_file_block_start", "input_file_block_length"}
#: Expressions that name relations or functions at run time.
_REFUSED_EXPRESSIONS = {"ExpressionWithUnresolvedIdentifier", "UnresolvedFunctionName"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _check_plan(spark: SparkSession, plan, builtin: set[str]) -> None:
    """Walks a parsed, unresolved plan; raises ValueError at a node, function or relation that is not allowed."""
    kind = plan.getClass().getSimpleName().rstrip("$")
    if kind not in _NODES:
        raise ValueError(f"not allowed in a query: {kind}")
    if kind == "UnresolvedRelation":
        name = [str(x) for x in _items(plan.multipartIdentifier())]
        known = len(name) == 1 or (len(name) == 2 and spark.catalog.databaseExists(name[0]))
        if not known:
            raise ValueError("files can't be queried by path")
    if kind == "UnresolvedWith":
        for cte in _items(plan.cteRelations()):
            _check_plan(spark, cte._2(), builtin)
    if kind == "UnresolvedTableValuedFunction":
        _check_function(_items(plan.name()), builtin)
    if kind == "Generate":
        _check_expression(spark, plan.generator(), builtin)
    for e in _items(plan.expressions()):
        _check_expression(spark, e, builtin)
    for child in _items(plan.children()):
        _check_plan(spark, child, builtin)


def _check_function(parts: list, builtin: set[str]) -> None:
    name = ".".join(str(p).lower() for p in parts)
    if len(parts) != 1 or name not in builtin or name in _REFUSED_FUNCTIONS:
        raise ValueError(f"function not allowed: {name}")


def _check_expression(spark: SparkSession, e, builtin: set[str]) -> None:
    kind = e.getClass().getSimpleName()
    if kind in _REFUSED_EXPRESSIONS:
        raise ValueError(f"not allowed in a query: {kind}")
    if kind == "UnresolvedFunction":
        _check_function(_items(e.nameParts()), builtin)
    if kind == "UnresolvedGenerator":
        _check_function([e.name().funcName()], builtin)
    if _holds_plan(spark, e):
        _check_plan(spark, e.plan(), builtin)
    for child in _items(e.children()):
        _check_expression(spark, child, builtin)


def _holds_plan(spark: SparkSession, e) -> bool:
    """True for expressions that hold a query (scalar, IN and EXISTS subqueries)."""
    return bool(spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression").isInstance(e))


def validate_select(q: str) -> str:
    """F15 guard: one read-only SELECT over views, without comments; returns the stripped text.

    Write words and comments are looked for outside quoted text.  What the query may do is then
    decided on Spark's parsed plan: only nodes that read and combine relations, only relations of the
    catalog (no files by path), and only built-in functions, without those that call into the JVM or read file names.
    """
    text = (q or "").strip()
    if not text:
        raise ValueError("empty query")
    if not text.upper().startswith("SELECT"):
        raise ValueError("only SELECT queries are allowed")
    bare = _QUOTED.sub("''", text)
    if "--" in bare or "/*" in bare:
        raise ValueError("comments are not allowed")
    for w in _WRITE_WORDS:
        if re.search(rf"\b{w}\b", bare.upper()):
            raise ValueError(f"keyword not allowed: {w}")
    if ";" in bare.rstrip("; \n\t"):
        raise ValueError("one statement only")
    text = text.rstrip("; \n\t")
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # the parser's own error types differ between the JVM and Python
        raise ValueError(f"not a query: {e}") from e
    builtin = {r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()}
    _check_plan(spark, plan, builtin)
    return text


def guarded_sql(spark: SparkSession, q: str, limit: int | None = 1000) -> DataFrame:
    """validated ad-hoc SELECT over the registered temp views, with at most ``limit`` rows (None: all)."""
    df = spark.sql(validate_select(q))
    return df if limit is None else df.limit(limit)


def default_score(df: DataFrame) -> Column:
    """the log's score, else a default by normalised severity."""
    sev = X.normalize_severity("severity")
    dflt = F.coalesce(X.lookup(R.DEFAULT_SCORE_BY_SEVERITY, sev), F.lit(R.DEFAULT_SCORE_ELSE))
    score = F.col("anomaly_score") if "anomaly_score" in df.columns else F.lit(None).cast("double")
    return F.coalesce(score, dflt)


def short_source(c: str | Column) -> Column:
    """WORKSTATION -> WKST, SERVER -> SRV, else the first four characters upper-cased."""
    u = F.upper(X.col(c))
    return (F.when(u.contains("WORKSTATION"), F.lit("WKST"))
            .when(u.contains("SERVER"), F.lit("SRV"))
            .otherwise(F.substring(u, 1, 4)))


def node_list(c: str | Column) -> Column:
    """comma separated node names -> array without empty entries."""
    return F.filter(F.split(F.coalesce(X.col(c), F.lit("")), ","), lambda x: x != "")


def device_alerts(devices: DataFrame) -> DataFrame:
    """risk HIGH/CRITICAL or a device seen for the first time."""
    return devices.filter(F.col("risk_level").isin("HIGH", "CRITICAL") | F.coalesce(F.col("is_new"), F.lit(False)))
