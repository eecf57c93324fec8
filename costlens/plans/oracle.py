"""DuckDB SQL equivalents of the registered queries (correctness oracle).

Every statement first rebuilds the two stand-in tables from the driver's
``events`` and ``customer`` views, exactly as ``sources/testdata.py`` does,
then computes the report with plain SQL.  Money is summed as DECIMAL(28,18),
read from and cast to DOUBLE by its shortest text, as on the Spark side.
"""

from __future__ import annotations

from costlens.config import FIXED_AS_OF
from costlens.periods import Period

AS_OF = FIXED_AS_OF

# Fixed values, written out here so that the check does not use the code it
# checks: for the clock 2024-01-17 15:30 (a Wednesday) the bounds of each range.
BOUNDS = {
    "today": ("2024-01-17 00:00:00", "2024-01-17 23:59:59.999999"),
    "week": ("2024-01-15 00:00:00", "2024-01-17 23:59:59.999999"),
    "month": ("2024-01-01 00:00:00", "2024-01-31 23:59:59.999999"),
    "sql_month": ("2024-01-01 00:00:00", "2024-01-31 23:59:59"),
    "from_10th": ("2024-01-10 00:00:00", "2024-01-31 23:59:59.999999"),
}

BASE = r"""
spend_logs AS (
  SELECT 'req-' || CAST(event_id AS VARCHAR) AS request_id,
         COALESCE(sha256('sk-user-' || CAST(user_id AS VARCHAR)), '') AS api_key,
         CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'default_user_id'
              ELSE 'user-' || CAST(user_id AS VARCHAR) END AS "user",
         CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'openai/'
              WHEN 3 THEN 'azure/openai/' || event_type WHEN 4 THEN 'openai/' || event_type
              WHEN 5 THEN 'anthropic/' || event_type ELSE event_type END AS model,
         CAST(CASE WHEN user_id % 13 = 0 THEN 0.0 ELSE value END AS DOUBLE) AS spend,
         CAST(COALESCE(TRY_CAST(regexp_extract(props, '"k"\s*:\s*(-?\d+)', 1) AS INTEGER), 0)
              + event_id % 50 AS INTEGER) AS total_tokens,
         CAST(COALESCE(TRY_CAST(regexp_extract(props, '"k"\s*:\s*(-?\d+)', 1) AS INTEGER), 0)
              AS INTEGER) AS prompt_tokens,
         CAST(event_id % 50 AS INTEGER) AS completion_tokens,
         CAST(NULL AS VARCHAR) AS call_type,
         CAST(NULL AS VARCHAR) AS cache_hit,
         CAST(NULL AS VARCHAR) AS cache_key,
         props AS metadata,
         ts AS "startTime",
         ts + INTERVAL 5 SECOND AS "endTime"
  FROM events
),
virtual_keys AS (
  SELECT COALESCE(sha256('sk-user-' || CAST(c_custkey AS VARCHAR)), '') AS token,
         CASE WHEN c_custkey % 4 = 0 THEN 'engineering' ELSE c_name END AS key_alias,
         CAST(0.0 AS DOUBLE) AS spend,
         CAST(CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 0.0
              ELSE 40.0 * (c_custkey % 150 + 1) END AS DOUBLE) AS max_budget,
         CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'user-' || CAST(c_custkey AS VARCHAR) END AS user_id,
         CASE c_custkey % 5
              WHEN 0 THEN '{"email": "e' || CAST(c_custkey AS VARCHAR) || '@x.io"}'
              WHEN 1 THEN '{"user_email": "u' || CAST(c_custkey AS VARCHAR) || '@x.io"}'
              WHEN 2 THEN '{"email": ""}'
              WHEN 3 THEN '{broken'
              ELSE NULL END AS metadata
  FROM customer
  WHERE c_custkey % 11 <> 0
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join((BASE,) + ctes) + "\n"


# The stand-in for validation: some spends missing or negative.
GOOD_SPEND = "CASE WHEN user_id % 13 = 0 THEN 0.0 ELSE value END"
FAULTY_SPEND = (f"CASE WHEN CAST(event_id AS VARCHAR) LIKE '%013' THEN NULL "
                f"WHEN event_id % 10 = 7 THEN -({GOOD_SPEND}) ELSE {GOOD_SPEND} END")


def _range(name: str) -> str:
    lo, hi = BOUNDS[name]
    return f"s.\"startTime\" >= TIMESTAMP '{lo}' AND s.\"startTime\" <= TIMESTAMP '{hi}'"


def _period_range(period: Period) -> str:
    return _range(period.value)


#: SHA-256 of the one key of the single-key reports (sk-user-7).
ONE_KEY_HASH = "3b2bbfa0a31a36a35bdd54af9848abff8ade7e6e2defe27020ce5d59157af7d4"
MONEY = "CAST(CAST(SUM(CAST(CAST(s.spend AS VARCHAR) AS DECIMAL(28,18))) AS VARCHAR) AS DOUBLE)"
TOKS = ("CAST(SUM(s.total_tokens) AS BIGINT) AS tokens, "
        "CAST(SUM(s.prompt_tokens) AS BIGINT) AS prompt_tokens, "
        "CAST(SUM(s.completion_tokens) AS BIGINT) AS completion_tokens")
PER_KEY_MODEL = "CASE WHEN strpos(s.model, '/') > 0 THEN substr(s.model, strpos(s.model, '/') + 1) ELSE s.model END"
ALL_KEYS_MODEL = "COALESCE(NULLIF(substr(s.model, strpos(s.model, '/') + 1), ''), s.model)"
HAS_MODEL = "s.model IS NOT NULL AND s.model <> ''"
RESOLVED_BUDGET = "CASE WHEN k.max_budget > 0 THEN CAST(k.max_budget AS DOUBLE) ELSE 25.0 END"
IDENT = "COALESCE(NULLIF(k.user_id, ''), substr(k.token, 1, 16))"
EMAIL = ("CASE WHEN json_valid(k.metadata) AND json_type(k.metadata) = 'OBJECT' THEN "
         "COALESCE(NULLIF(json_extract_string(k.metadata, '$.email'), ''), "
         "NULLIF(json_extract_string(k.metadata, '$.user_email'), '')) END")


def admin_key_day_model(rng: str = "month") -> str:
    return _with() + f"""
SELECT s.api_key, k.key_alias, CAST(s."startTime" AS DATE) AS day, {ALL_KEYS_MODEL} AS model,
       {MONEY} AS spend, COUNT(s.request_id) AS requests, {TOKS}
FROM spend_logs s LEFT JOIN virtual_keys k ON k.token = s.api_key
WHERE {_range(rng)} AND {HAS_MODEL}
GROUP BY 1, 2, 3, 4"""


def _total_cte(period: Period, name: str = "tot") -> str:
    return f"""{name} AS (
  SELECT s.api_key, SUM(CAST(CAST(s.spend AS VARCHAR) AS DECIMAL(28,18))) AS spend_dec
  FROM spend_logs s WHERE {_period_range(period)} GROUP BY s.api_key)"""


def total_spend(period: Period) -> str:
    return _with(_total_cte(period)) + f"""
SELECT k.token AS api_key, '{period.value}' AS period,
       COALESCE(CAST(CAST(t.spend_dec AS VARCHAR) AS DOUBLE), 0.0) AS spend
FROM virtual_keys k LEFT JOIN tot t ON t.api_key = k.token"""


def _summary_cte(period: Period) -> str:
    return f"""summ AS (
  SELECT k.token AS api_key, {IDENT} AS user_id, '{period.value}' AS period, 'EUR' AS currency,
         COALESCE(CAST(CAST(t.spend_dec AS VARCHAR) AS DOUBLE), 0.0) AS spend, {RESOLVED_BUDGET} AS budget
  FROM virtual_keys k LEFT JOIN tot t ON t.api_key = k.token)"""


def summary(period: Period) -> str:
    return _with(_total_cte(period), _summary_cte(period)) + """
SELECT api_key, user_id, period, currency, spend, budget, budget - spend AS remaining,
       CASE WHEN budget > 0 THEN spend / budget * 100.0 ELSE 0.0 END AS budget_used_percent
FROM summ"""


def by_model(period: Period, key_hash: str | None = None) -> str:
    only = f" AND s.api_key = '{key_hash}'" if key_hash else ""
    return _with(f"""agg AS (
  SELECT s.api_key, {PER_KEY_MODEL} AS model, SUM(CAST(CAST(s.spend AS VARCHAR) AS DECIMAL(28,18))) AS spend_dec,
         COUNT(s.request_id) AS requests, {TOKS}
  FROM spend_logs s
  WHERE {_period_range(period)} AND {HAS_MODEL}{only}
    AND s.api_key IN (SELECT token FROM virtual_keys)
  GROUP BY 1, 2)""") + f"""
SELECT api_key, '{period.value}' AS period, model, CAST(CAST(spend_dec AS VARCHAR) AS DOUBLE) AS spend,
       CASE WHEN key_total > 0 THEN CAST(CAST(spend_dec AS VARCHAR) AS DOUBLE) / key_total * 100.0 ELSE 0.0 END AS percentage,
       requests, tokens, prompt_tokens, completion_tokens
FROM (SELECT *, CAST(CAST(SUM(spend_dec) OVER (PARTITION BY api_key) AS VARCHAR) AS DOUBLE) AS key_total FROM agg) x
WHERE model <> ''"""


def by_project(period: Period) -> str:
    return _with() + f"""
SELECT api_key, '{period.value}' AS period, 'global' AS project, spend,
       CASE WHEN spend > 0 THEN spend / spend * 100.0 ELSE 0.0 END AS percentage,
       requests, tokens, prompt_tokens, completion_tokens
FROM (
  SELECT s.api_key, {MONEY} AS spend, COUNT(s.request_id) AS requests, {TOKS}
  FROM spend_logs s
  WHERE {_period_range(period)} AND s.api_key IN (SELECT token FROM virtual_keys)
  GROUP BY 1) x
WHERE spend IS NOT NULL AND spend <> 0"""


def daily(period: Period) -> str:
    return _with() + f"""
SELECT s.api_key, '{period.value}' AS period, CAST(CAST(s."startTime" AS DATE) AS TIMESTAMP) AS "date",
       {MONEY} AS spend, COUNT(s.request_id) AS requests, CAST(SUM(s.total_tokens) AS BIGINT) AS tokens
FROM spend_logs s
WHERE {_period_range(period)} AND s.api_key IN (SELECT token FROM virtual_keys)
GROUP BY 1, 3"""


def section_counts(period: Period) -> str:
    def sub(sql_fn) -> str:
        # Strip the leading WITH of the sub-report and inline it as a CTE body.
        return sql_fn(period)

    return f"""
SELECT k.token AS api_key, '{period.value}' AS period,
       CAST(COALESCE(m.n, 0) AS BIGINT) AS models,
       CAST(COALESCE(p.n, 0) AS BIGINT) AS projects,
       CAST(COALESCE(d.n, 0) AS BIGINT) AS days
FROM ({_with()} SELECT token FROM virtual_keys) k
LEFT JOIN (SELECT api_key, COUNT(*) AS n FROM ({sub(by_model)}) GROUP BY 1) m ON m.api_key = k.token
LEFT JOIN (SELECT api_key, COUNT(*) AS n FROM ({sub(by_project)}) GROUP BY 1) p ON p.api_key = k.token
LEFT JOIN (SELECT api_key, COUNT(*) AS n FROM ({sub(daily)}) GROUP BY 1) d ON d.api_key = k.token"""


def budget_month() -> str:
    return _with(_total_cte(Period.MONTH), _summary_cte(Period.MONTH)) + """
SELECT api_key, user_id, budget AS monthly_budget, currency, spend AS spent,
       budget - spend AS remaining, used_percent,
       CASE WHEN used_percent >= 100.0 THEN 'exceeded' WHEN used_percent >= 80.0 THEN 'warning'
            ELSE 'normal' END AS state,
       80.0 AS warning_threshold, 100.0 AS exceeded_threshold
FROM (SELECT *, CASE WHEN budget > 0 THEN spend / budget * 100.0 ELSE 0.0 END AS used_percent FROM summ) x"""


def over_budget_keys() -> str:
    return f"""
SELECT api_key, user_id, state, used_percent, remaining,
       state IN ('warning', 'exceeded') AS is_warning, state = 'exceeded' AS is_exceeded
FROM ({budget_month()}) b
WHERE state IN ('warning', 'exceeded')"""


def budget_resolved() -> str:
    return _with() + f"""
SELECT r.api_key, {RESOLVED_BUDGET} AS max_budget,
       CASE WHEN k.token IS NULL THEN 'default_missing_key'
            WHEN k.max_budget > 0 THEN 'max_budget' ELSE 'default_unset' END AS budget_source,
       'EUR' AS currency
FROM (SELECT DISTINCT api_key FROM spend_logs) r LEFT JOIN virtual_keys k ON k.token = r.api_key"""


def identity() -> str:
    return _with() + f"""
SELECT k.token AS api_key, {IDENT} AS user_id, COALESCE({EMAIL}, {IDENT} || '@unknown') AS email,
       substr(k.token, 1, 10) || '...' AS key_prefix
FROM virtual_keys k"""


from costlens.plans.catalog import ALIAS  # noqa: E402


def fx(expr: str, places: int) -> str:
    """Same text as functions.money.fixed_text."""
    return (f"CAST(CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,18)), {places}) AS DECIMAL(38,{places}))"
            " AS VARCHAR)")


def grp(expr: str) -> str:
    return f"format('{{:,}}', CAST({expr} AS BIGINT))"


def _sql_month() -> str:
    return _range("sql_month")


def alias_keys() -> str:
    return _with() + f"""
SELECT token, user_id, key_alias, max_budget, spend FROM virtual_keys WHERE key_alias = '{ALIAS}'"""


def alias_month_summary() -> str:
    return _with(f"""m AS (
  SELECT s.api_key, SUM(CAST(CAST(s.spend AS VARCHAR) AS DECIMAL(28,18))) AS spend_dec
  FROM spend_logs s WHERE {_sql_month()} GROUP BY 1)""") + f"""
SELECT k.token, k.key_alias, k.max_budget, k.spend AS proxy_counter,
       CAST(round(CAST(COALESCE(m.spend_dec, 0) AS DECIMAL(38,18)), 4) AS DOUBLE) AS month_spend,
       CAST(round(CAST(CAST(k.max_budget AS VARCHAR) AS DECIMAL(38,18)) - COALESCE(m.spend_dec, 0), 4) AS DOUBLE) AS remaining,
       CAST(round(CAST(CAST(CAST(CAST(COALESCE(m.spend_dec, 0) AS VARCHAR) AS DOUBLE) / NULLIF(k.max_budget, 0) * 100.0
                            AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) AS used_percent
FROM virtual_keys k LEFT JOIN m ON m.api_key = k.token
WHERE k.key_alias = '{ALIAS}'"""


def _alias_sums(label: str, name: str, more: str = "") -> str:
    """Rounded spend, rows and tokens of the alias' month rows, per ``label``."""
    return _with(f"""picked AS (
  SELECT {label} AS "{name}", CAST(CAST(s.spend AS VARCHAR) AS DECIMAL(28,18)) AS amount, s.total_tokens AS n
  FROM spend_logs s
  WHERE {_sql_month()}{more}
    AND s.api_key IN (SELECT token FROM virtual_keys WHERE key_alias = '{ALIAS}'))""") + f"""
SELECT "{name}", CAST(round(SUM(amount), 4) AS DOUBLE) AS spend, COUNT(*) AS requests,
       CAST(COALESCE(SUM(n), 0) AS BIGINT) AS tokens
FROM picked GROUP BY ALL"""


def alias_by_model() -> str:
    return _alias_sums("s.model", "model", f" AND {HAS_MODEL}")


def alias_daily() -> str:
    return _alias_sums('CAST(s."startTime" AS DATE)', "date")


AUTH_CTES = (r"""attempts AS (
  SELECT 'req-' || CAST(event_id AS VARCHAR) AS request_id,
         CASE event_type
              WHEN 'click' THEN 'Bearer sk-user-' || CAST(user_id AS VARCHAR)
              WHEN 'view' THEN 'sk-user-' || CAST(user_id AS VARCHAR)
              WHEN 'purchase' THEN sha256('sk-user-' || CAST(user_id AS VARCHAR))
              WHEN 'signup' THEN 'Bearer ' || sha256('sk-user-' || CAST(user_id AS VARCHAR))
              ELSE 'sk-revoked-' || CAST(user_id AS VARCHAR) END AS presented_key
  FROM events)""", """norm AS (
  SELECT request_id, k0 AS _key,
         COALESCE(CASE WHEN starts_with(k0, 'sk-') THEN sha256(k0) ELSE k0 END, '') AS api_key
  FROM (SELECT request_id,
               CASE WHEN starts_with(presented_key, 'Bearer ') THEN substr(presented_key, 8)
                    ELSE presented_key END AS k0
        FROM attempts) a)""")


def key_auth_valid() -> str:
    return _with(*AUTH_CTES) + f"""
SELECT n.request_id, n.api_key, {IDENT} AS user_id, COALESCE({EMAIL}, {IDENT} || '@unknown') AS email
FROM norm n JOIN virtual_keys k ON k.token = n.api_key"""


def key_auth_rejected() -> str:
    return _with(*AUTH_CTES) + """
SELECT n.request_id, substr(n._key, 1, 10) || '...' AS key_prefix
FROM norm n WHERE NOT EXISTS (SELECT 1 FROM virtual_keys k WHERE k.token = n.api_key)"""


def one_key_by_model() -> str:
    return by_model(Period.MONTH, ONE_KEY_HASH)


def _cut() -> str:
    return f"TIMESTAMP '{AS_OF.isoformat(sep=' ')}'"


def idempotent_load() -> str:
    return _with() + "SELECT * FROM spend_logs"


def duplicate_request_ids() -> str:
    c = _cut()
    return _with() + f"""
SELECT request_id, COUNT(*) AS copies FROM (
  SELECT request_id FROM spend_logs WHERE "startTime" >= {c} - INTERVAL 2 DAY
  UNION ALL
  SELECT request_id FROM spend_logs WHERE "startTime" >= {c} - INTERVAL 1 DAY
                                       AND "startTime" < {c} + INTERVAL 1 DAY) x
GROUP BY request_id HAVING COUNT(*) > 1"""


def duplicate_key_tokens() -> str:
    return _with() + """
SELECT token, COUNT(*) AS copies FROM (
  SELECT token FROM virtual_keys UNION ALL SELECT token FROM virtual_keys WHERE token LIKE '0%') k
GROUP BY token HAVING COUNT(*) > 1"""


def model_names() -> str:
    return _with() + f"""
SELECT s.model, {PER_KEY_MODEL} AS per_key_model, {ALL_KEYS_MODEL} AS all_keys_model
FROM (SELECT DISTINCT model FROM spend_logs) s"""


def _admin_rows_cte() -> str:
    return f"""arows AS (
  SELECT s.api_key, CAST(s."startTime" AS DATE) AS day, {ALL_KEYS_MODEL} AS model,
         SUM(CAST(CAST(s.spend AS VARCHAR) AS DECIMAL(28,18))) AS spend_dec, COUNT(s.request_id) AS requests,
         SUM(s.total_tokens) AS tokens, SUM(s.prompt_tokens) AS prompt_tokens,
         SUM(s.completion_tokens) AS completion_tokens
  FROM spend_logs s WHERE {_range("month")} AND {HAS_MODEL}
  GROUP BY 1, 2, 3)"""


def admin_cube() -> str:
    return _with(_admin_rows_cte()) + """
SELECT CAST(GROUPING(api_key, day, model) AS INTEGER) AS grouping_id, api_key, day, model,
       CAST(CAST(SUM(spend_dec) AS VARCHAR) AS DOUBLE) AS spend, CAST(SUM(requests) AS BIGINT) AS requests,
       CAST(SUM(tokens) AS BIGINT) AS tokens, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens,
       CAST(SUM(completion_tokens) AS BIGINT) AS completion_tokens
FROM arows GROUP BY GROUPING SETS ((api_key, day), (api_key, model), (day, model), (api_key), (day), (model), ())"""


def admin_pivot() -> str:
    dbl = "CAST(CAST(SUM(spend_dec) FILTER ({}) AS VARCHAR) AS DOUBLE) AS {}"
    names = ("view", "click", "purchase")
    cols = ", ".join([*(dbl.format(f"model = '{m}'", f'"{m}"') for m in names),
                      dbl.format("model NOT IN ('view', 'click', 'purchase')", "other_models")])
    return _with(_admin_rows_cte()) + f"\nSELECT api_key, day, {cols} FROM arows GROUP BY api_key, day"


def token_breakdown() -> str:
    labels = (("Requests", "requests"), ("Total Tokens", "tokens"),
              ("Prompt (In)", "prompt_tokens"), ("Completion (Out)", "completion_tokens"))
    parts = []
    for kind, name, sub in (("model", "model", by_model(Period.MONTH)),
                            ("project", "project", by_project(Period.MONTH))):
        for label, col in labels:
            parts.append(f"SELECT api_key, '{kind}' AS kind, {name} AS name, '{label}' AS label, "
                         f"CAST({col} AS BIGINT) AS value FROM ({sub}) r")
    return "\nUNION ALL\n".join(parts)


def _state_label(col: str) -> str:
    return (f"CASE WHEN {col} = 'exceeded' THEN '⚠️' WHEN {col} = 'warning' THEN '⚡' ELSE '✓' END"
            f" || ' ' || {col}")


def summary_lines() -> str:
    s = f"({summary(Period.MONTH)}) s"
    b = f"({budget_month()}) b"
    parts = [
        f"SELECT api_key, 'Total Spend' AS label, '$' || {fx('spend', 2)} AS value FROM {s}",
        f"SELECT api_key, 'Budget' AS label, '$' || {fx('budget', 2)} AS value FROM {s}",
        f"SELECT api_key, 'Remaining' AS label, '$' || {fx('remaining', 2)} AS value FROM {s}",
        f"SELECT api_key, 'Usage' AS label, {fx('budget_used_percent', 1)} || '%' AS value FROM {s}",
        f"SELECT api_key, 'Budget State' AS label, {_state_label('state')} AS value FROM {b}",
    ]
    return "\nUNION ALL\n".join(parts)


def status_text() -> str:
    def money(c):
        return f"'$' || {fx(c, 2)}"

    def pc(c):
        return f"{fx(c, 1)} || '%'"
    prefix = ("CASE WHEN state = 'exceeded' THEN '$(warning) ' WHEN state = 'warning' THEN '$(alert) '"
              " ELSE '$(coin) ' END")
    tip = ("CASE WHEN state = 'exceeded' THEN 'Budget exceeded! Spent ' || " + money("sp")
           + " || ' of ' || " + money("cap") + " || ' (' || " + pc("pc") + " || ' of monthly budget)'"
           " WHEN state = 'warning' THEN 'Budget warning: ' || " + pc("pc")
           + " || ' of monthly budget used (' || " + money("sp") + " || ' of ' || " + money("cap")
           + " || ')' ELSE 'LLM Spend (this month): ' || " + money("sp") + " || ' of ' || "
           + money("cap") + " || ' (' || " + pc("pc") + " || ')' END")
    return f"""
SELECT api_key, state,
       {prefix} || {money('sp')} AS text_amount,
       {prefix} || {pc('pc')} AS text_percentage,
       {prefix} || {money('sp')} || ' / ' || {pc('pc')} AS text_both,
       {tip} AS tooltip
FROM (SELECT s.api_key, b.state, COALESCE(b.spent, s.spend) AS sp,
             COALESCE(b.used_percent, s.budget_used_percent) AS pc,
             COALESCE(b.monthly_budget, s.budget) AS cap
      FROM ({summary(Period.MONTH)}) s LEFT JOIN ({budget_month()}) b ON b.api_key = s.api_key) j"""


def breakdown_label() -> str:
    return f"""
SELECT api_key, model,
       '$' || {fx('spend', 2)} || ' (' || {fx('percentage', 1)} || '%) · ' || {grp('tokens')} || ' tok'
         AS description,
       CAST(requests AS VARCHAR) || ' requests, ' || {grp('tokens')} || ' tokens (in: '
         || {grp('prompt_tokens')} || ', out: ' || {grp('completion_tokens')} || ')' AS tooltip
FROM ({by_model(Period.MONTH)}) m"""


def currency_text() -> str:
    return f"""
SELECT api_key, currency,
       CASE currency WHEN 'EUR' THEN '€' WHEN 'USD' THEN '$' WHEN 'GBP' THEN '£' ELSE currency END
         || {fx('spent', 2)} AS spent_text,
       '$' || {fx('remaining', 2)} AS remaining_usd_text,
       'CHF' || {fx('monthly_budget', 2)} AS budget_chf_text
FROM ({budget_month()}) b"""


def daily_label() -> str:
    return f"""
SELECT api_key, "date", strftime("date", '%Y-%m-%d') || ' $' || {fx('spend', 2)} AS label
FROM ({daily(Period.MONTH)}) d"""


#: Fixed rules: report -> fields that must be present and lie in [0, upper bound].
RULES = {
    "summary": {"spend": None, "budget": None, "budget_used_percent": None},
    "by_model": {"spend": None, "percentage": 100, "requests": None, "tokens": None, "prompt_tokens": None,
                 "completion_tokens": None},
    "daily": {"spend": None, "requests": None, "tokens": None},
    "budget": {"monthly_budget": None, "spent": None, "used_percent": None, "warning_threshold": 100,
               "exceeded_threshold": 100},
    "admin": {"spend": None, "requests": None, "tokens": None, "prompt_tokens": None, "completion_tokens": None},
}
RULES["by_project"] = RULES["by_model"]


def report_violations() -> str:
    reports = {"summary": summary(Period.MONTH), "by_model": by_model(Period.MONTH), "by_project": by_project(Period.MONTH),
               "daily": daily(Period.MONTH), "budget": budget_month(), "admin": admin_key_day_model()}
    parts = [_with() + f"SELECT 'log' AS report, request_id AS row_id, 'spend' AS field, spend AS value "
             f"FROM spend_logs s WHERE {_range('month')} AND (spend IS NULL OR spend < 0)"]
    for name, sub in reports.items():
        for field, most in RULES[name].items():
            over = f" OR {field} > {most}" if most is not None else ""
            parts.append(f"SELECT '{name}' AS report, CAST(api_key AS VARCHAR) AS row_id, '{field}' AS field, "
                         f"CAST({field} AS DOUBLE) AS value FROM ({sub}) r WHERE {field} IS NULL OR {field} < 0{over}")
    sql = "\nUNION ALL\n".join(f"SELECT * FROM ({p}) p" for p in parts)
    return sql.replace(GOOD_SPEND, FAULTY_SPEND).replace(MONEY, f"COALESCE({MONEY}, 0.0)").replace(
        "CAST(CAST(spend_dec AS VARCHAR) AS DOUBLE) AS spend", "COALESCE(CAST(CAST(spend_dec AS VARCHAR) AS DOUBLE), 0.0) AS spend").replace(
        "THEN CAST(CAST(spend_dec AS VARCHAR) AS DOUBLE) / key_total", "THEN COALESCE(CAST(CAST(spend_dec AS VARCHAR) AS DOUBLE), 0.0) / key_total")


def project_label() -> str:
    """The model labels' texts for the project rows."""
    return breakdown_label().replace(by_model(Period.MONTH), by_project(Period.MONTH)).replace("api_key, model", "api_key, project")


def state_label() -> str:
    return f"""
SELECT api_key, CASE state WHEN 'exceeded' THEN '⚠️' WHEN 'warning' THEN '⚡' ELSE '✓' END || ' ' || state AS label,
       upper(state) AS label_upper FROM ({budget_month()}) b"""


def nested_positions() -> str:
    parts = []
    for name, sub, label, order in (
            ("by_model", by_model(Period.MONTH), "model", "spend DESC, model"),
            ("by_project", by_project(Period.MONTH), "project", "spend DESC, project"),
            ("daily", daily(Period.MONTH), "strftime(\"date\", '%Y-%m-%d')", "\"date\" DESC"),
            ("all_keys", admin_key_day_model(), "model", "spend DESC, day, model")):
        parts.append(f"""SELECT '{name}' AS report, token AS api_key,
  CAST(CASE WHEN r.api_key IS NOT NULL THEN row_number() OVER (PARTITION BY token ORDER BY {order}) ELSE 0 END - 1 AS INTEGER) AS pos,
  {label} AS name, r.spend AS spend
FROM (SELECT DISTINCT token FROM ({_with()} SELECT token FROM virtual_keys) k) k LEFT JOIN ({sub}) r ON r.api_key = k.token""")
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p}) p" for p in parts)


DEDUPED = """dl AS (
  SELECT * FROM spend_logs
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY "startTime") = 1)"""


def stream_rollup() -> str:
    return _with(DEDUPED) + f"""
SELECT CAST(s."startTime" AS DATE) AS day, s.api_key, s.model, {MONEY} AS spend,
       COUNT(s.request_id) AS requests, {TOKS}
FROM dl s GROUP BY 1, 2, 3"""


def stream_budget_alerts() -> str:
    return _with(DEDUPED, """daily AS (
  SELECT api_key, CAST("startTime" AS DATE) AS day, SUM(CAST(CAST(spend AS VARCHAR) AS DECIMAL(28,18))) AS spend
  FROM dl GROUP BY 1, 2)""", """mtd AS (
  SELECT api_key, day,
         CAST(CAST(SUM(spend) OVER (PARTITION BY api_key, date_trunc('month', day) ORDER BY day
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VARCHAR) AS DOUBLE)
           AS spent_to_date
  FROM daily)""", f"""st AS (
  SELECT m.api_key, m.day, m.spent_to_date, {RESOLVED_BUDGET} AS budget
  FROM mtd m LEFT JOIN virtual_keys k ON k.token = m.api_key)""", """pc AS (
  SELECT *, CASE WHEN budget > 0 THEN spent_to_date / budget * 100.0 ELSE 0.0 END AS used_percent
  FROM st)""", """sx AS (
  SELECT *, CASE WHEN used_percent >= 100.0 THEN 'exceeded' WHEN used_percent >= 80.0 THEN 'warning'
                 ELSE 'normal' END AS state
  FROM pc)""", """lg AS (
  SELECT *, COALESCE(LAG(state) OVER (PARTITION BY api_key, date_trunc('month', day) ORDER BY day),
                     'normal') AS previous_state
  FROM sx)""") + """
SELECT api_key, day, previous_state, state, spent_to_date, budget, used_percent
FROM lg WHERE state <> previous_state"""


def refresh_bundle() -> str:
    parts = []
    for name, sub in (("summary", summary(Period.WEEK)), ("by_model", by_model(Period.WEEK)),
                      ("by_project", by_project(Period.WEEK)), ("daily", daily(Period.WEEK)),
                      ("budget", budget_month())):
        amount = "spent" if name == "budget" else "spend"
        parts.append(f"SELECT '{name}' AS report, true AS ok, CAST(NULL AS VARCHAR) AS error, COUNT(*) AS \"rows\", "
                     f"CAST(CAST(SUM(CAST(CAST({amount} AS VARCHAR) AS DECIMAL(28,18))) AS VARCHAR) AS DOUBLE) AS spend "
                     f"FROM ({sub}) r")
    return "\nUNION ALL\n".join(parts)


# ------------------------------------------------------------------- admission, new reports
def stream_admission() -> str:
    return stream_rollup().replace("FROM dl s GROUP BY", "FROM dl s WHERE s.request_id NOT LIKE '%13' GROUP BY")


def stream_quarantine() -> str:
    return _with() + """
SELECT request_id, api_key, model, spend, "startTime" + INTERVAL 20 YEAR AS "startTime" FROM spend_logs WHERE request_id LIKE '%13'"""


def ordered_positions() -> str:
    day = "strftime(\"date\", '%Y-%m-%d')"
    parts = [("days_asc", "api_key", day, daily(Period.MONTH), "PARTITION BY api_key ORDER BY \"date\""),
             ("alias_by_date", "'engineering'", day, alias_daily(), "ORDER BY \"date\""),
             ("alias_by_spend", "'engineering'", "model", alias_by_model(), "ORDER BY spend DESC, model")]
    return "\nUNION ALL\n".join(f"""SELECT '{name}' AS report, {key} AS api_key,
  CAST(row_number() OVER ({order}) - 1 AS INTEGER) AS pos, {label} AS name, spend FROM ({sub}) r""" for name, key, label, sub, order in parts)


def _anomalies(by: str) -> str:
    return _with(f"""spiked AS (
  SELECT api_key, model, CAST("startTime" AS DATE) AS day,
         CASE WHEN day("startTime") % 6 = 0 THEN 0.0 WHEN request_id LIKE '%77' THEN s.spend * 200 ELSE s.spend END AS spend
  FROM spend_logs s WHERE {_range("month")})""", f"""sums AS (
  SELECT {by}, day, CAST(CAST(SUM(CAST(CAST(spend AS VARCHAR) AS DECIMAL(28,18))) AS VARCHAR) AS DOUBLE) AS spend
  FROM spiked GROUP BY 1, 2)""", f"""cal AS (
  SELECT {by}, CAST(unnest(generate_series(min(day), DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM sums GROUP BY 1)""",
                 f"""filled AS (
  SELECT c.{by}, c.day, COALESCE(s.spend, 0.0) AS spend
  FROM cal c LEFT JOIN sums s ON s.{by} IS NOT DISTINCT FROM c.{by} AND s.day = c.day)""", f"""past AS (
  SELECT {by}, day, spend, list(spend) OVER (PARTITION BY {by} ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS h
  FROM filled)""", f"""med AS (
  SELECT {by}, day, spend, h, list_sort(h)[4] AS expected FROM past WHERE len(h) = 7)""", f"""sp AS (
  SELECT *, greatest(1.4826::DOUBLE * list_sort(list_transform(h, lambda x: abs(x - expected)))[4], 0.1::DOUBLE * expected, 1.0::DOUBLE)
            AS spread FROM med)""") + f"""
SELECT {by}, day, spend, expected, spread, (spend - expected) / spread AS deviation,
       CASE WHEN spend > expected THEN 'spike' ELSE 'drop' END AS direction
FROM sp WHERE abs((spend - expected) / spread) >= 4.0"""


EXACT_SUM = 'SUM(CAST(CAST(s.spend AS VARCHAR) AS DECIMAL(28,18)))'


def top_spenders() -> str:
    return _with(f"""sums AS (
  SELECT s.api_key, {EXACT_SUM} AS x FROM spend_logs s WHERE {_range("month")} GROUP BY 1 HAVING x <> 0)""") + """
SELECT CAST(row_number() OVER (ORDER BY x DESC, api_key) AS INTEGER) AS rank, api_key, key_alias,
       CAST(CAST(x AS VARCHAR) AS DOUBLE) AS spend
FROM sums LEFT JOIN virtual_keys k ON k.token = api_key QUALIFY rank <= 20"""


def top_by_model() -> str:
    return _with(f"""sums AS (
  SELECT {ALL_KEYS_MODEL} AS model, s.api_key, {EXACT_SUM} AS x FROM spend_logs s
  WHERE {_range("month")} AND s.model IS NOT NULL AND s.model <> '' GROUP BY 1, 2 HAVING x <> 0)""") + """
SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY x DESC, api_key) AS INTEGER) AS rank, api_key,
       CAST(CAST(x AS VARCHAR) AS DOUBLE) AS spend
FROM sums QUALIFY rank <= 3"""


OWNED = ("""owners AS (
  SELECT token, CASE WHEN substr(token, 1, 1) = '0' THEN 'unassigned' ELSE 'team-' || CAST(COALESCE(TRY_CAST(
           regexp_extract(key_alias, '(\\d+)$', 1) AS INTEGER), length(COALESCE(user_id, ''))) % 17 AS VARCHAR) END AS team,
         COALESCE(NULLIF(user_id, ''), 'unassigned') AS "user" FROM virtual_keys)""", f"""used AS (
  SELECT COALESCE(o.team, 'unassigned') AS team, COALESCE(o."user", 'unassigned') AS "user", s.api_key, s.spend, s.request_id,
         s.total_tokens FROM spend_logs s LEFT JOIN owners o ON o.token = s.api_key WHERE {_range("month")})""")


def team_totals() -> str:
    return _with(*OWNED) + f"""
SELECT team, COUNT(DISTINCT "user") AS users, COUNT(DISTINCT api_key) AS keys, {MONEY} AS spend,
       COUNT(request_id) AS requests, CAST(SUM(total_tokens) AS BIGINT) AS tokens
FROM used s GROUP BY team"""


def cost_allocation() -> str:
    def level(name: str, group: str, whole: str) -> str:
        cols = f"{group}, {name}" if group else name
        on = " AND ".join(f"p.{c} = w.{c}" for c in group.split(", ")) if group else "true"
        over = f"PARTITION BY {', '.join('p.' + c for c in group.split(', '))}" if group else ""
        picked = ", ".join(f"p.{c}" for c in cols.split(", "))
        return f"""{name.strip('"')}_share AS (
  SELECT {cols}, base + CASE WHEN row_number() OVER ({over.replace('p.', '')} ORDER BY rest DESC, {name}) <= whole - SUM(base) OVER ({over.replace('p.', '')})
         THEN 1 ELSE 0 END AS amount
  FROM (SELECT {picked}, whole, (whole * weight) // greatest(total, 1) AS base, (whole * weight) % greatest(total, 1) AS rest
        FROM (SELECT {picked}, w.amount::HUGEINT AS whole, p.weight,
                     SUM(p.weight) OVER ({over})::HUGEINT AS total
              FROM (SELECT {cols}, SUM(weight)::HUGEINT AS weight FROM k GROUP BY ALL) p JOIN {whole} w ON {on}) p) p)"""

    return _with(*OWNED, f"""k AS (
  SELECT team, "user", api_key, {EXACT_SUM} AS x, CAST(round({EXACT_SUM}, 8) * 100000000 AS HUGEINT) AS weight
  FROM used s GROUP BY ALL)""", """book AS (SELECT CAST(round(SUM(x), 2) * 100 AS HUGEINT) AS amount FROM k)""",
                 level("team", "", "book"), level('"user"', "team", "team_share"),
                 level("api_key", 'team, "user"', "user_share")) + """
SELECT k.team, k."user", k.api_key, CAST(CAST(k.x AS VARCHAR) AS DOUBLE) AS spend, CAST(a.amount AS DOUBLE) / 100 AS allocated,
       CAST(u.amount AS DOUBLE) / 100 AS user_allocated, CAST(t.amount AS DOUBLE) / 100 AS team_allocated
FROM k JOIN api_key_share a USING (team, "user", api_key) JOIN user_share u ON u.team = k.team AND u."user" = k."user"
  JOIN team_share t ON t.team = k.team"""


def spend_in_currencies() -> str:
    return _with("""per_day AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1)""", """rates AS (
  SELECT currency, day, CAST((500 + n % 1000) / 1000.0 AS DECIMAL(12,6)) AS rate
  FROM per_day, (VALUES ('USD'), ('GBP'), ('JPY')) c(currency)
  WHERE CASE currency WHEN 'USD' THEN day(day) % 3 = 1 WHEN 'GBP' THEN day(day) % 5 = 2 ELSE day(day) >= 9 AND day(day) % 2 = 1 END)""",
                 f"""daily AS (
  SELECT s.api_key, CAST(s."startTime" AS DATE) AS day, CAST({EXACT_SUM} AS DECIMAL(20,8)) AS spend
  FROM spend_logs s WHERE {_range("month")} GROUP BY 1, 2)""", """asked AS (
  SELECT * FROM daily, (VALUES ('USD'), ('GBP'), ('JPY'), ('CHF')) c(currency))""") + """
SELECT a.api_key, a.currency, CAST(CAST(SUM(a.spend * r.rate) AS VARCHAR) AS DOUBLE) AS converted,
       CAST(CAST(SUM(CASE WHEN r.rate IS NULL THEN a.spend ELSE 0 END) AS VARCHAR) AS DOUBLE) AS without_rate
FROM asked a ASOF LEFT JOIN rates r ON r.currency = a.currency AND r.day <= a.day GROUP BY 1, 2"""


def forecast() -> str:
    days = "CASE WHEN spent >= budget THEN 0 WHEN daily_rate > 0 THEN ceil((budget - spent) / daily_rate) END"
    return _with(f"""sums AS (
  SELECT s.api_key, CAST(CAST({EXACT_SUM} FILTER (s."startTime" >= TIMESTAMP '2024-01-01') AS VARCHAR) AS DOUBLE) AS spent,
         CAST(CAST({EXACT_SUM} FILTER (s."startTime" >= TIMESTAMP '2024-01-10') AS VARCHAR) AS DOUBLE) AS recent
  FROM spend_logs s WHERE s."startTime" < TIMESTAMP '2024-01-17' GROUP BY 1)""", f"""base AS (
  SELECT k.token AS api_key, COALESCE(spent, 0.0) AS spent, COALESCE(recent, 0.0) / 7 AS daily_rate, {RESOLVED_BUDGET} AS budget
  FROM virtual_keys k LEFT JOIN sums ON sums.api_key = k.token)""", """proj AS (
  SELECT *, spent + daily_rate * 15 AS projected FROM base)""") + f"""
SELECT api_key, spent, daily_rate, projected, budget, projected / budget * 100.0 AS projected_percent,
       CASE WHEN projected / budget * 100.0 >= 100.0 THEN 'exceeded' WHEN projected / budget * 100.0 >= 80.0 THEN 'warning'
            ELSE 'normal' END AS projected_state,
       CASE WHEN {days} <= 15 THEN DATE '2024-01-16' + CAST({days} AS INTEGER) END AS exceeded_on
FROM proj"""


def at_risk() -> str:
    return f"""SELECT f.api_key, b.state AS state_now, f.projected_state, f.projected, f.budget, f.exceeded_on
FROM ({forecast()}) f JOIN ({budget_month()}) b USING (api_key)
WHERE (f.projected_state, b.state) IN (('exceeded', 'normal'), ('exceeded', 'warning'), ('warning', 'normal'))"""


def period_check() -> str:
    return """SELECT request_id, period, COALESCE(period IN ('today', 'week', 'month'), false) AS valid FROM (
  SELECT 'req-' || CAST(event_id AS VARCHAR) AS request_id,
         CASE event_id % 8 WHEN 0 THEN 'today' WHEN 1 THEN 'week' WHEN 2 THEN 'month' WHEN 3 THEN 'Month' WHEN 4 THEN '' WHEN 5 THEN NULL
              WHEN 6 THEN 'year ' ELSE 'week' END AS period FROM events) e"""


def oracle_queries() -> dict[str, str]:
    q = {"admin_key_day_model": admin_key_day_model()}
    for p in Period:
        q[f"total_spend_{p.value}"] = total_spend(p)
        q[f"summary_{p.value}"] = summary(p)
    for p in (Period.WEEK, Period.MONTH):
        q[f"by_model_{p.value}"] = by_model(p)
        q[f"daily_{p.value}"] = daily(p)
    q["by_project_month"] = by_project(Period.MONTH)
    q["section_counts"] = section_counts(Period.MONTH)
    q["budget_month"] = budget_month()
    q["over_budget_keys"] = over_budget_keys()
    q["budget_resolved"] = budget_resolved()
    q["identity"] = identity()
    q.update({
        "alias_keys": alias_keys(),
        "alias_month_summary": alias_month_summary(),
        "alias_by_model": alias_by_model(),
        "alias_daily": alias_daily(),
        "key_auth_valid": key_auth_valid(),
        "key_auth_rejected": key_auth_rejected(),
        "one_key_by_model": one_key_by_model(),
        "idempotent_load": idempotent_load(),
        "duplicate_request_ids": duplicate_request_ids(),
        "duplicate_key_tokens": duplicate_key_tokens(),
        "model_names": model_names(),
        "admin_cube": admin_cube(),
        "admin_pivot": admin_pivot(),
        "token_breakdown": token_breakdown(),
        "summary_lines": summary_lines(),
        "status_text": status_text(),
        "breakdown_label": breakdown_label(),
        "currency_text": currency_text(),
        "daily_label": daily_label(),
        "project_label": project_label(),
        "state_label": state_label(),
        "report_violations": report_violations(),
        "nested_positions": nested_positions(),
        "append_twice": idempotent_load(),
        "stream_daily": stream_rollup(),
        "stream_reconcile": stream_rollup(),
        "stream_budget_alerts": stream_budget_alerts(),
        "refresh_bundle": refresh_bundle(),
        "admin_custom_range": admin_key_day_model("from_10th"),
        "layout_one_key_week": by_model(Period.WEEK, ONE_KEY_HASH),
        "stream_admission": stream_admission(),
        "stream_quarantine": stream_quarantine(),
        "indexed_load": idempotent_load(),
        "compacted_one_key_week": by_model(Period.WEEK, ONE_KEY_HASH),
        "ordered_positions": ordered_positions(),
        "anomalies_month": _anomalies("api_key"),
        "anomalies_by_model": _anomalies("model"),
        "top_spenders": top_spenders(),
        "top_by_model": top_by_model(),
        "team_totals": team_totals(),
        "cost_allocation": cost_allocation(),
        "spend_in_currencies": spend_in_currencies(),
        "forecast": forecast(),
        "at_risk": at_risk(),
        "csv_export": admin_key_day_model(),
        "period_check": period_check(),
    })
    return q
