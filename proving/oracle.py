"""The same questions as plain SQL over the given tables, for comparison with the queries.

Written apart from the operators: the diff is a full join and seven unions here, a hash-based
array difference there.
"""

from __future__ import annotations

from proving.fixtures import FAULTY_DOCS

NOW = "2026-01-01T00:00:00.000Z"

CTES: dict[str, tuple[list[str], str]] = {}
ORACLE: dict[str, str] = {}


def cte(name: str, needs: str, sql: str) -> None:
    CTES[name] = (needs.split(), sql)


def oracle(name: str, needs: str, sql: str, **local: str) -> None:
    """`local`: further tables of this query alone, defined after the shared ones it needs."""
    order: list[str] = []

    def visit(part: str) -> None:
        if part in order:
            return
        for need in CTES[part][0]:
            visit(need)
        order.append(part)

    for part in needs.split():
        visit(part)
    texts = [f"{part} AS ({CTES[part][1]})" for part in order]
    texts += [f"{part} AS ({body})" for part, body in local.items()]
    ORACLE[name] = f"WITH {', '.join(texts)} {sql}" if texts else sql


# --- derived tables ----------------------------------------------------------------------------

cte("v", "", """
SELECT o_orderkey, o_custkey AS c, o_orderstatus, o_orderdate,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS ver
FROM orders""")
cte("ef", "v", """
SELECT 'cust.' || v.c AS contract_id, v.c AS c, 'v' || ver AS version, ver AS version_num,
  lower(replace(p_brand, '#', '_')) AS field_name,
  CASE WHEN v.c % 13 = 0 AND ver % 6 = 0 AND n % 5 = 1 THEN 'boolean'
       WHEN n % 3 = 0 THEN 'string' WHEN n % 3 = 1 THEN 'number' ELSE 'integer' END AS type,
  v.c % 7 = 0 AND ver = fv AS required, n % 4 = 0 AS nullable,
  CASE WHEN n % 2 = 0
       THEN list_transform(range(1, 2 + least((ver - fv) // 3, 3)), lambda i: 'E' || i)
       ELSE CAST([] AS VARCHAR[]) END AS enum_values
FROM v JOIN (
  SELECT c, p_brand, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS n, min(ver) AS fv
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN v ON l_orderkey = o_orderkey
  GROUP BY c, p_brand) f ON v.c = f.c
WHERE ver >= fv AND NOT (v.c % 11 = 0 AND ver % 4 = 0 AND n % 5 = 0)""")
cte("cf", "v", """
SELECT 'cust.' || c AS contract_id, c, 'v' || ver AS version, ver AS version_num,
  lower(replace(p_brand, '#', '_')) AS field_name,
  CASE min(l_returnflag) WHEN 'A' THEN 'string' WHEN 'N' THEN 'number' ELSE 'integer' END AS type,
  bool_or(l_linestatus = 'F') AS required, bool_or(l_discount > 0.05) AS nullable,
  CASE WHEN (ver + length(p_brand)) % 4 = 0 THEN CAST([] AS VARCHAR[])
       ELSE list_sort(list_distinct(list('E' || l_linenumber))) END AS enum_values
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN v ON l_orderkey = o_orderkey
GROUP BY c, ver, p_brand""")
cte("owners", "", """
SELECT 'cust.' || c_custkey AS contract_id, c_custkey AS c, lower(c_mktsegment) AS owner_team,
  lower(n_name) AS domain,
  CASE c_custkey % 3 WHEN 0 THEN 'BACKWARD' WHEN 1 THEN 'FORWARD' ELSE 'FULL' END AS mode,
  CASE c_custkey % 5 WHEN 1 THEN 'strict' WHEN 2 THEN 'relaxed' WHEN 3 THEN 'BASELINE '
    WHEN 4 THEN 'nope' END AS asked_pack,
  CASE c_custkey % 5 WHEN 1 THEN 'strict' WHEN 2 THEN 'relaxed' ELSE 'baseline' END AS pack,
  list_transform(range(0, c_custkey % 4), lambda i: 'svc-' || i) AS consumers
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
cte("cr", "v", """
SELECT *,
  CASE WHEN NOT unstarted THEN created_at END AS started_at,
  CASE WHEN NOT unstarted AND status <> 'RUNNING'
    THEN strftime(created + to_seconds(k % 97), '%Y-%m-%dT%H:%M:%S') || tail END AS finished_at
FROM (
  SELECT *, status = 'QUEUED' OR k % 5 = 2 AS unstarted,
    strftime(created, '%Y-%m-%dT%H:%M:%S') || tail AS created_at,
    created + CASE WHEN k % 3 = 0 THEN INTERVAL 500 MILLISECOND ELSE INTERVAL 0 SECOND END AS happened
  FROM (
    SELECT 'run-' || o_orderkey AS run_id, o_orderkey AS k, c, 'cust.' || c AS contract_id,
      'v' || (1 + ver % 3) AS base_version, 'v' || (2 + ver % 3) AS candidate_version,
      CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'P' THEN 'PASS'
        ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'QUEUED' ELSE 'RUNNING' END END AS status,
      CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0
             THEN 'Field removed: amount | Required field added: region'
           WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 1
             THEN '["Field removed: f' || (o_orderkey % 7) || '"]'
           ELSE '[]' END AS breaking_changes,
      CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 1
             THEN '["Execution error: IllegalStateException: Schema file does not exist"]'
           WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0
             THEN '["Enum value added: status.E' || (o_orderkey % 9) || '"]'
           ELSE '[]' END AS warnings,
      'sha-' || (o_orderkey % 100) AS commit_sha,
      CASE WHEN o_orderkey % 7 <> 0 THEN 'cli' END AS triggered_by,
      CASE WHEN o_orderkey % 11 <> 0 THEN 'BACKWARD' END AS compatibility_mode,
      o_orderdate + to_seconds(o_orderkey % 86400) AS created,
      CASE WHEN o_orderkey % 3 = 0 THEN '.500Z' ELSE 'Z' END AS tail
    FROM v))""")
# The runs with their lists: what they hold follows from the rule above, not from parsing.
cte("crl", "cr", """
SELECT *,
  CASE WHEN status = 'FAIL' AND k % 5 = 0
         THEN ['Field removed: amount', 'Required field added: region']
       WHEN status = 'FAIL' AND k % 5 <> 1 THEN ['Field removed: f' || (k % 7)]
       ELSE CAST([] AS VARCHAR[]) END AS breaking,
  CASE WHEN status = 'FAIL' AND k % 5 = 1
         THEN ['Execution error: IllegalStateException: Schema file does not exist']
       WHEN status = 'PASS' AND k % 4 = 0 THEN ['Enum value added: status.E' || (k % 9)]
       ELSE CAST([] AS VARCHAR[]) END AS warned
FROM cr""")
cte("resp", "crl", """
SELECT run_id, contract_id, base_version, candidate_version, status,
  CASE status WHEN 'PASS' THEN 'SUCCESS' WHEN 'FAIL' THEN 'FAILED' ELSE status END AS execution_state,
  array_to_string(breaking, '; ') AS breaking_changes, array_to_string(warned, '; ') AS warnings,
  commit_sha, created_at, triggered_by, started_at, finished_at, happened
FROM crl""")
cte("lg", "", """
SELECT 'log-' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS log_id,
  'run-' || l_orderkey AS run_id, l_orderkey AS k, l_linenumber AS n, l_returnflag AS flag,
  CASE l_returnflag WHEN 'A' THEN 'ERROR' WHEN 'N' THEN 'INFO' ELSE 'WARN' END AS level,
  CASE l_returnflag
    WHEN 'A' THEN 'code=check_run_attempt_failed attempt=' || l_linenumber
      || ' message=IllegalStateException: line ' || l_linenumber
    WHEN 'N' THEN 'code=check_run_completed status=PASS message=Check run completed.'
    ELSE 'code=check_run_requeued attempt=' || l_linenumber
      || ' maxRetries=2 message=Run re-queued for retry.' END AS message,
  strftime(l_shipdate + to_seconds(l_partkey % 86400), '%Y-%m-%dT%H:%M:%SZ') AS created_at
FROM lineitem""")
cte("au", "", """
SELECT event_id, 'audit-' || event_id AS audit_id, user_id,
  CASE event_type WHEN 'signup' THEN 'CONTRACT_CREATE' WHEN 'purchase' THEN 'CONTRACT_VERSION_CREATE'
    ELSE 'CHECK_RUN_CREATE' END AS action,
  'user-' || user_id AS actor, 'USER,WRITER' AS actor_roles,
  CASE WHEN event_type <> 'error' THEN 'res-' || event_id END AS resource_id,
  CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS status, ts,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at
FROM events""")
cte("rq", "cr", """
SELECT 'req-' || k AS request_id, k, c,
  CASE WHEN c % 10 = 3 THEN 'ghost.' || c ELSE contract_id END AS contract_id, base_version,
  CASE WHEN c % 10 = 4 THEN 'v99' WHEN c % 10 = 6 THEN base_version ELSE candidate_version END
    AS candidate_version,
  CASE WHEN c % 10 = 5 THEN 'SIDEWAYS' WHEN k % 3 = 0 THEN 'BACKWARD' WHEN k % 3 = 1 THEN 'FORWARD'
    ELSE 'FULL' END AS mode,
  CASE WHEN k % 10 <> 4 THEN commit_sha END AS commit_sha,
  CASE WHEN c % 10 = 7 AND k % 4 = 2 THEN '' ELSE 'ci' END AS triggered_by,
  CASE WHEN c % 10 = 6 THEN 'baseVersion must differ from candidateVersion.'
       WHEN c % 10 = 5 THEN 'mode must be one of BACKWARD, FORWARD, FULL.'
       WHEN c % 10 = 7 AND k % 4 = 2 THEN 'triggeredBy must not be blank.' END AS error
FROM cr WHERE status = 'QUEUED'""")

# --- diff and verdicts, over tables `f` (fields), `p` (pairs) and `ck` (checks) -----------------

PAIRS = """
SELECT contract_id, 'v' || base AS base_version, 'v' || num AS candidate_version FROM (
  SELECT contract_id, version_num AS num,
    lag(version_num) OVER (PARTITION BY contract_id ORDER BY version_num) AS base
  FROM vs) WHERE base IS NOT NULL"""
LATEST = """
SELECT contract_id, 'v' || max(CASE WHEN r = 2 THEN version_num END) AS base_version,
  'v' || max(CASE WHEN r = 1 THEN version_num END) AS candidate_version
FROM (SELECT contract_id, version_num,
        row_number() OVER (PARTITION BY contract_id ORDER BY version_num DESC) AS r
      FROM vs)
WHERE r <= 2 GROUP BY contract_id HAVING count(*) = 2"""
_KEYS = "contract_id, base_version, candidate_version"


def _side(version: str) -> str:
    return (
        "(SELECT p.contract_id, p.base_version, p.candidate_version, f.field_name, f.type, "
        "f.required, f.nullable, f.enum_values FROM p JOIN f ON f.contract_id = p.contract_id "
        f"AND f.version = p.{version})"
    )


def _display(side: str) -> str:
    return (
        f"CASE WHEN {side}n AND NOT contains({side}t, 'null') THEN {side}t || '|null' "
        f"ELSE {side}t END"
    )


ALIGNED = f"""
SELECT coalesce(b.contract_id, a.contract_id) AS contract_id,
  coalesce(b.base_version, a.base_version) AS base_version,
  coalesce(b.candidate_version, a.candidate_version) AS candidate_version,
  coalesce(b.field_name, a.field_name) AS f, b.field_name IS NOT NULL AS hb,
  a.field_name IS NOT NULL AS ha, b.type AS bt, a.type AS qt, b.nullable AS bn, a.nullable AS qn,
  coalesce(b.required, false) AS br, coalesce(a.required, false) AS qr,
  b.enum_values AS be, a.enum_values AS qe
FROM {_side("base_version")} b FULL JOIN {_side("candidate_version")} a
ON b.contract_id = a.contract_id AND b.base_version = a.base_version
  AND b.candidate_version = a.candidate_version AND b.field_name = a.field_name"""
_NO_TYPES = "CAST(NULL AS VARCHAR) AS old_type, CAST(NULL AS VARCHAR) AS new_type"
CHANGES = f"""
SELECT {_KEYS}, 'FIELD_ADDED' AS kind, f AS subject, {_NO_TYPES} FROM al WHERE NOT hb
UNION ALL SELECT {_KEYS}, 'FIELD_REMOVED', f, NULL, NULL FROM al WHERE NOT ha
UNION ALL SELECT {_KEYS}, 'FIELD_TYPE_CHANGED', f, {_display("b")}, {_display("q")}
  FROM al WHERE hb AND ha AND (bt <> qt OR bn <> qn)
UNION ALL SELECT {_KEYS}, 'REQUIRED_FIELD_ADDED', f, NULL, NULL FROM al WHERE qr AND NOT br
UNION ALL SELECT {_KEYS}, 'REQUIRED_FIELD_REMOVED', f, NULL, NULL FROM al WHERE br AND NOT qr
UNION ALL SELECT {_KEYS}, 'ENUM_VALUE_ADDED', f || '.' || u, NULL, NULL FROM (
  SELECT *, unnest(list_filter(qe, lambda x: NOT list_contains(be, x))) AS u FROM al WHERE hb AND ha)
UNION ALL SELECT {_KEYS}, 'ENUM_VALUE_REMOVED', f || '.' || u, NULL, NULL FROM (
  SELECT *, unnest(list_filter(be, lambda x: NOT list_contains(qe, x))) AS u FROM al WHERE hb AND ha)"""

RULE_ROWS = """SELECT * FROM (VALUES
 ('FIELD_REMOVED', 0, 'Field removed: ', 'FIELD_ADDED'),
 ('FIELD_TYPE_CHANGED', 1, 'Field type changed: ', 'FIELD_TYPE_CHANGED'),
 ('REQUIRED_FIELD_ADDED', 2, 'Required field added: ', 'REQUIRED_FIELD_REMOVED'),
 ('ENUM_VALUE_REMOVED', 3, 'Enum value removed: ', 'ENUM_VALUE_ADDED'),
 ('ENUM_VALUE_ADDED', 4, 'Enum value added: ', 'ENUM_VALUE_REMOVED')) AS t(rule, ord, label, mirrored)"""
SEVERITY_ROWS = """
SELECT pack, rule, CASE WHEN rule <> 'ENUM_VALUE_ADDED' THEN 'BREAKING' ELSE level END AS severity
FROM (VALUES ('baseline', 'WARNING'), ('strict', 'BREAKING'), ('relaxed', 'IGNORE'),
  ('empty', 'WARNING'), ('nullsev', 'BREAKING')) AS p(pack, level), rl"""
MESSAGES = """
SELECT ck.*, 0 AS dir, ord, t.text, label || t.text AS msg, severity
FROM ck JOIN (SELECT *, CASE WHEN old_type IS NULL THEN subject
    ELSE subject || ' (' || old_type || ' -> ' || new_type || ')' END AS text FROM ch) t
  USING (contract_id, base_version, candidate_version)
JOIN rl ON rl.rule = t.kind JOIN sev ON sev.pack = ck.pack AND sev.rule = rl.rule
WHERE mode IN ('BACKWARD', 'FULL')
UNION ALL
SELECT ck.*, 1 AS dir, ord, t.text, '[FORWARD] ' || label || t.text AS msg, severity
FROM ck JOIN (SELECT *, CASE WHEN old_type IS NULL THEN subject
    ELSE subject || ' (' || new_type || ' -> ' || old_type || ')' END AS text FROM ch) t
  USING (contract_id, base_version, candidate_version)
JOIN rl ON rl.mirrored = t.kind JOIN sev ON sev.pack = ck.pack AND sev.rule = rl.rule
WHERE mode IN ('FORWARD', 'FULL')"""
VERDICTS = """
SELECT ck.contract_id, ck.base_version, ck.candidate_version, ck.mode, ck.pack,
  CASE WHEN coalesce(bool_or(severity = 'BREAKING'), false) THEN 'FAIL' ELSE 'PASS' END AS status,
  coalesce(string_agg(msg, '; ' ORDER BY dir, ord, text) FILTER (WHERE severity = 'BREAKING'), '')
    AS breaking_changes,
  coalesce(string_agg(msg, '; ' ORDER BY dir, ord, text) FILTER (WHERE severity = 'WARNING'), '')
    AS warnings
FROM ck LEFT JOIN ms USING (contract_id, base_version, candidate_version, mode, pack)
GROUP BY ALL"""


# Every order is a version, whether it has a field or not.
ALL_VERSIONS = "SELECT 'cust.' || c AS contract_id, ver AS version_num FROM v"


def diffs(fields: str, pairs: str = PAIRS, versions: str = ALL_VERSIONS) -> dict[str, str]:
    return {"f": f"SELECT * FROM {fields}", "vs": versions, "p": pairs, "al": ALIGNED, "ch": CHANGES}


def verdicts(
    fields: str, checks: str, pairs: str = PAIRS, versions: str = ALL_VERSIONS
) -> dict[str, str]:
    return {
        **diffs(fields, pairs, versions),
        "rl": RULE_ROWS,
        "sev": SEVERITY_ROWS,
        "ck": checks,
        "ms": MESSAGES,
        "res": VERDICTS,
    }


# --- lint --------------------------------------------------------------------------------------

_ODD = "CASE WHEN c % 50 = 10 THEN 'Cust-' || c ELSE 'cust.' || c END"
cte("fd", "cf", f"""
SELECT DISTINCT c, {_ODD} AS contract_id, version, version_num FROM cf WHERE c % 50 <> 16""")
cte("docv", "fd", """
SELECT contract_id, version, field_name, rule, message FROM fd JOIN (VALUES
 (1, NULL, 'schema_invalid_json', 'Invalid JSON in schema file: v1.json'),
 (2, NULL, 'schema_not_object', 'Schema must be a JSON object: v1.json'),
 (3, NULL, 'required_unknown_field', '''required'' references unknown properties in v1.json: Ghost'),
 (4, 'a', 'type_missing', 'Property ''a'' in v1.json must define ''type''.'),
 (5, 'a', 'enum_not_array', 'Property ''a'' in v1.json has invalid ''enum''.'),
 (6, NULL, 'required_not_array', '''required'' must be an array in v1.json.'),
 (11, 'a', 'enum_value_not_scalar', 'Property ''a'' in v1.json has non-scalar enum value.'),
 (12, NULL, 'properties_not_object', '''properties'' must be an object in v1.json.'),
 (13, 'a', 'type_invalid', 'Property ''a'' in v1.json has invalid ''type'' definition.'),
 (14, NULL, 'required_item_not_string', 'Each value in ''required'' must be a string in v1.json.'),
 (15, 'a', 'type_unknown', 'Property ''a'' in v1.json must define a valid ''type''.'),
 (17, 'a', 'property_not_object', 'Property ''a'' must be an object in v1.json.'),
 (18, 'a', 'type_entry_not_string', 'Property ''a'' in v1.json has non-string type entry.')
) AS t(fault, field_name, rule, message) ON fd.c % 50 = t.fault WHERE version_num = 1
UNION ALL SELECT contract_id, 'v3000000000', NULL, 'version_out_of_range',
  'Version number out of range: v3000000000.json' FROM fd WHERE c % 50 = 23 AND version_num = 1""")
cte("lintv", "docv", f"""
SELECT * FROM docv UNION ALL
SELECT contract_id, NULL, NULL, rule, message FROM (
  SELECT c, {_ODD} AS contract_id, c IN (SELECT c FROM fd) AS has_docs
  FROM (SELECT c_custkey AS c FROM customer)) x, LATERAL (
  SELECT 'contract_id_format' AS rule, 'Invalid contract directory name ''' || contract_id
    || '''. Expected lowercase dot-separated format.' AS message WHERE c % 50 = 10
  UNION ALL SELECT 'metadata_missing', 'Missing metadata.yaml in contract directory: ' || contract_id
    WHERE c % 50 = 7 AND has_docs
  UNION ALL SELECT 'metadata_malformed', 'metadata.yaml is no mapping.' WHERE c % 50 = 22
  UNION ALL SELECT 'compatibility_mode_missing',
    'metadata.yaml must define non-empty ''compatibilityMode''.' WHERE c % 50 = 20
  UNION ALL SELECT 'compatibility_mode_invalid',
    'Invalid compatibilityMode ''SIDEWAYS''. Allowed: BACKWARD, FORWARD, FULL.' WHERE c % 50 = 9
  UNION ALL SELECT 'owner_team_missing', 'metadata.yaml must define non-empty ''ownerTeam''.'
    WHERE c % 50 = 8
  UNION ALL SELECT 'domain_missing', 'metadata.yaml must define non-empty ''domain''.'
    WHERE c % 50 = 19
  UNION ALL SELECT 'no_version_files',
    'No versioned schema files found. Expected files like v1.json.'
    WHERE NOT has_docs AND c % 50 <> 7)""")
# --- documents, pairs, diff --------------------------------------------------------------------

oracle("schema_fields", "cf", """
SELECT contract_id, version, version_num, field_name, type, required, nullable,
  array_to_string(enum_values, ',') AS enum_values FROM cf""")
oracle("display_types", "cf", """
SELECT CASE WHEN nullable THEN type || '|null' ELSE type END AS display_type, required,
  count(*) AS fields FROM cf GROUP BY ALL""")
_FIELD_VERSIONS = "SELECT DISTINCT contract_id, version_num FROM ef"
oracle("adjacent_pairs", "ef", "SELECT * FROM p", vs=_FIELD_VERSIONS, p=PAIRS)
oracle("latest_pairs", "ef", "SELECT * FROM p", vs=_FIELD_VERSIONS, p=LATEST)
oracle("schema_diff", "cf", f"""
SELECT {_KEYS}, kind, subject,
  CASE WHEN kind = 'FIELD_TYPE_CHANGED' THEN old_type || ' -> ' || new_type END AS detail
FROM ch""", **diffs("cf"))
oracle("diff_report", "cf", f"""
SELECT {_KEYS}, 'Schema diff:' || chr(10) || coalesce(
  string_agg(label || text, chr(10) ORDER BY ord, text) FILTER (WHERE text IS NOT NULL),
  'No semantic differences found.') AS report
FROM p LEFT JOIN (
  SELECT ch.*, s.ord, s.label, CASE WHEN old_type IS NULL THEN subject
    ELSE subject || ' (' || old_type || ' -> ' || new_type || ')' END AS text
  FROM ch JOIN (VALUES ('FIELD_ADDED', 0, '+ field added: '), ('FIELD_REMOVED', 1, '- field removed: '),
    ('FIELD_TYPE_CHANGED', 2, '~ type changed: '), ('REQUIRED_FIELD_ADDED', 3, '! required added: '),
    ('REQUIRED_FIELD_REMOVED', 4, '! required removed: '),
    ('ENUM_VALUE_ADDED', 5, '~ enum value added: '),
    ('ENUM_VALUE_REMOVED', 6, '~ enum value removed: ')) AS s(kind, ord, label) USING (kind)) t
USING (contract_id, base_version, candidate_version) GROUP BY ALL""", **diffs("cf"))


def fixed_checks(mode: str, pack: str) -> str:
    return f"SELECT *, '{mode}' AS mode, '{pack}' AS pack FROM p"


for _name, _fields, _mode, _pack in (
    ("compat_backward", "ef", "BACKWARD", "baseline"),
    ("compat_forward", "ef", "FORWARD", "baseline"),
    ("compat_full", "ef", "FULL", "baseline"),
    ("compat_full_null_severity", "ef", "FULL", "nullsev"),
    ("compat_churn", "cf", "FULL", "relaxed"),
):
    oracle(_name, _fields, "SELECT * FROM res", **verdicts(_fields, fixed_checks(_mode, _pack)))
OWN_CHECKS = "SELECT p.*, owners.mode, owners.pack FROM p JOIN owners USING (contract_id)"
oracle("compat_by_contract_policy", "ef owners", "SELECT * FROM res", **verdicts("ef", OWN_CHECKS))
oracle("compat_errors", "docv", """
SELECT contract_id, base_version, candidate_version, mode, error IS NULL AS judged, error FROM (
  SELECT ck.*, coalesce(
    CASE WHEN NOT hb THEN 'Schema file does not exist: ' || ck.contract_id || '/' || base_version || '.json' END,
    b.message,
    CASE WHEN NOT ha THEN 'Schema file does not exist: ' || ck.contract_id || '/' || candidate_version || '.json' END,
    a.message,
    CASE WHEN mode IS NULL OR mode NOT IN ('BACKWARD', 'FULL')
      THEN 'Unknown compatibility mode: ' || coalesce(mode, 'none') END) AS error
  FROM (
    SELECT contract_id, base_version, candidate_version,
      CASE c % 5 WHEN 0 THEN 'BACKWARD' WHEN 1 THEN 'SIDEWAYS' WHEN 3 THEN 'BACKWARD' || chr(9)
        WHEN 4 THEN 'FULL' END AS mode,
      (contract_id, base_version) IN (SELECT (contract_id, version) FROM fdx) AS hb,
      (contract_id, candidate_version) IN (SELECT (contract_id, version) FROM fdx) AS ha
    FROM (SELECT DISTINCT c, contract_id FROM fd),
      (VALUES ('v1', 'v2'), ('v2', 'v9999'), ('v1', 'v3000000000')) AS t(base_version, candidate_version)) ck
  LEFT JOIN docv b ON b.contract_id = ck.contract_id AND b.version = base_version
  LEFT JOIN docv a ON a.contract_id = ck.contract_id AND a.version = candidate_version)""", fdx="""
SELECT contract_id, version FROM fd UNION ALL
SELECT contract_id, 'v3000000000' FROM fd WHERE c % 50 = 23 AND version_num = 1""")
oracle("policy_rule_errors", "", """
WITH cfg AS (SELECT c_custkey AS c, 'cust.' || c_custkey AS config_id FROM customer),
rules AS (
  SELECT *, CASE c % 4 WHEN 0 THEN 'FIELD_REMOVED' WHEN 1 THEN ' field-removed' WHEN 2 THEN 'FIELD_GONE' ELSE ' ' END AS rule,
    CASE c % 3 WHEN 0 THEN 'BREAKING' WHEN 1 THEN 'breaking' END AS level FROM cfg WHERE c % 7 <> 0 AND c % 11 <> 0
  UNION ALL SELECT *, 'enum_value-added', CASE c % 5 WHEN 0 THEN 'WARNING' WHEN 1 THEN 'IGNORE'
    WHEN 2 THEN 'LOUD' WHEN 3 THEN 'BREAKING' ELSE '' END FROM cfg WHERE c % 7 <> 0 AND c % 11 <> 0)
SELECT config_id, 'own' AS pack, rule, CASE WHEN rule = 'FIELD_GONE' THEN 'Unknown policy rule id: FIELD_GONE'
  ELSE 'Unknown severity: ' || level END AS message
FROM rules WHERE rule = 'FIELD_GONE' OR level NOT IN ('BREAKING', 'WARNING', 'IGNORE')
UNION ALL SELECT config_id, NULL, NULL, 'Policy configuration is no JSON object.' FROM cfg
WHERE c % 7 = 0 OR c % 11 = 0""")
cte("configs", "", """
SELECT c_custkey AS c, 'cust.' || c_custkey AS contract_id,
  CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN 'Policy configuration is no JSON object.'
    WHEN c_custkey % 4 = 2 THEN 'Unknown policy rule id: FIELD_GONE'
    WHEN c_custkey % 3 = 1 THEN 'Unknown severity: breaking'
    WHEN c_custkey % 5 = 2 THEN 'Unknown severity: LOUD'
    WHEN c_custkey % 5 = 4 THEN 'Unknown severity: ' END AS config_error,
  CASE c_custkey % 5 WHEN 0 THEN 'WARNING' WHEN 1 THEN 'IGNORE' WHEN 3 THEN 'BREAKING' END AS own
FROM customer""")
oracle("pack_table", "configs", """
SELECT contract_id AS config_id, pack, pack = 'own' AS is_default,
  'BREAKING,BREAKING,BREAKING,BREAKING,' || CASE WHEN pack = 'own' THEN own ELSE 'WARNING' END AS levels,
  CAST(NULL AS VARCHAR) AS config_error
FROM configs, (VALUES ('none'), ('bare'), ('own'), ('baseline')) AS t(pack) WHERE config_error IS NULL
UNION ALL SELECT contract_id, NULL, true, NULL, config_error FROM configs WHERE config_error IS NOT NULL""")
# A contract's own pack has the contract's name here, as severities are looked up by pack.
oracle("compat_own_packs", "ef owners configs", """
SELECT res.contract_id, base_version, candidate_version, res.mode,
  CASE WHEN config_error IS NULL THEN CASE WHEN res.pack = 'baseline' THEN 'baseline' ELSE 'own' END END AS pack,
  CASE WHEN config_error IS NULL THEN status ELSE 'ERROR' END AS status,
  CASE WHEN config_error IS NULL THEN breaking_changes ELSE '' END AS breaking_changes,
  CASE WHEN config_error IS NULL THEN warnings ELSE '' END AS warnings, config_error AS error
FROM res JOIN configs USING (contract_id)""", **{
    **verdicts("ef", """
SELECT p.*, owners.mode, CASE WHEN owners.asked_pack = 'BASELINE ' THEN 'baseline' ELSE contract_id END AS pack
FROM p JOIN owners USING (contract_id)"""),
    "sev": SEVERITY_ROWS + """
UNION ALL SELECT contract_id, rule, CASE WHEN rule <> 'ENUM_VALUE_ADDED' THEN 'BREAKING' ELSE own END
FROM configs, rl WHERE config_error IS NULL""",
})
oracle("contract_policies", "owners", """
SELECT contract_id, owners.pack, sev.rule AS rule_id, severity
FROM owners JOIN sev ON sev.pack = owners.pack""", rl=RULE_ROWS, sev=SEVERITY_ROWS)

# --- lint: results ----------------------------------------------------------------------------

oracle("lint_violations", "lintv", "SELECT * FROM lintv")
oracle("lint_failing_contracts", "lintv",
       "SELECT contract_id, count(*) AS violation_count FROM lintv GROUP BY contract_id")
oracle("document_errors", "docv", "SELECT contract_id, version, message AS document_error FROM docv")
assert set(FAULTY_DOCS) - {21} == {1, 2, 3, 4, 5, 6, 11, 12, 13, 14, 15, 17, 18}

# --- catalogue ---------------------------------------------------------------------------------

cte("cat", "owners ef", """
SELECT contract_id, owner_team, domain, mode AS compatibility_mode, pack AS policy_pack,
  'v' || top AS latest_version, coalesce(n, 0) AS version_count, 'ACTIVE' AS status
FROM owners LEFT JOIN (SELECT contract_id, max(version_num) AS top, count(DISTINCT version_num) AS n
  FROM ef GROUP BY contract_id) USING (contract_id)""")
oracle("contract_catalog", "cat", "SELECT * FROM cat")
oracle("contract_search", "cat", """SELECT * FROM cat WHERE contains(contract_id, 'mach')
  OR contains(owner_team, 'mach') OR contains(domain, 'mach')""")
oracle("contract_versions", "ef", "SELECT DISTINCT contract_id, version, version_num FROM ef")
oracle("contract_document", "cf", """
SELECT contract_id, version, '{"type":"object","properties":{'
  || string_agg('"' || field_name || '":{"type":'
    || CASE WHEN nullable AND version_num % 2 = 0 THEN '["' || type || '","null"]'
       ELSE '"' || type || '"' END
    || CASE WHEN nullable AND version_num % 2 = 1 THEN ',"nullable":true' ELSE '' END
    || CASE WHEN len(enum_values) > 0
       THEN ',"enum":["' || array_to_string(enum_values, '","') || '"]' ELSE '' END || '}',
    ',' ORDER BY field_name)
  || '},"required":['
  || coalesce(string_agg('"' || field_name || '"', ',' ORDER BY field_name) FILTER (WHERE required), '')
  || ']}' AS schema_json
FROM cf WHERE contract_id = 'cust.7' AND version = 'v2' GROUP BY contract_id, version""")
oracle("contract_count", "", "SELECT count(*) AS contract_count FROM customer")
oracle("contract_modified", "", """
SELECT 'cust.' || o_custkey AS contract_id,
  strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS modified_at FROM orders GROUP BY o_custkey""")

# --- history -----------------------------------------------------------------------------------

oracle("runs_list", "resp", "SELECT * EXCLUDE (happened) FROM resp")
_PAGE = """
SELECT * EXCLUDE (happened, total, place), CAST(place - {offset} AS INTEGER) AS position,
  total > {offset} + {limit} AS has_more
FROM (SELECT *, row_number() OVER (ORDER BY happened DESC, run_id DESC) AS place,
        count(*) OVER () AS total FROM resp {where})
WHERE place > {offset} AND place <= {offset} + {limit}"""
oracle("runs_page", "resp", _PAGE.format(offset=100, limit=50, where="WHERE status = 'PASS'"))
oracle("recent_runs", "resp", _PAGE.format(offset=0, limit=20, where=""))
oracle("run_by_id", "resp", "SELECT * EXCLUDE (happened) FROM resp WHERE run_id = 'run-7'")
oracle("run_logs", "lg",
       "SELECT log_id, run_id, level, message, created_at FROM lg WHERE run_id = 'run-7'")
oracle("runs_page_after", "resp", _PAGE.format(offset=25, limit=25, where=""))
oracle("history_round_trip", "cr lg au", """
SELECT 'run' AS kind, cr.run_id AS id, status, cr.created_at, coalesce(logs, 0) AS logs, l.message
FROM cr LEFT JOIN (SELECT run_id, count(*) AS logs, max(message) AS message FROM lg GROUP BY run_id) l
  ON l.run_id = cr.run_id
UNION ALL SELECT 'audit', audit_id, status, created_at, 0, NULL FROM au""")
oracle("stored_run_by_id", "cr lg", """
SELECT cr.run_id, status, commit_sha, log_id, level, message
FROM cr JOIN lg ON lg.run_id = cr.run_id WHERE cr.run_id = 'run-7'""")
oracle("run_with_logs", "cr lg", """
SELECT cr.run_id, contract_id, status, log_id, level, message, lg.created_at
FROM cr JOIN lg USING (run_id)""")
oracle("oldest_queued", "cr", """
SELECT run_id, contract_id, base_version, candidate_version, compatibility_mode, commit_sha,
  triggered_by, created_at FROM cr WHERE status = 'QUEUED' ORDER BY happened, run_id LIMIT 3""")
oracle("parsed_details", "crl", """
SELECT run_id, 'breaking' AS kind, CAST(i - 1 AS INTEGER) AS place, breaking[i] AS message
FROM (SELECT *, unnest(range(1, len(breaking) + 1)) AS i FROM crl)
UNION ALL SELECT run_id, 'warning', CAST(i - 1 AS INTEGER), warned[i]
FROM (SELECT *, unnest(range(1, len(warned) + 1)) AS i FROM crl)""")
oracle("details_as_json", "crl", """
SELECT run_id, CASE WHEN len(breaking) = 0 THEN '[]'
  ELSE '["' || array_to_string(breaking, '","') || '"]' END AS json FROM crl""")
oracle("execution_states", "cr", """
SELECT CASE WHEN k % 13 = 0 THEN 'UNKNOWN' WHEN status = 'PASS' THEN 'SUCCESS'
  WHEN status = 'FAIL' THEN 'FAILED' ELSE status END AS state, count(*) AS runs
FROM cr GROUP BY ALL""")
_HASHED = ("contract_id || '|' || base_version || '|' || candidate_version || '|' || {mode} || '|' "
           "|| coalesce(commit_sha, '-') || '|' || coalesce(triggered_by, '-')")
oracle("input_hashes", "cr", f"""
SELECT run_id, sha256({_HASHED.format(mode="coalesce(compatibility_mode, '-')")}) AS service_hash,
  sha256({_HASHED.format(mode="coalesce(compatibility_mode, 'BACKWARD')")}) AS cli_hash FROM cr""")
oracle("normalised_values", "", """
SELECT c_custkey,
  CASE c_custkey % 9 WHEN 0 THEN 'v1' WHEN 4 THEN 'v12' WHEN 5 THEN 'v99999999999' END AS version_name,
  CAST(CASE c_custkey % 9 WHEN 0 THEN 1 WHEN 4 THEN 12 END AS INTEGER) AS version_num,
  CASE c_custkey % 6 WHEN 0 THEN 'BACKWARD' WHEN 1 THEN 'FULL' WHEN 5 THEN 'FORWARD' ELSE '-' END AS mode,
  CASE c_custkey % 5 WHEN 0 THEN 'a' WHEN 4 THEN 'b c' ELSE 'none' END AS note_or_none,
  CASE c_custkey % 5 WHEN 0 THEN 'a' WHEN 4 THEN 'b c' END AS note_or_null,
  CASE c_custkey % 5 WHEN 0 THEN ' a ' WHEN 4 THEN 'b c' ELSE '-' END AS note_or_dash,
  CASE c_custkey % 5 WHEN 0 THEN 'a' WHEN 4 THEN 'b c' ELSE 'unknown' END AS tag,
  CASE c_custkey % 4 WHEN 0 THEN 'jdbc:postgresql://***:***@host/db#' || c_custkey
    WHEN 1 THEN 'jdbc:postgresql://host/db?user=u&PASSWORD=****&x=1#' || c_custkey
    WHEN 2 THEN 'jdbc:sqlite:checks.db#' || c_custkey
    ELSE 'jdbc:postgresql://h/db?password=****;password=****' END AS url,
  CASE c_custkey % 4 WHEN 0 THEN 'A,B' WHEN 3 THEN 'USER,writer' ELSE '-' END AS roles,
  CASE c_custkey % 4 WHEN 0 THEN 'svc-a|svc-b' WHEN 3 THEN 'one' ELSE '' END AS consumers
FROM customer""")

# --- insights ----------------------------------------------------------------------------------

cte("impact", "owners crl", """
SELECT t.contract_id, t.version,
  CASE WHEN r.run_id IS NULL THEN 'LOW' WHEN len(breaking) > 0 THEN 'HIGH'
    WHEN len(warned) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN r.run_id IS NULL THEN 'No historical check run found for this version.'
    WHEN len(breaking) > 0 THEN breaking[1] WHEN len(warned) > 0 THEN warned[1]
    ELSE 'No breaking or warning changes detected.' END AS reason, t.consumers
FROM (SELECT contract_id, consumers, unnest(['v1', 'v2', 'v3', 'v4']) AS version FROM owners) t
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY contract_id, candidate_version
    ORDER BY happened DESC, run_id DESC) AS place FROM crl) r
ON r.place = 1 AND r.contract_id = t.contract_id AND r.candidate_version = t.version""")
oracle("impact_analysis", "impact",
       "SELECT * REPLACE (array_to_string(consumers, ',') AS consumers) FROM impact")
oracle("impact_consumers", "impact", """
SELECT contract_id, version, risk_level,
  unnest(CASE WHEN len(consumers) = 0 THEN [NULL] ELSE consumers END) AS consumer FROM impact""")
oracle("contract_badge", "owners cr", """
SELECT o.contract_id, 1 AS schema_version, o.contract_id AS label,
  CASE WHEN status IS NULL THEN 'unknown' WHEN status = 'FAIL' THEN 'failing'
    WHEN status IN ('QUEUED', 'RUNNING') THEN 'running' ELSE 'passing' END AS message,
  CASE WHEN status IS NULL THEN 'lightgrey' WHEN status = 'FAIL' THEN 'red'
    WHEN status IN ('QUEUED', 'RUNNING') THEN 'yellow' ELSE 'brightgreen' END AS color
FROM owners o LEFT JOIN (SELECT contract_id, status, row_number() OVER (PARTITION BY contract_id
    ORDER BY happened DESC, run_id DESC) AS place FROM cr) r
ON r.place = 1 AND r.contract_id = o.contract_id""")
_WHY = "Existing consumers expect this field and removal can break deserialization."
_FIX = "Re-introduce the field as optional and deprecate before removal."
oracle("explain_runs", "crl", f"""
SELECT run_id, status, len(breaking) > 0 AS is_breaking,
  CASE WHEN len(breaking) > 0 THEN 'Field ''' || substr(breaking[1], 16) || ''' was removed.'
    ELSE 'No Breaking Changes Detected' END AS headline,
  CASE WHEN len(breaking) > 0 THEN '{_WHY}' END AS why,
  CASE WHEN len(breaking) > 0 THEN '{_FIX}' END AS fix,
  CASE WHEN len(breaking) > 0 THEN
    replace('❌ Breaking Change Detected~~Field ''' || substr(breaking[1], 16) || ''' was removed.'
    || '~~Why this matters:~- {_WHY}~- Existing integrations can fail at runtime'
    || '~~How to fix:~- {_FIX}~- Mark field optional OR bump major version'
    || '~~Example:~{{~  "userId": {{ "type": "string", "nullable": true }}~}}'
    || '~~Recorded status: ' || status, '~', chr(10))
  WHEN len(warned) > 0 THEN replace('✅ No Breaking Changes Detected~~Warnings:~- ', '~', chr(10))
    || array_to_string(warned, chr(10) || '- ')
  ELSE '✅ No Breaking Changes Detected' END AS explanation
FROM crl""")
oracle("run_guidance", "crl", """
SELECT run_id, CASE
  WHEN status = 'FAIL' AND k % 5 = 0 THEN 'Avoid removing fields directly. Deprecate first and remove in a later major version. / Prefer optional fields with defaults for backwards compatibility. / Treat this as blocking for consumers until compatibility issues are resolved.'
  WHEN status = 'FAIL' AND k % 5 = 1 THEN 'Treat this as blocking for consumers until compatibility issues are resolved.'
  WHEN status = 'FAIL' THEN 'Avoid removing fields directly. Deprecate first and remove in a later major version. / Treat this as blocking for consumers until compatibility issues are resolved.'
  ELSE 'No additional guidance was generated for this check run.' END AS guidance FROM crl""")
oracle("metrics_totals", "cr", """
SELECT contract_id, 'queued' AS phase, CAST(NULL AS VARCHAR) AS outcome, count(*) AS checks
FROM cr GROUP BY contract_id
UNION ALL SELECT contract_id, 'completed', status, count(*) FROM cr
WHERE status NOT IN ('QUEUED', 'RUNNING') GROUP BY contract_id, status""")
oracle("metrics_latency", "cr", """
SELECT contract_id, count(*) AS runs, CAST(sum(k % 97 * 1000) AS BIGINT) AS total_ms,
  max(k % 97 * 1000) AS max_ms, sum(k % 97 * 1000) / count(*) AS mean_ms
FROM cr WHERE status IN ('PASS', 'FAIL') AND k % 5 <> 2 GROUP BY contract_id""")
oracle("metrics_failures", "cr au", """
SELECT contract_id, category, count(*) AS failures FROM (
  SELECT contract_id, CASE WHEN k % 5 = 1 THEN 'execution_error' ELSE 'compatibility_breaking' END
    AS category FROM cr WHERE status = 'FAIL'
  UNION ALL SELECT CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE 'cust.' || user_id END,
    'create_error' FROM au WHERE action = 'CHECK_RUN_CREATE' AND status = 'FAILURE')
GROUP BY ALL""")
_NONE = "CAST(NULL AS BIGINT) AS total_ms, CAST(NULL AS BIGINT) AS max_ms, CAST(NULL AS VARCHAR) AS run_id, CAST(NULL AS VARCHAR) AS status"
oracle("stream_metrics", "cr", f"""
SELECT contract_id, 'queued' AS measure, CAST(NULL AS VARCHAR) AS tag, count(*) AS n, {_NONE} FROM cr GROUP BY contract_id
UNION ALL SELECT contract_id, 'completed', cr.status, count(*), {_NONE} FROM cr
  WHERE cr.status IN ('PASS', 'FAIL') GROUP BY contract_id, cr.status
UNION ALL SELECT contract_id, 'failed', CASE WHEN k % 5 = 1 THEN 'execution_error' ELSE 'compatibility_breaking' END,
  count(*), {_NONE} FROM cr WHERE cr.status = 'FAIL' GROUP BY contract_id, 3
UNION ALL SELECT contract_id, 'latency', NULL, count(*), CAST(sum(k % 97 * 1000) AS BIGINT), max(k % 97 * 1000), NULL, NULL
  FROM cr WHERE status IN ('PASS', 'FAIL') AND k % 5 <> 2 GROUP BY contract_id
UNION ALL SELECT contract_id, 'latest', NULL, count(*), NULL, NULL, max_by(run_id, (happened, run_id)),
  max_by(status, (happened, run_id)) FROM cr GROUP BY contract_id
UNION ALL SELECT contract_id, 'latest_of_version', candidate_version, count(*), NULL, NULL,
  max_by(run_id, (happened, run_id)), max_by(status, (happened, run_id)) FROM cr GROUP BY contract_id, candidate_version""")
oracle("log_fields", "lg", """
SELECT log_id, run_id, level,
  CASE flag WHEN 'A' THEN 'check_run_attempt_failed' WHEN 'N' THEN 'check_run_completed'
    ELSE 'check_run_requeued' END AS code,
  CASE WHEN flag <> 'N' THEN n END AS attempt,
  CAST(CASE WHEN flag NOT IN ('A', 'N') THEN 2 END AS INTEGER) AS max_retries,
  CASE WHEN flag = 'N' THEN 'PASS' END AS status,
  CASE flag WHEN 'A' THEN 'IllegalStateException: line ' || n WHEN 'N' THEN 'Check run completed.'
    ELSE 'Run re-queued for retry.' END AS text FROM lg""")
oracle("log_attempts", "lg", """
SELECT run_id, max(n) AS attempts, count(*) AS failed_logs FROM lg WHERE flag = 'A' GROUP BY run_id""")
oracle("audit_summary", "au", "SELECT action, status, count(*) AS rows FROM au GROUP BY ALL")
oracle("audit_latest", "au", """
SELECT audit_id, action, status, actor, actor_roles, resource_id, created_at
FROM au ORDER BY ts DESC, audit_id DESC LIMIT 5""")

# --- upkeep ------------------------------------------------------------------------------------

cte("bf", "cr owners", f"""
SELECT run_id, contract_id, base_version, candidate_version, status, breaking_changes, warnings,
  commit_sha, created_at, new_by AS triggered_by, new_mode AS compatibility_mode,
  sha256(contract_id || '|' || base_version || '|' || candidate_version || '|' || new_mode || '|'
    || commit_sha || '|' || new_by) AS input_hash,
  coalesce(started_at, CASE WHEN status <> 'QUEUED' THEN created_at END) AS started_at,
  coalesce(finished_at, CASE WHEN status NOT IN ('QUEUED', 'RUNNING') THEN created_at END)
    AS finished_at
FROM (SELECT cr.*, coalesce(triggered_by, 'legacy') AS new_by,
        coalesce(compatibility_mode, mode, 'BACKWARD') AS new_mode
      FROM cr LEFT JOIN owners USING (contract_id))""")
# Every run lacks its input hash, so every row is legacy and changes.
oracle("backfill_runs", "bf", "SELECT *, true AS changed FROM bf")


def stable_id(*parts: str) -> str:
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return (
        f"regexp_replace(md5(concat_ws(chr(31), {joined})), "
        r"'^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')"
    )


_LEGACY = "Legacy check run backfilled without original execution logs."
oracle("backfill_logs", "cr", f"""
SELECT {stable_id("run_id", f"'{_LEGACY}'")} AS log_id, run_id, 'INFO' AS level,
  '{_LEGACY}' AS message, coalesce(finished_at, created_at) AS created_at
FROM cr WHERE status IN ('PASS', 'FAIL') AND k NOT IN (SELECT l_orderkey FROM lineitem)""")
cte("upd", "cr", """
SELECT *, (expected_status = 'QUEUED' AND new_status = 'RUNNING')
    OR (expected_status = 'RUNNING' AND new_status IN ('PASS', 'FAIL', 'QUEUED')) AS legal
FROM (
  SELECT 'u-' || k || '-' || turn AS update_id,
    CASE WHEN k % 50 = 0 THEN 'gone-' || k ELSE run_id END AS run_id, expected_status,
    CASE WHEN expected_status = 'QUEUED' THEN 'RUNNING' ELSE
      CASE k % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 4 THEN 'LOST' ELSE 'QUEUED' END END
      AS new_status, turn, '2002-01-01T00:00:0' || turn || 'Z' AS stamp
  FROM (SELECT run_id, k, CASE WHEN k % 6 = 0 THEN 'RUNNING' WHEN status = 'QUEUED' THEN 'QUEUED'
          ELSE 'RUNNING' END AS expected_status,
          unnest(CASE WHEN k % 9 = 0 THEN [1, 2] ELSE [1] END) AS turn FROM cr))""")
oracle("apply_transitions", "cr upd", """
SELECT cr.run_id, coalesce(new_status, status) AS status,
  CASE new_status WHEN 'FAIL' THEN '["Field removed: u1"]' WHEN 'PASS' THEN '[]'
    ELSE breaking_changes END AS breaking_changes,
  CASE WHEN new_status IN ('FAIL', 'PASS') THEN '[]' ELSE warnings END AS warnings,
  CASE new_status WHEN 'RUNNING' THEN upd.stamp WHEN 'QUEUED' THEN NULL ELSE started_at END AS started_at,
  CASE WHEN new_status IN ('PASS', 'FAIL') THEN upd.stamp WHEN new_status = 'QUEUED' THEN NULL
    ELSE finished_at END AS finished_at
FROM cr LEFT JOIN upd ON upd.run_id = cr.run_id AND upd.expected_status = cr.status
  AND upd.legal AND upd.turn = 1""")
oracle("skipped_updates", "cr upd", """
SELECT * FROM (
  SELECT update_id, upd.run_id, expected_status, new_status,
    CASE WHEN NOT legal THEN 'illegal_transition' WHEN cr.run_id IS NULL THEN 'run_not_found'
      WHEN cr.status <> expected_status THEN 'status_mismatch' WHEN turn > 1 THEN 'superseded' END
      AS reason
  FROM upd LEFT JOIN cr ON cr.run_id = upd.run_id) WHERE reason IS NOT NULL""")

cte("chain", "cr", """
SELECT *, (expected_status = 'QUEUED' AND new_status = 'RUNNING')
    OR (expected_status = 'RUNNING' AND new_status IN ('PASS', 'FAIL', 'QUEUED')) AS legal
FROM (
  SELECT run_id, 'u-' || k || '-' || turn AS update_id, turn, '2002-01-01T00:00:0' || turn || 'Z' AS stamp,
    CASE WHEN kind IN (0, 2) THEN 'QUEUED' ELSE 'RUNNING' END AS expected_status,
    CASE kind WHEN 0 THEN 'RUNNING' WHEN 2 THEN 'RUNNING' WHEN 1 THEN 'QUEUED' WHEN 3 THEN 'PASS' WHEN 4 THEN 'FAIL'
      ELSE 'LOST' END AS new_status
  FROM (SELECT run_id, k, turn, (turn * (1 + k % 5) + k) % 6 AS kind FROM cr, (SELECT unnest(range(6)) AS turn)))""")
cte("turns", "cr chain", """
SELECT * FROM (
  WITH RECURSIVE walk AS (
    SELECT run_id, 0 AS turn, status AS before, status, breaking_changes, warnings, started_at, finished_at FROM cr
    UNION ALL
    SELECT w.run_id, w.turn + 1, w.status, CASE WHEN hit THEN new_status ELSE w.status END,
      CASE WHEN hit AND new_status = 'FAIL' THEN '["Field removed: u' || c.turn || '"]'
        WHEN hit AND new_status = 'PASS' THEN '[]' ELSE breaking_changes END,
      CASE WHEN hit AND new_status IN ('FAIL', 'PASS') THEN '[]' ELSE warnings END,
      CASE WHEN hit AND new_status = 'RUNNING' THEN stamp WHEN hit AND new_status = 'QUEUED' THEN NULL ELSE started_at END,
      CASE WHEN hit AND new_status IN ('FAIL', 'PASS') THEN stamp WHEN hit AND new_status = 'QUEUED' THEN NULL
        ELSE finished_at END
    FROM walk w JOIN (SELECT * FROM chain) c ON c.run_id = w.run_id AND c.turn = w.turn,
      LATERAL (SELECT c.legal AND w.status = c.expected_status AS hit))
  SELECT * FROM walk)""")
oracle("transition_chains", "turns", """
SELECT run_id, status, breaking_changes, warnings, started_at, finished_at FROM turns WHERE turn = 6""")
ORACLE["stored_transitions"] = ORACLE["transition_chains"]
oracle("stored_backfill", "bf cr lg", """
SELECT bf.*, CASE WHEN n IS NULL AND cr.status IN ('PASS', 'FAIL') THEN 1 ELSE coalesce(n, 0) END AS logs
FROM bf JOIN cr ON cr.run_id = bf.run_id
LEFT JOIN (SELECT run_id, count(*) AS n FROM lg GROUP BY 1) l ON l.run_id = bf.run_id""")
oracle("transition_steps", "cr chain turns", """
SELECT update_id, chain.run_id, CASE WHEN legal THEN before END AS status_before,
  legal AND before = expected_status AS applied,
  CASE WHEN NOT legal THEN 'illegal_transition' WHEN before = expected_status THEN NULL
    WHEN cr.status = expected_status THEN 'superseded' ELSE 'status_mismatch' END AS reason
FROM chain JOIN cr ON cr.run_id = chain.run_id JOIN turns ON turns.run_id = chain.run_id AND turns.turn = chain.turn + 1""")

# --- composed work -----------------------------------------------------------------------------

oracle("changed_contract_ids", "", """
SELECT DISTINCT 'cust.' || o_custkey AS contract_id FROM orders WHERE o_custkey % 3 = 0""")
# Contracts with a key of fault 10 have another id, and are not among the changed ones; those of
# fault 7 have no metadata, and without documents as well they are unknown.
cte("gatec", "lintv owners", """
SELECT x.c, x.contract_id, owners.pack, owners.mode, coalesce(l.n, 0) AS violations
FROM (SELECT DISTINCT o_custkey AS c, 'cust.' || o_custkey AS contract_id FROM orders
  WHERE o_custkey % 3 = 0 AND o_custkey % 50 <> 10) x
JOIN owners ON owners.c = x.c
LEFT JOIN (SELECT contract_id, count(*) AS n FROM lintv GROUP BY 1) l ON l.contract_id = x.contract_id
WHERE x.c % 50 <> 7 OR x.c IN (SELECT c FROM fd)""")
def _gate(mode: str) -> dict[str, str]:
    parts = verdicts(
        "cf",
        f"SELECT p.*, {mode} AS mode, pack FROM p JOIN gatec USING (contract_id) WHERE violations = 0",
        LATEST,
        "SELECT DISTINCT contract_id, version_num FROM f",
    )
    parts["f"] = "SELECT cf.* FROM cf JOIN gatec USING (contract_id)"
    parts["g"] = """
SELECT gatec.contract_id, CAST(violations AS BIGINT) AS violation_count, base_version,
  candidate_version,
  CASE WHEN violations > 0 THEN 'LINT_FAILED' WHEN status IS NULL THEN 'SKIPPED' ELSE status END
    AS outcome,
  coalesce(breaking_changes, '') AS breaking_changes, coalesce(warnings, '') AS warnings,
  violations = 0 AND coalesce(status, 'PASS') = 'PASS' AS passed
FROM gatec LEFT JOIN res USING (contract_id)"""
    return parts


oracle("changed_gate", "gatec cf", "SELECT * FROM g", **_gate("'BACKWARD'"))
oracle("changed_gate_own_mode", "gatec cf", "SELECT * FROM g", **_gate("gatec.mode"))
oracle("changed_gate_result", "gatec cf", """
SELECT count(*) AS contracts, count(*) FILTER (WHERE NOT passed) AS failed,
  coalesce(bool_and(passed), true) AS passed FROM g""", **_gate("'BACKWARD'"))
oracle("request_validation", "rq", """
SELECT request_id, contract_id, base_version, candidate_version, mode, commit_sha, triggered_by, error
FROM rq""")
_RQ_HASH = ("sha256(rq.contract_id || '|' || base_version || '|' || candidate_version || '|' || rq.mode "
            "|| '|' || coalesce(commit_sha, '-') || '|' || triggered_by)")
oracle("queued_runs", "rq", f"""
SELECT {stable_id("request_id", _RQ_HASH)} AS run_id, contract_id, base_version, candidate_version,
  'QUEUED' AS status, '[]' AS breaking_changes, '[]' AS warnings, commit_sha, '{NOW}' AS created_at,
  triggered_by, mode AS compatibility_mode, {_RQ_HASH} AS input_hash,
  CAST(NULL AS VARCHAR) AS started_at, CAST(NULL AS VARCHAR) AS finished_at
FROM rq WHERE error IS NULL""")
_OUT = {
    "ev": """
SELECT 'cust.' || c AS contract_id, 'v' || ver AS version, CASE WHEN c % 10 = 8 AND ver = 3
  THEN 'SchemaValidationException: Invalid JSON in schema file: v3.json' END AS bad FROM v""",
    "rs": f"""
SELECT rq.*, owners.pack AS own_pack,
  {stable_id("request_id", _RQ_HASH)} AS run_id, {_RQ_HASH} AS input_hash,
  CASE WHEN owners.contract_id IS NULL
         THEN 'IllegalStateException: Contract not found: ' || rq.contract_id
       WHEN b.version IS NULL THEN 'IllegalStateException: Schema file does not exist: contracts/'
         || rq.contract_id || '/' || base_version || '.json'
       WHEN a.version IS NULL THEN 'IllegalStateException: Schema file does not exist: contracts/'
         || rq.contract_id || '/' || candidate_version || '.json'
       ELSE coalesce(b.bad, a.bad) END AS execution_error
FROM rq LEFT JOIN owners ON owners.contract_id = rq.contract_id
LEFT JOIN ev b ON b.contract_id = rq.contract_id AND b.version = base_version
LEFT JOIN ev a ON a.contract_id = rq.contract_id AND a.version = candidate_version
WHERE error IS NULL""",
    **verdicts(
        "ef",
        "SELECT DISTINCT contract_id, base_version, candidate_version, mode, own_pack AS pack "
        "FROM rs WHERE execution_error IS NULL",
        "SELECT DISTINCT contract_id, base_version, candidate_version FROM rs "
        "WHERE execution_error IS NULL",
    ),
    "out": """
SELECT run_id, request_id, rs.contract_id, rs.base_version,
  rs.candidate_version, rs.mode, commit_sha, triggered_by, input_hash,
  own_pack AS pack,
  CASE WHEN execution_error IS NOT NULL THEN 'FAIL' ELSE status END AS status,
  coalesce(breaking_changes, '') AS breaking_changes,
  CASE WHEN execution_error IS NOT NULL THEN 'Execution error: ' || execution_error
    ELSE warnings END AS warnings, execution_error, CAST(NULL AS VARCHAR) AS error
FROM rs LEFT JOIN res ON res.contract_id = rs.contract_id AND res.base_version = rs.base_version
  AND res.candidate_version = rs.candidate_version AND res.mode = rs.mode AND res.pack = rs.own_pack""",
}
oracle("request_outcomes", "ef owners rq", """
SELECT * FROM out UNION ALL
SELECT NULL, request_id, contract_id, base_version, candidate_version, mode, commit_sha,
  triggered_by, NULL, NULL, 'REJECTED', '', '', NULL, error FROM rq WHERE error IS NOT NULL""", **_OUT)
_JSON = "CASE WHEN {c} = '' THEN '[]' ELSE '[\"' || replace({c}, '; ', '\",\"') || '\"]' END AS {c}"
_FINISHED = f"""
SELECT run_id, contract_id, base_version, candidate_version, status,
  {_JSON.format(c="breaking_changes")}, {_JSON.format(c="warnings")}, commit_sha,
  {{times}} triggered_by, mode AS compatibility_mode, input_hash {{ends}} FROM out"""
oracle("finished_runs", "ef owners rq", _FINISHED.format(
    times=f"'{NOW}' AS created_at,", ends=f", '{NOW}' AS started_at, '{NOW}' AS finished_at"), **_OUT)
oracle("stream_request_runs", "ef owners rq", _FINISHED.format(times="", ends=""), **_OUT)
_CLAIM = "'INFO', 'code=check_run_claimed message=Check run claimed for execution.'"
_BAD = "'ERROR', 'code=check_run_attempt_failed attempt={n} message=' || execution_error"
_AGAIN = ("'WARN', 'code=check_run_requeued attempt={n} maxRetries=2 "
          "message=Run re-queued for retry.'")
_STEPS = [_CLAIM, _BAD.format(n=1), _AGAIN.format(n=1), _CLAIM, _BAD.format(n=2), _AGAIN.format(n=2),
          _CLAIM, _BAD.format(n=3), "'ERROR', 'code=check_run_failed message=Run failed after retries.'"]
oracle("lifecycle_logs", "ef owners rq", f"""
SELECT {stable_id("run_id", "step - 1")} AS log_id, run_id, CAST(step AS INTEGER) AS step, level,
  message, '{NOW}' AS created_at FROM (
  SELECT run_id, 1 AS step, 'INFO' AS level,
    'code=check_run_claimed message=Check run claimed for execution.' AS message
  FROM out WHERE execution_error IS NULL
  UNION ALL SELECT run_id, 2, 'INFO',
    'code=check_run_completed status=' || status || ' message=Check run completed.'
  FROM out WHERE execution_error IS NULL
  {" ".join(f"UNION ALL SELECT run_id, {i}, {step} FROM out WHERE execution_error IS NOT NULL"
            for i, step in enumerate(_STEPS, 1))})""", **_OUT)
oracle("recorded_runs", "ef", f"""
SELECT {stable_id("'batch-1'", "contract_id", "base_version", "candidate_version", "mode", "pack")}
  AS run_id, contract_id, base_version, candidate_version, status,
  {_JSON.format(c="breaking_changes")}, {_JSON.format(c="warnings")}, 'head' AS commit_sha,
  '{NOW}' AS created_at, 'cli' AS triggered_by, mode AS compatibility_mode,
  sha256(contract_id || '|' || base_version || '|' || candidate_version || '|FULL|head|cli')
    AS input_hash, '{NOW}' AS started_at, '{NOW}' AS finished_at
FROM res""", **verdicts("ef", fixed_checks("FULL", "strict"), LATEST))
oracle("recorded_run_logs", "cr", f"""
SELECT {stable_id("run_id", "'recorded'")} AS log_id, run_id, 'INFO' AS level,
  'Check run recorded by CLI with status ' || status || '.' AS message, created_at FROM cr""")
oracle("audit_rows", "rq", f"""
SELECT {stable_id("'CHECK_RUN_CREATE'", f"'{NOW}'", "request_id")} AS audit_id,
  'CHECK_RUN_CREATE' AS action, 'anonymous' AS actor, '-' AS actor_roles,
  CASE WHEN triggered_by = '' THEN '-' ELSE triggered_by END AS source,
  CAST(NULL AS VARCHAR) AS request_id, 'POST' AS http_method, '/checks' AS path,
  'check_run' AS resource_type, CASE WHEN error IS NULL THEN request_id END AS resource_id,
  CASE WHEN error IS NULL THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
  '{{"contractId":"' || contract_id || '","baseVersion":"' || base_version
  || '","candidateVersion":"' || candidate_version || '","mode":"' || mode || '","commitSha":'
  || coalesce('"' || commit_sha || '"', 'null') || ',"triggeredBy":"' || triggered_by || '"'
  || coalesce(',"error":"' || error || '"', '') || '}}' AS detail, '{NOW}' AS created_at
FROM rq""")

_REG = {
    "tops": """
SELECT c, max(ver) AS last_num, CASE WHEN max(ver) > 1 THEN max(ver) - 1 END AS m FROM v GROUP BY c""",
    "cand": """
SELECT *, CAST(substr(version, 2) AS BIGINT) AS num FROM (
  SELECT c, last_num, m, 'cust.' || c AS own_id,
    CASE c % 10 WHEN 3 THEN 'ghost.' || c WHEN 4 THEN 'Cust-' || c ELSE ' cust.' || c END AS given_id,
    CASE WHEN c % 20 = 0 THEN 'v99999999999' ELSE
      CASE c % 10 WHEN 1 THEN 'v' || (last_num + 2) WHEN 2 THEN 'v2' WHEN 5 THEN 'two'
      ELSE 'v' || last_num || ' ' END END AS given_version,
    CASE c % 10 WHEN 1 THEN 'v' || (last_num + 2) WHEN 2 THEN 'v2' WHEN 5 THEN 'v0'
      ELSE 'v' || last_num END AS version FROM tops)""",
    "seq": """
SELECT *, CASE
  WHEN c % 10 = 5 THEN 'version must match the format v{number}.'
  WHEN c % 30 = 7 THEN 'schema must be a JSON object.'
  WHEN c % 10 = 4 THEN 'contractId must use lowercase dot-separated format.'
  WHEN c % 10 = 3 THEN 'Contract not found: ghost.' || c
  WHEN c % 20 = 0 THEN 'Version number out of range: v99999999999'
  WHEN num < last_num
    THEN 'Version already exists for contract ' || own_id || ': ' || version
  WHEN m IS NULL AND version <> 'v1' THEN 'First contract version must be v1.'
  WHEN num <= m THEN 'New version must be greater than existing latest version v' || m || '.'
  WHEN num <> m + 1 THEN 'Version sequence must be incremental. Expected v' || (m + 1) || '.'
  END AS sequence_error,
  CASE WHEN c % 20 = 8
      THEN 'Invalid compatibilityMode ''SIDEWAYS''. Allowed: BACKWARD, FORWARD, FULL.'
    WHEN c % 20 = 18 THEN 'metadata.yaml must define non-empty ''compatibilityMode''.'
    WHEN c % 20 = 10 THEN 'metadata.yaml must define non-empty ''ownerTeam''.'
    WHEN c % 10 = 6 THEN 'Property ''a'' in ' || version || '.json must define ''type''.'
    WHEN c % 20 = 9 AND m IS NOT NULL THEN 'Invalid JSON in schema file: v' || m || '.json' END
    AS lint_error FROM cand""",
    "regf": """
SELECT contract_id, version, field_name, type, required, nullable, enum_values FROM ef
JOIN tops USING (c) WHERE version_num < last_num
UNION ALL SELECT contract_id, seq.version, field_name, type, required, nullable, enum_values
FROM ef JOIN seq USING (c) WHERE version_num = last_num AND sequence_error IS NULL""",
    **verdicts(
        "regf",
        "SELECT p.*, owners.mode, owners.pack FROM p JOIN owners USING (contract_id)",
        "SELECT own_id AS contract_id, 'v' || m AS base_version, version AS candidate_version "
        "FROM seq WHERE sequence_error IS NULL AND lint_error IS NULL AND m IS NOT NULL",
    ),
}
oracle("register_versions", "ef owners", """
SELECT *, reason IS NULL AS accepted FROM (
  SELECT given_id AS contract_id, given_version AS version, base_version, status AS check_status,
    coalesce(sequence_error, lint_error, CASE WHEN status = 'FAIL' THEN 'Strict mode rejected version '
      || version || '. Breaking changes: ' || breaking_changes END) AS reason
  FROM seq LEFT JOIN res ON res.contract_id = own_id AND res.candidate_version = version)""", **_REG)
oracle("register_chains", "ef owners", """
SELECT contract_id, 'v' || num AS version,
  CASE WHEN copy = 1 AND num <= stop AND num > 1 AND lint IS NULL THEN 'v' || (num - 1) END AS base_version,
  CASE WHEN copy = 1 AND num <= stop AND num > 1 AND lint IS NULL THEN status END AS check_status,
  reason IS NULL AS accepted, reason
FROM (
  SELECT *, CASE
    WHEN num > stop AND top = 0 AND stop = 1 THEN 'First contract version must be v1.'
    WHEN num > stop THEN 'Version sequence must be incremental. Expected v' || stop || '.'
    WHEN copy = 1 THEN problem
    WHEN num < stop THEN 'Version already exists for contract ' || contract_id || ': v' || num
    ELSE 'Version was sent more than once in this batch: v' || num || '.' END AS reason
  FROM sent JOIN chains USING (c), (SELECT unnest([1, 2]) AS copy)
  WHERE copy = 1 OR (c % 10 = 2 AND num = last_num))""", **verdicts("ef", OWN_CHECKS) | {
    "ends": """
SELECT c, max(ver) AS last_num, greatest(max(ver) - 4, 0) AS top FROM v GROUP BY c""",
    "sent": """
SELECT *, coalesce(lint, CASE WHEN num > 1 AND status = 'FAIL' THEN 'Strict mode rejected version v' || num
  || '. Breaking changes: ' || breaking_changes END) AS problem
FROM (
  SELECT v.c, 'cust.' || v.c AS contract_id, ver AS num, last_num, top, res.status, res.breaking_changes,
    CASE WHEN v.c % 10 = 3 AND ver = last_num - 2 THEN 'Property ''a'' in v' || ver || '.json must define ''type''.' END AS lint
  FROM v JOIN ends USING (c) LEFT JOIN res ON res.contract_id = 'cust.' || v.c AND res.candidate_version = 'v' || ver
  WHERE ver > top AND NOT (v.c % 10 = 1 AND ver = last_num - 1))""",
    "chains": """
SELECT c, least(hole, coalesce(failed, hole)) AS stop
FROM (
  SELECT c, min(m + 1) AS hole FROM (SELECT c, num AS m FROM sent UNION SELECT c, top FROM sent) ends_at
  WHERE NOT EXISTS (SELECT 1 FROM sent s WHERE s.c = ends_at.c AND s.num = m + 1) GROUP BY c)
LEFT JOIN (SELECT c, min(num) AS failed FROM sent WHERE problem IS NOT NULL GROUP BY c) USING (c)""",
})
oracle("register_contracts", "owners", """
SELECT *, reason IS NULL AS accepted FROM (
  SELECT CASE WHEN c % 20 = 1 THEN '  ' WHEN c % 20 = 2 THEN 'New.' || c
      WHEN c % 4 = 0 THEN contract_id ELSE ' new.' || c END AS contract_id,
    CASE WHEN c % 20 = 9 THEN 'x1' WHEN c % 3 = 0 THEN 'v4' ELSE 'v1' END AS initial_version,
    CASE WHEN c % 20 = 6 THEN 'SIDEWAYS' WHEN c % 20 <> 7 THEN mode END AS compatibility_mode,
    trim(asked_pack) AS policy_pack,
    CASE c % 20 WHEN 1 THEN 'contractId must not be blank.'
      WHEN 2 THEN 'contractId must use lowercase dot-separated format.'
      WHEN 3 THEN 'ownerTeam must not be blank.' WHEN 5 THEN 'domain must not be blank.'
      WHEN 6 THEN 'compatibilityMode must be one of BACKWARD, FORWARD, FULL.'
      WHEN 7 THEN 'compatibilityMode must not be blank.'
      WHEN 9 THEN 'initialVersion must match the format v{number}.'
      WHEN 10 THEN 'schema must be a JSON object.'
      ELSE CASE WHEN c % 4 = 0 THEN 'Contract already exists: ' || contract_id
        WHEN c % 20 = 11 THEN 'Property ''a'' in ' || CASE WHEN c % 3 = 0 THEN 'v4' ELSE 'v1' END
          || '.json must define a valid ''type''.' END END AS reason
  FROM owners)""")
cte("rf", "", """
SELECT coalesce(n.contract_id, s.contract_id) AS contract_id, n.modified_at,
  CASE WHEN n.contract_id IS NULL THEN 'removed' WHEN s.contract_id IS NULL THEN 'added'
    WHEN n.modified_at <> s.modified_at THEN 'changed' ELSE 'unchanged' END AS state
FROM (SELECT 'cust.' || o_custkey AS contract_id, max(o_orderdate) AS modified_at
      FROM orders GROUP BY o_custkey) n
FULL JOIN (SELECT CASE WHEN o_custkey % 11 = 0 THEN 'gone.' || o_custkey ELSE 'cust.' || o_custkey END
    AS contract_id,
    max(o_orderdate) - CASE WHEN o_custkey % 5 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
    AS modified_at FROM orders WHERE o_custkey % 7 <> 0 GROUP BY o_custkey) s
ON n.contract_id = s.contract_id""")
oracle("refresh_status", "rf", """
SELECT contract_id, strftime(modified_at, '%Y-%m-%d %H:%M:%S') AS modified_at, state FROM rf""")
oracle("incremental_refresh", "cat rf", """
SELECT cat.* REPLACE (CASE WHEN state = 'unchanged' THEN 'stored' ELSE owner_team END AS owner_team),
  state <> 'unchanged' AS recomputed
FROM cat JOIN rf USING (contract_id) WHERE state <> 'removed'""")

# --- payloads ----------------------------------------------------------------------------------

cte("pay", "", """
SELECT CASE WHEN i % 101 = 0 THEN 'events.ghost' ELSE 'events.' || event_type END AS contract_id,
  CASE WHEN i % 3 = 0 THEN 'v1.json' ELSE 'v1' END AS version, CAST(i AS VARCHAR) AS payload_id,
  CASE WHEN i % 97 = 0 THEN ['payload_null'] WHEN i % 101 = 0 THEN ['contract_unknown']
    WHEN i % 89 = 0 THEN ['payload_malformed']
    ELSE list_sort(list_filter([
      CASE WHEN i % 11 = 0 THEN 'required:eventId' WHEN i % 13 = 0 THEN 'type:eventId'
        WHEN i % 23 = 0 THEN NULL WHEN i % 29 = 0 THEN 'type:eventId' END,
      CASE WHEN i % 17 = 0 THEN 'enum:type' END,
      CASE WHEN i % 19 = 0 AND event_type <> 'view' THEN 'type:value' END,
      CASE WHEN event_type = 'signup' THEN 'unsupported_keyword:value.pattern' END],
      lambda x: x IS NOT NULL)) END AS violations
FROM (SELECT *, event_id AS i FROM events)""")
_CHECKED = """
SELECT contract_id, version, payload_id, len(violations) = 0 AS valid,
  array_to_string(violations, ',') AS violations FROM pay"""
oracle("payload_conformance", "pay", _CHECKED)
oracle("stream_payload_conformance", "pay", _CHECKED)
oracle("payload_keywords", "", """
SELECT payload_id, len(violations) = 0 AS valid, array_to_string(violations, ',') AS violations
FROM (SELECT CAST(i AS VARCHAR) AS payload_id, list_sort(list_distinct(list_filter([
    CASE WHEN i % 7 <> 0 AND i < 10 THEN 'minimum:n' END,
    CASE WHEN i % 7 <> 0 AND i >= 5000 THEN 'exclusiveMaximum:n' END,
    CASE WHEN i % 7 <> 0 AND i % 3 <> 0 THEN 'multipleOf:n' END,
    CASE WHEN value <= 20 THEN 'exclusiveMinimum:v' END,
    CASE WHEN value > 150.5 THEN 'maximum:v' END,
    CASE WHEN length(event_type) < 5 THEN 'minLength:s' END,
    CASE WHEN length(event_type) > 6 THEN 'maxLength:s' END,
    CASE WHEN len(a) < 2 THEN 'minItems:a' END, CASE WHEN len(a) > 3 THEN 'maxItems:a' END,
    CASE WHEN len(list_distinct(a)) < len(a) THEN 'uniqueItems:a' END,
    CASE WHEN i % 6 = 0 THEN 'items:a' END, CASE WHEN i % 2 = 0 THEN 'const:c' END,
    CASE WHEN i % 13 = 0 THEN 'minProperties:o' WHEN i % 17 = 0 THEN 'maxProperties:o' END,
    CASE WHEN i % 19 = 0 THEN 'additionalProperties:x' END,
    CASE WHEN i % 19 = 0 AND i % 7 <> 0 THEN 'maxProperties' END,
    CASE WHEN i % 7 = 0 THEN 'dependentRequired:n' END], lambda x: x IS NOT NULL))) AS violations
  FROM (SELECT event_id AS i, event_type, value, list_filter([CAST(event_id % 3 AS VARCHAR),
      CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 4 AS VARCHAR) END,
      CASE WHEN event_id % 6 = 0 THEN 'q' END, CASE WHEN event_id % 11 = 0 THEN '7' END,
      CASE WHEN event_id % 11 = 0 THEN '8' END], lambda x: x IS NOT NULL) AS a FROM events))""")
_NESTED = """
SELECT CAST(i AS VARCHAR) AS payload_id, len(violations) = 0 AS valid, array_to_string(violations, ',') AS violations
FROM (SELECT i, list_sort(list_filter([
    CASE WHEN i % 7 = 0 THEN 'type:#/id' END,
    CASE WHEN NOT there THEN 'required:#/event' END,
    CASE WHEN there AND kind = 'zzz' THEN 'enum:#/event/kind' END,
    CASE WHEN there AND i % 13 = 0 THEN 'additionalProperties:#/event/e' END,
    CASE WHEN there AND k > 90 THEN 'maximum:#/event/props/k' END,
    CASE WHEN i % 5 = 1 OR (i % 5 > 1 AND value < 50) THEN 'anyOf:#/amount' END,
    CASE WHEN coded AND i % 4 = 0 THEN 'contains:#/codes' END,
    CASE WHEN coded AND i % 19 = 0 THEN 'pattern:#/codes/2' END,
    CASE WHEN i % 29 = 0 THEN 'type:#/pair/0' END,
    CASE WHEN i % 23 = 0 THEN 'items:#/pair/2' END,
    CASE WHEN err AND NOT coded THEN 'required:#/codes' END,
    CASE WHEN NOT err AND i % 31 = 0 THEN 'not:#' END,
    CASE WHEN (i % 2 = 0) = (i % 3 = 0) THEN 'oneOf:#' END], lambda x: x IS NOT NULL)) AS violations
  FROM (SELECT *, NOT there OR kind = 'error' AS err FROM (
    SELECT event_id AS i, value, event_id % 17 <> 0 AS there, event_id % 3 <> 0 AS coded,
      CASE WHEN event_id % 11 = 0 THEN 'zzz' ELSE event_type END AS kind, CAST(props ->> '$.k' AS INTEGER) AS k
    FROM events)))"""
oracle("payload_nested", "", _NESTED)
oracle("stream_payload_nested", "", _NESTED)
oracle("payload_violations", "pay", """
SELECT contract_id, version, split_part(x, ':', 1) AS code,
  CASE WHEN contains(x, ':') THEN substr(x, instr(x, ':') + 1) END AS subject, count(*) AS payloads
FROM (SELECT *, unnest(violations) AS x FROM pay) GROUP BY ALL""")
