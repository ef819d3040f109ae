"""Table layouts and the fixed vocabulary shared by every operator."""

from __future__ import annotations

# Canonical tables, as DDL strings.
CONTRACTS = (
    "contract_id string, owner_team string, domain string, compatibility_mode string, "
    "policy_pack string, consumers array<string>, status string"
)
SCHEMA_DOCS = (
    "contract_id string, version string, version_num int, schema_json string, modified_at timestamp"
)
SCHEMA_FIELDS = (
    "contract_id string, version string, version_num int, field_name string, type string, "
    "required boolean, nullable boolean, enum_values array<string>"
)
CHECK_RUNS = (
    "run_id string, contract_id string, base_version string, candidate_version string, "
    "status string, breaking_changes string, warnings string, commit_sha string, "
    "created_at string, triggered_by string, compatibility_mode string, input_hash string, "
    "started_at string, finished_at string"
)
CHECK_RUN_LOGS = "log_id string, run_id string, level string, message string, created_at string"
AUDIT_LOGS = (
    "audit_id string, action string, actor string, actor_roles string, source string, "
    "request_id string, http_method string, path string, resource_type string, "
    "resource_id string, status string, detail string, created_at string"
)
CHECK_REQUESTS = (
    "request_id string, contract_id string, base_version string, candidate_version string, "
    "mode string, commit_sha string, triggered_by string"
)
PAYLOADS = "contract_id string, version string, payload_id string, payload string"

# Runs and logs are stored in folders by a hash of the run id, so a look-up by id reads one of them.
RUN_SLOTS = 64

PAIR = ["contract_id", "base_version", "candidate_version"]

# Compatibility modes, run statuses.
MODES = ("BACKWARD", "FORWARD", "FULL")
DEFAULT_MODE = "BACKWARD"
ACTIVE = "ACTIVE"

# Rule id, message label and baseline severity, in evaluation order.
RULES = (
    ("FIELD_REMOVED", "Field removed: ", "BREAKING"),
    ("FIELD_TYPE_CHANGED", "Field type changed: ", "BREAKING"),
    ("REQUIRED_FIELD_ADDED", "Required field added: ", "BREAKING"),
    ("ENUM_VALUE_REMOVED", "Enum value removed: ", "BREAKING"),
    ("ENUM_VALUE_ADDED", "Enum value added: ", "WARNING"),
)
SEVERITIES = ("BREAKING", "WARNING", "IGNORE")
BASELINE = "baseline"
FORWARD_PREFIX = "[FORWARD] "

# Change kind and its line prefix in the diff report, in section order.
DIFF_SECTIONS = (
    ("FIELD_ADDED", "+ field added: "),
    ("FIELD_REMOVED", "- field removed: "),
    ("FIELD_TYPE_CHANGED", "~ type changed: "),
    ("REQUIRED_FIELD_ADDED", "! required added: "),
    ("REQUIRED_FIELD_REMOVED", "! required removed: "),
    ("ENUM_VALUE_ADDED", "~ enum value added: "),
    ("ENUM_VALUE_REMOVED", "~ enum value removed: "),
)
# A change seen from the candidate's side.
MIRRORED_KIND = {
    "FIELD_ADDED": "FIELD_REMOVED",
    "FIELD_REMOVED": "FIELD_ADDED",
    "FIELD_TYPE_CHANGED": "FIELD_TYPE_CHANGED",
    "REQUIRED_FIELD_ADDED": "REQUIRED_FIELD_REMOVED",
    "REQUIRED_FIELD_REMOVED": "REQUIRED_FIELD_ADDED",
    "ENUM_VALUE_ADDED": "ENUM_VALUE_REMOVED",
    "ENUM_VALUE_REMOVED": "ENUM_VALUE_ADDED",
}

# Fixed patterns. `\z` instead of `$`: Spark's rlike searches, and `$` would let a newline through.
REGISTRY_CONTRACT_ID = r"^[a-z0-9]+(\.[a-z0-9]+)*\z"
REQUEST_CONTRACT_ID = r"^[a-zA-Z0-9._-]+\z"
VERSION_NAME = r"^v[1-9][0-9]*\z"
VERSION_FILE = r"^v[1-9][0-9]*\.json\z"

# Strict JSON, as a standard parser reads it.
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
