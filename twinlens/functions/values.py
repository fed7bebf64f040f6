"""Tools, severities, kinds, extensions, the built-in rules. Order is the order of sorting."""

from __future__ import annotations

TOOLS = ("eslint", "biome", "oxlint", "prettier", "oxfmt")
LINTERS = ("eslint", "biome", "oxlint")
FORMATTERS = ("biome", "prettier", "oxfmt")
TOOL_NAMES = {"eslint": "ESLint", "biome": "Biome", "oxlint": "Oxlint", "prettier": "Prettier", "oxfmt": "Oxfmt"}
#: As spelled inside fingerprints.
TOOL_DEBUG = {"eslint": "Eslint", "biome": "Biome", "oxlint": "Oxlint", "prettier": "Prettier", "oxfmt": "Oxfmt"}
SEVERITIES = ("unknown", "info", "warning", "error")
CONFIDENCES = ("exact", "approximate")
MATCH_KINDS = ("exact_match", "approximate_rule_match", "probable_match", "severity_changed", "range_changed", "message_changed")
MATCH_LABELS = {k: k.replace("_", " ") for k in MATCH_KINDS}
PLAN_STATUSES = ("supported", "unsupported", "unknown", "skipped")
FORMAT_STATUSES = ("identical", "different", "baseline_non_idempotent", "candidate_non_idempotent", "both_non_idempotent", "unsupported", "skipped", "failed")
POLICIES = ("ignore", "difference", "error")
PROFILES = ("raw", "comparable")
#: The built-in rules, and spellings of them.
RULES = ("no-debugger", "no-console", "no-undef", "eqeqeq", "no-unused-vars", "no-unreachable", "use-isnan", "constructor-super", "getter-return", "no-dupe-keys")
SPELLINGS = {
    "no-unused-variables": "no-unused-vars",
    "no-unused-variable": "no-unused-vars",
    "no-unreachable-code": "no-unreachable",
    "use-is-nan": "use-isnan",
    "use-constructor-super": "constructor-super",
    "use-getter-return": "getter-return",
    "no-duplicate-keys": "no-dupe-keys",
    "no-duplicate-object-keys": "no-dupe-keys",
}
SCRIPT_EXTENSIONS = ("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts")
DATA_EXTENSIONS = ("json", "jsonc")
IGNORED_DIRECTORIES = (".git", "node_modules", "target", "dist", "build", "coverage", ".twinlens", ".svn")
#: Stands for a missing line or column in orders and distances.
NO_POSITION = 4294967295
OUTPUT_LIMIT = 4096
SCHEMA_VERSION = 2
