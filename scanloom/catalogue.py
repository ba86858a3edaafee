"""Declared tables: columns, keys, references, closed value sets.

Fixed values: names, lengths, defaults and delete rules are those of the stored data.
"""

from __future__ import annotations

from dataclasses import dataclass

from scanloom import constants as K

NOW = "now()"


@dataclass(frozen=True)
class Col:
    name: str
    kind: str
    required: bool = False
    size: int | None = None
    default: object = None
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Ref:
    column: str
    parent: str
    parent_column: str = "id"
    on_delete: str = "no action"


@dataclass(frozen=True)
class Table:
    columns: tuple[Col, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    refs: tuple[Ref, ...] = ()
    key: str = "id"

    @property
    def keys(self) -> tuple[tuple[str, ...], ...]:
        return ((self.key,), *self.unique)


def _id() -> Col:
    return Col("id", "int", True)


def _int(name: str, required: bool = False, default: object = None) -> Col:
    return Col(name, "int", required, default=default)


def _str(name: str, size: int | None, required: bool = False, default: object = None, values=()) -> Col:
    return Col(name, "string", required, size, default, tuple(values))


def _text(name: str, required: bool = False, default: object = None, values=()) -> Col:
    return _str(name, None, required, default, values)


def _bool(name: str, default: bool) -> Col:
    return Col(name, "boolean", True, default=default)


def _time(name: str, required: bool = False, default: object = None) -> Col:
    return Col(name, "timestamp_ntz", required, default=default)


_CREATED = _time("created_at", True, NOW)
_UPDATED = _time("updated_at", True, NOW)

TABLES: dict[str, Table] = {
    "users": Table(
        (
            _id(), _str("name", 100), _str("email", 255, True), _text("password_hash", True),
            _str("role", 20, True, "member"), _bool("use_fast_model", False), _CREATED, _UPDATED, _time("deleted_at"),
        ),
        unique=(("email",),),
    ),
    "teams": Table(
        (
            _id(), _str("name", 100, True), _CREATED, _UPDATED, _text("stripe_customer_id"),
            _text("stripe_subscription_id"), _text("stripe_product_id"), _str("plan_name", 50),
            _str("subscription_status", 20),
        ),
        unique=(("stripe_customer_id",), ("stripe_subscription_id",)),
    ),
    "team_members": Table(
        (_id(), _int("user_id", True), _int("team_id", True), _str("role", 50, True), _time("joined_at", True, NOW)),
        unique=(("user_id",),),
        refs=(Ref("user_id", "users"), Ref("team_id", "teams")),
    ),
    "activity_logs": Table(
        (
            _id(), _int("team_id", True), _int("user_id"), _text("action", True), _time("timestamp", True, NOW),
            _str("ip_address", 45),
        ),
        refs=(Ref("team_id", "teams"), Ref("user_id", "users")),
    ),
    "ai_usage_events": Table(
        (
            _id(), _int("user_id", True), _int("team_id"), _str("plan_name", 50), _str("model_id", 255),
            _int("input_tokens", True), _int("output_tokens", True), _int("total_tokens", True), _CREATED,
        ),
        refs=(Ref("user_id", "users", on_delete="cascade"), Ref("team_id", "teams", on_delete="set null")),
    ),
    "invitations": Table(
        (
            _id(), _int("team_id", True), _str("email", 255, True), _str("role", 50, True), _int("invited_by", True),
            _time("invited_at", True, NOW), _str("status", 20, True, "pending"),
        ),
        refs=(Ref("team_id", "teams"), Ref("invited_by", "users")),
    ),
    "github_tokens": Table(
        (_id(), _int("user_id", True), _text("access_token", True), _CREATED, _UPDATED), unique=(("user_id",),)
    ),
    "github_app_installations": Table(
        (
            _id(), _int("user_id", True), _text("installation_id", True), _text("account_id", True),
            _text("account_login", True), _str("account_type", 20, True), _text("account_avatar_url"),
            _text("access_token"), _time("token_expires_at"), _text("permissions"), _CREATED, _UPDATED,
        ),
        unique=(("installation_id",),),
        refs=(Ref("user_id", "users", on_delete="cascade"),),
    ),
    "github_repos": Table(
        (
            _id(), _text("github_id", True), _text("name", True), _text("full_name", True), _int("user_id", True),
            _int("team_id"), _int("installation_id"), _CREATED, _UPDATED,
        ),
        unique=(("user_id", "github_id"), ("team_id", "github_id")),
        refs=(Ref("user_id", "users"), Ref("team_id", "teams"), Ref("installation_id", "github_app_installations")),
    ),
    "code_reviews": Table(
        (
            _id(), _int("repo_id", True), _text("file_path", True), _str("branch", 255), _str("commit_sha", 40),
            _text("function_name", True), _int("line_start", True), _int("line_end", True), _str("content_hash", 64),
            _text("status", True, "unmarked", K.REVIEW_STATUSES), _text("reason"), _time("parsed_at", default=NOW),
            _CREATED, _UPDATED,
        ),
        unique=(("repo_id", "file_path", "branch", "line_start", "line_end"),),
        refs=(Ref("repo_id", "github_repos", on_delete="cascade"),),
    ),
    "code_review_comments": Table(
        (
            _id(), _int("repo_id", True), _text("file_path", True), _str("branch", 255), _int("start_line", True),
            _int("end_line", True), _text("comment", True), _int("user_id", True), _CREATED, _bool("resolved", False),
            _time("resolved_at"), _int("resolved_by"),
        ),
        refs=(
            Ref("repo_id", "github_repos", on_delete="cascade"), Ref("user_id", "users", on_delete="cascade"),
            Ref("resolved_by", "users", on_delete="set null"),
        ),
    ),
    "code_review_status_events": Table(
        (
            _id(), _int("repo_id", True), _text("file_path", True), _text("function_name", True),
            _int("line_start", True), _int("line_end", True), _text("previous_status"), _text("new_status", True),
            _int("user_id"), _CREATED,
        ),
        refs=(
            Ref("repo_id", "github_repos", on_delete="cascade"), Ref("user_id", "users", on_delete="set null"),
        ),
    ),
    "security_scans": Table(
        (
            _id(), _str("scan_id", 100, True), _int("repo_id", True), _str("branch", 255, True), _int("user_id"),
            _int("team_id"), _str("status", 20, True, "running", K.SCAN_STATUSES),
            Col("tools_used", "array<string>"), _int("scan_duration"), _int("total_issues", default=0),
            _int("critical_count", default=0), _int("high_count", default=0), _int("medium_count", default=0),
            _int("low_count", default=0), _int("info_count", default=0), _CREATED, _time("completed_at"),
        ),
        unique=(("scan_id",),),
        refs=(
            Ref("repo_id", "github_repos", on_delete="cascade"), Ref("user_id", "users", on_delete="set null"),
            Ref("team_id", "teams", on_delete="cascade"),
        ),
    ),
    "security_issues": Table(
        (
            _id(), _str("scan_id", 100, True), _str("tool", 20, True, values=K.ISSUE_TOOLS),
            _str("severity", 20, True, values=K.SEVERITIES), _text("title", True), _text("description", True),
            _text("file_path", True), _int("line_start", True), _int("line_end"), _text("code"),
            _text("recommendation"), Col("cwe", "array<string>"), Col("owasp", "array<string>"),
            _str("status", 20, False, "open", K.ISSUE_STATUSES), _time("resolved_at"), _int("resolved_by"), _CREATED,
        ),
        refs=(
            Ref("scan_id", "security_scans", "scan_id", "cascade"),
            Ref("resolved_by", "users", on_delete="set null"),
        ),
    ),
    "scan_quotas": Table(
        (
            _id(), _int("team_id", True), _int("scans_used", True, 0), _time("reset_date", True), _CREATED, _UPDATED,
        ),
        unique=(("team_id",),),
        refs=(Ref("team_id", "teams", on_delete="cascade"),),
    ),
    "api_keys": Table(
        (
            _id(), _int("repo_id", True), _str("name", 100, True), _str("key", 64, True), _time("last_used_at"),
            _CREATED, _time("expires_at"),
        ),
        unique=(("key",),),
        refs=(Ref("repo_id", "github_repos", on_delete="cascade"),),
    ),
    "quality_gates": Table(
        (
            _id(), _int("repo_id", True), _bool("enabled", False), _bool("require_all_clean", False),
            _int("max_critical_issues", default=0), _int("max_high_issues", default=5),
            _int("min_clean_percentage", default=80), _bool("block_on_unresolved_comments", False), _CREATED, _UPDATED,
        ),
        unique=(("repo_id",),),
        refs=(Ref("repo_id", "github_repos", on_delete="cascade"),),
    ),
    "webhook_events": Table(
        (
            _id(), _int("repo_id", True), _str("source", 50, True), _str("event_type", 50, True), _str("branch", 255),
            _str("commit_sha", 40), _text("payload"), _str("status", 20, True, values=K.WEBHOOK_STATUSES), _CREATED,
        ),
        refs=(Ref("repo_id", "github_repos", on_delete="cascade"),),
    ),
    "scan_jobs": Table(
        (
            _id(), _int("repo_id", True), _str("branch", 255, True),
            _str("status", 20, True, "queued", K.JOB_STATUSES), _text("progress"), _time("started_at"),
            _time("completed_at"), _text("error"), _CREATED,
        ),
        refs=(Ref("repo_id", "github_repos", on_delete="cascade"),),
    ),
}
