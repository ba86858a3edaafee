"""String, JSON and date expressions with the source system's JavaScript semantics.

Everything here is a Column expression of built-in functions, so it stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.constants import TOKEN_MARGIN_MINUTES, WHITE_SPACE


def js_trim(c: Column) -> Column:
    """trim() over all JavaScript white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def js_trim_start(c: Column) -> Column:
    """trimStart(): looks at the white space in front only, where a trim of both ends walks through the whole text."""
    return F.ltrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return js_trim_start(c) == ""


def template(*parts: Column | str) -> Column:
    """Template string: a missing value prints as ``undefined`` instead of nulling the text."""
    return F.concat(
        *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("undefined")) for p in parts]
    )


def falsy_or(a: Column, b: Column) -> Column:
    """``a || b`` for strings: an empty string counts as missing."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def is_present(c: Column) -> Column:
    """Truthiness of an optional string: never null."""
    return F.coalesce(c != "", F.lit(False))


def string_list(raw: Column) -> Column:
    """JSON text to array<string>; anything that is not an array becomes an empty one."""
    items = F.from_json(F.when(raw.startswith("["), raw), "array<string>")
    return F.coalesce(items, F.array().cast("array<string>"))


def mask_secret(secret: Column) -> Column:
    """Keep four characters at each end of secrets longer than eight UTF-16 units.

    The two ends are cut by code point, so an emoji there is kept whole rather than halved.
    """
    units = F.length(secret) + F.regexp_count(secret, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.when(units <= 8, F.lit("***")).when(
        units > 8, F.concat(F.left(secret, F.lit(4)), F.lit("***"), F.right(secret, F.lit(4)))
    )


def _cut_first(text: Column, part: Column) -> Column:
    # The whole text when the part is absent.
    before = F.call_function("substring_index", text, part, F.lit(1))
    return F.concat(before, F.substr(text, F.length(before) + F.length(part) + 1))


def strip_root(path: Column, root: Column) -> Column:
    """Drop the first ``root/`` anywhere in the path, then the first ``root`` still there."""
    return _cut_first(_cut_first(path, F.concat(root, F.lit("/"))), root)


def strip_archive_root(path: Column) -> Column:
    """Archive members carry one wrapper folder; paths start below it."""
    return F.regexp_replace(path, r"^[^/]+/", "")


_REPO_URL = r"github\.com[/:]([^/]+)/([^/.]+)"


def repo_owner(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, _REPO_URL, 1), F.lit(""))


def repo_name(url: Column) -> Column:
    """Repository name up to its first dot; null when the URL does not match."""
    return F.nullif(F.regexp_extract(url, _REPO_URL, 2), F.lit(""))


def archive_url(owner: Column, repo: Column, branch: Column, token: Column) -> Column:
    """API archive for authenticated downloads, the public branch archive otherwise."""
    api = F.concat(F.lit("https://api.github.com/repos/"), owner, F.lit("/"), repo, F.lit("/zipball/"), branch)
    public = F.concat(
        F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit("/archive/refs/heads/"), branch, F.lit(".zip")
    )
    return F.when(is_present(token), api).otherwise(public)


def parse_int(c: Column) -> Column:
    """parseInt(x, 10): leading digits count, anything else is null."""
    digits = F.regexp_extract(F.ltrim(js_trim(c)), r"^([+-]?[0-9]+)", 1)
    return digits.try_cast("bigint")


UNIT_MICROS = {"ms": 1_000, "second": 1_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from start to end.

    By way of an interval, which is exact for timestamps without zone; timestampdiff would read them
    in the session's zone and be an hour off around a clock change.
    """
    span = end - start
    hours = F.extract(F.lit("DAY"), span).cast("bigint") * 24 + F.extract(F.lit("HOUR"), span)
    minutes = hours * 60 + F.extract(F.lit("MINUTE"), span)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), span) * 1_000_000).cast("bigint")


def elapsed(unit: str, start: Column, end: Column) -> Column:
    """Whole units from start to end, cut off towards zero."""
    micros, size = micros_between(start, end), UNIT_MICROS[unit]
    return ((micros - micros % size) / size).cast("bigint")


def epoch_micros(ts: Column) -> Column:
    return micros_between(F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts)


def duration_ms(start: Column, end: Column) -> Column:
    return elapsed("ms", start, end)


def minutes_until(expires: Column, now: Column) -> Column:
    """Whole minutes to expiry, halves rounded up."""
    return F.floor(elapsed("ms", now, expires) / F.lit(60000) + F.lit(0.5))


def token_valid(token: Column, expires: Column, now: Column) -> Column:
    """Cached token usable: non-empty and strictly more than the margin away from expiry."""
    margin = F.make_dt_interval(mins=F.lit(TOKEN_MARGIN_MINUTES))
    return F.coalesce(is_present(token) & (expires > now + margin), F.lit(False))


def utf8_text(content: Column) -> Column:
    """Binary to text; invalid byte sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))
