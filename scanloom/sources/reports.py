"""Report sources: raw scanner output to validated finding arrays.

A report row is parsed once. Its findings stay an array until the whole report has been judged,
because one unusable finding voids the report; judging the array needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.functions.text import is_blank, js_trim_start
from scanloom.session import fresh_path

JSON_OPTIONS = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "columnNameOfCorruptRecord": "_corrupt_record",
}


@dataclass(frozen=True)
class MustBeText:
    """The field that voids a report if it is a number, a truth value or an object; the parser alone would take its text.

    ``document`` is the report's type with nothing but this field, as a variant; ``values`` takes it to an array beside that of
    the findings; ``text`` takes it from a finding as the parser read it, ``cleared`` gives a finding without it. Only a report
    in which that text could stand for another value is parsed a second time.
    """

    document: str
    values: Callable[[Column], Column]
    text: Callable[[Column], Column]
    cleared: Callable[[Column], Column]

    def suspect(self, found: Column) -> Column:
        return _any(found, lambda f: self.text(f).rlike(r"^(-?[0-9][0-9.eE+-]*$|true$|false$|\{)"))

    def checked(self, found: Column, text: Column) -> Column:
        """The findings, with the field null where it is no text; ``text`` is null for reports beyond suspicion."""
        kind = F.schema_of_variant
        odd = lambda v: F.coalesce(~kind(v).isin("STRING", "VOID") & ~F.startswith(kind(v), F.lit("ARRAY")), F.lit(False))
        values = self.values(parse_document(text, self.document)["r"])
        return F.zip_with(found, values, lambda f, v: F.when(odd(v), self.cleared(f)).otherwise(f))


@dataclass(frozen=True)
class Dialect:
    """How one scanner's JSON is read.

    ``document`` and ``finding`` are the types of a whole report and of one finding, ``findings`` takes
    the parsed document to an array of findings, ``unusable`` tests one finding,
    ``broken`` tests the document around them. ``lenient`` re-reads a document whose types did not
    match, for the dialects that skip odd parts instead of failing.
    """

    document: str
    finding: str
    findings: Callable[[Column], Column]
    unusable: Callable[[Column], Column]
    broken: Callable[[Column], Column] = lambda doc: F.lit(False)
    body: Callable[[Column], Column] = lambda text: text
    lenient: Callable[[Column], Column] | None = None
    blank_is_error: bool = False
    exit_code_counts: bool = True
    object_root: bool = True
    bad_json_is_error: bool = True
    must_be_text: MustBeText | None = None


def parse_document(text: Column, document: str) -> Column:
    """Parse any JSON value below one key, so that bad text is told apart from an empty document."""
    return F.from_json(
        F.concat(F.lit('{"r":'), text, F.lit("}")), f"r {document}, _corrupt_record STRING", JSON_OPTIONS
    )


def _any(array: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(array, test), F.lit(False))


# --- rule scanners (two tools share this dialect) -------------------------------------------

RULES = Dialect(
    document=schemas.RULE_REPORT,
    finding=schemas.RULE_FINDING,
    findings=lambda doc: doc["results"],
    unusable=lambda f: f.isNull()
    | f["extra"]["severity"].isNull()
    | f["start"].isNull()
    | f["end"].isNull(),
    blank_is_error=True,
    must_be_text=MustBeText(
        "STRUCT<results: ARRAY<STRUCT<extra: STRUCT<severity: VARIANT>>>>",
        lambda doc: F.transform(doc["results"], lambda f: f["extra"]["severity"]),
        lambda f: f["extra"]["severity"],
        lambda f: f.withField("extra.severity", F.lit(None).cast("string")),
    ),
)

# --- secrets ---------------------------------------------------------------------------------

SECRETS = Dialect(
    document=schemas.SECRET_REPORT,
    finding=schemas.SECRET_FINDING,
    findings=lambda doc: doc,
    unusable=lambda f: f.isNull() | f["Secret"].isNull(),
    must_be_text=MustBeText(
        "ARRAY<STRUCT<Secret: VARIANT>>",
        lambda doc: F.transform(doc, lambda f: f["Secret"]),
        lambda f: f["Secret"],
        lambda f: f.withField("Secret", F.lit(None).cast("string")),
    ),
    exit_code_counts=False,
    object_root=False,
)

# --- configuration policies ------------------------------------------------------------------


def _policy_lenient(text: Column) -> Column:
    """Element by element: whatever has no list of failed checks is skipped."""
    elements = parse_document(text, "ARRAY<STRING>")["r"]

    def failed(element: Column) -> Column:
        results = F.from_json(element, "results STRING")["results"]
        checks = F.from_json(results, "failed_checks STRING")["failed_checks"]
        as_list = F.when(F.ltrim(checks).startswith("["), checks)
        return F.from_json(as_list, f"ARRAY<{schemas.POLICY_FINDING}>", JSON_OPTIONS)

    return F.flatten(
        F.transform(elements, lambda e: F.coalesce(failed(e), F.array().cast(f"ARRAY<{schemas.POLICY_FINDING}>")))
    )


def _as_list(text: Column) -> Column:
    """A lone object reads like a list of one."""
    return F.when(js_trim_start(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))


POLICIES = Dialect(
    document=schemas.POLICY_REPORT,
    finding=schemas.POLICY_FINDING,
    findings=lambda doc: F.flatten(
        F.transform(
            doc,
            lambda part: F.coalesce(
                part["results"]["failed_checks"], F.array().cast(f"ARRAY<{schemas.POLICY_FINDING}>")
            ),
        )
    ),
    unusable=lambda f: f.isNull() | f["check_class"].isNull() | f["file_line_range"].isNull(),
    broken=lambda doc: _any(doc, lambda part: part.isNull()),
    body=_as_list,
    must_be_text=MustBeText(
        "ARRAY<STRUCT<results: STRUCT<failed_checks: ARRAY<STRUCT<check_class: VARIANT>>>>>",
        lambda doc: F.flatten(
            F.transform(
                doc,
                lambda part: F.coalesce(
                    F.transform(part["results"]["failed_checks"], lambda f: f["check_class"]), F.array().cast("ARRAY<VARIANT>")
                ),
            )
        ),
        lambda f: f["check_class"],
        lambda f: f.withField("check_class", F.lit(None).cast("string")),
    ),
    lenient=_policy_lenient,
    exit_code_counts=False,
    object_root=False,
)

# --- package advisories ----------------------------------------------------------------------

_PACKAGE = f"STRUCT<Target: STRING, vuln: {schemas.PACKAGE_FINDING}>"
_PACKAGE_ROW = f"ARRAY<{_PACKAGE}>"


def _with_target(results: Column) -> Column:
    """Each vulnerability keeps the target of the result it was listed under."""
    return F.flatten(
        F.transform(
            results,
            lambda r: F.coalesce(
                F.transform(r["Vulnerabilities"], lambda v: F.struct(r["Target"].alias("Target"), v.alias("vuln"))),
                F.array().cast(_PACKAGE_ROW),
            ),
        )
    )


def _package_lenient(text: Column) -> Column:
    """Results or vulnerabilities that are not lists count as absent."""
    results = parse_document(text, "STRUCT<Results: STRING>")["r"]["Results"]
    as_list = F.when(F.ltrim(results).startswith("["), results)
    rows = F.from_json(as_list, "ARRAY<STRUCT<Target: STRING, Vulnerabilities: STRING>>", JSON_OPTIONS)
    return _with_target(
        F.transform(
            rows,
            lambda r: F.struct(
                r["Target"].alias("Target"),
                F.from_json(
                    F.when(F.ltrim(r["Vulnerabilities"]).startswith("["), r["Vulnerabilities"]),
                    f"ARRAY<{schemas.PACKAGE_FINDING}>",
                    JSON_OPTIONS,
                ).alias("Vulnerabilities"),
            ),
        )
    )


PACKAGES = Dialect(
    document=schemas.PACKAGE_REPORT,
    finding=_PACKAGE,
    findings=lambda doc: _with_target(doc["Results"]),
    unusable=lambda f: f["vuln"].isNull() | f["vuln"]["Severity"].isNull(),
    broken=lambda doc: _any(doc["Results"], lambda r: r.isNull()),
    lenient=_package_lenient,
    bad_json_is_error=False,
    must_be_text=MustBeText(
        "STRUCT<Results: ARRAY<STRUCT<Vulnerabilities: ARRAY<STRUCT<Severity: VARIANT>>>>>",
        lambda doc: F.flatten(
            F.transform(
                doc["Results"],
                lambda r: F.coalesce(F.transform(r["Vulnerabilities"], lambda v: v["Severity"]), F.array().cast("ARRAY<VARIANT>")),
            )
        ),
        lambda f: f["vuln"]["Severity"],
        lambda f: f.withField("vuln.Severity", F.lit(None).cast("string")),
    ),
)


def read_reports(reports: DataFrame, dialect: Dialect, mode: str = "strict") -> DataFrame:
    """Judge each report and keep its findings when it is usable.

    Adds ``status`` (ok, empty, error, terminated), ``reason``, ``n_unusable`` and ``findings``
    (null unless the report is usable). ``strict`` voids a report with an unusable finding;
    ``quarantine`` drops only those findings.
    """
    if mode not in ("strict", "quarantine"):
        raise ValueError(f"unknown mode {mode!r}")
    text = F.coalesce(F.col("stdout"), F.lit(""))
    early = F.when(F.col("signal").isNotNull(), "signal")
    if dialect.exit_code_counts:
        early = early.when(F.coalesce(F.col("exit_code"), F.lit(0)) != 0, "exit_code")
    early = early.when(is_blank(text), "blank")

    keys = ["scan_id", "tool", "scan_root"]
    judged = reports.select(*keys, "stdout", early.alias("early"))
    parsed = judged.select(
        "*", parse_document(F.when(F.col("early").isNull(), dialect.body(F.col("stdout"))), dialect.document).alias("parsed")
    )

    doc = F.col("parsed")["r"]
    corrupt = F.col("parsed")["_corrupt_record"].isNotNull()
    # Only documents that did not fit their type are looked at a second time.
    untyped = parse_document(F.col("stdout"), "STRING")
    late = F.when(F.col("early").isNotNull(), F.col("early"))
    late = late.when(corrupt & untyped["_corrupt_record"].isNotNull(), "bad_json")
    late = late.when(corrupt & untyped["r"].isNull(), "null_document")
    if dialect.object_root:
        late = late.when(corrupt & ~js_trim_start(untyped["r"]).startswith("{"), "no_results")
    found = dialect.findings(doc)
    if dialect.must_be_text is not None:
        suspect = ~corrupt & dialect.must_be_text.suspect(found)
        found = F.when(suspect, dialect.must_be_text.checked(found, F.when(suspect, dialect.body(F.col("stdout"))))).otherwise(found)
    if dialect.lenient is None:
        late = late.when(corrupt, "bad_type")
    else:
        found = F.when(corrupt, dialect.lenient(dialect.body(F.col("stdout")))).otherwise(found)
    late = late.when(~corrupt & doc.isNull(), "null_document").when(~corrupt & dialect.broken(doc), "bad_finding")
    staged = parsed.select(*keys, late.alias("late"), F.when(late.isNull(), found).alias("found"))

    n_unusable = F.when(F.col("late").isNull(), F.size(F.filter("found", dialect.unusable)))
    counted = staged.select("*", F.greatest(F.coalesce(n_unusable, F.lit(0)), F.lit(0)).alias("n_unusable"))

    reason = F.col("late")
    kept = F.col("found")
    if mode == "strict":
        reason = F.coalesce(reason, F.when(F.col("n_unusable") > 0, "bad_finding"))
    else:
        kept = F.when(F.col("n_unusable") > 0, F.filter(kept, lambda f: ~dialect.unusable(f))).otherwise(kept)
    errors = ["exit_code", "bad_type", "null_document", "bad_finding"]
    errors += ["blank"] if dialect.blank_is_error else []
    errors += ["bad_json"] if dialect.bad_json_is_error else []
    status = (
        F.when(reason == "signal", "terminated")
        .when(reason.isin(errors), "error")
        .when(reason.isNotNull() | (F.coalesce(F.size(kept), F.lit(0)) <= 0), "empty")
        .otherwise("ok")
    )
    return counted.select(
        *keys, status.alias("status"), reason.alias("reason"), "n_unusable", F.when(reason.isNull(), kept).alias("findings")
    )


def explode_findings(read: DataFrame) -> DataFrame:
    """One row per finding with its position in the report.

    The outer form is on purpose: for the inner one the optimizer infers a filter on the array and
    pushes it to the scan, which would parse every report a second time.
    """
    rows = read.select("scan_id", "tool", "scan_root", F.posexplode_outer("findings").alias("pos", "f"))
    return rows.filter(F.col("pos").isNotNull())


def read_split(rows: DataFrame, dialect: Dialect, mode: str = "strict") -> DataFrame:
    """Findings of reports too large for one row: (scan_id, tool, scan_root, pos, finding), one each.

    The rules are those of ``read_reports``. Strict mode has to void a report whose bad finding sits
    in another row, so the few voided (scan, tool) pairs are anti-joined; a scan with very many
    findings is never brought together. The judged findings are written once and read for both sides
    of that join: text is parsed once, and only the fields that are asked for are shuffled.
    """
    if mode not in ("strict", "quarantine"):
        raise ValueError(f"unknown mode {mode!r}")
    keys = ["scan_id", "tool", "scan_root", "pos"]
    parsed = rows.select(*keys, parse_document(F.col("finding"), dialect.finding).alias("parsed"))
    corrupt = F.col("parsed")["_corrupt_record"].isNotNull() | F.col("parsed").isNull()
    found = parsed.select(*keys, F.col("parsed")["r"].alias("f"), corrupt.alias("corrupt"))
    bad = F.col("corrupt") | F.coalesce(dialect.unusable(F.col("f")), F.lit(True))
    judged = found.select(*keys, "f", bad.alias("bad"))
    if mode == "strict":
        path = fresh_path(rows.sparkSession, "split")
        judged.write.parquet(path)
        kept = rows.sparkSession.read.schema(judged.schema).parquet(path)
        void = kept.filter("bad").select("scan_id", "tool").distinct()
        # Hashed are the voided pairs of a partition, once each; a sort-merge join would sort all findings.
        return kept.join(void.hint("shuffle_hash"), ["scan_id", "tool"], "left_anti").drop("bad")
    return sealed(judged, *keys).filter(~F.col("bad")).drop("bad")


def store_reports(reports: DataFrame, path: str) -> None:
    """Write reports as a table partitioned by tool.

    Each dialect is read by its own branch of the plan. With this layout a branch opens only its
    tool's files; without it every branch would read the text column of all tools.
    """
    reports.write.mode("append").partitionBy("tool").parquet(path)


def sealed(df: DataFrame, *plain: str) -> DataFrame:
    """Same rows, with the columns that are not ``plain`` made by a generator that filters cannot be pushed through.

    A filter on a column derived from parsed JSON would otherwise be rewritten in terms of the
    parse and pushed to the scan, which parses every report again for each mention. Filters on the
    plain columns, which the scan has as they are, still reach it.
    """
    derived = F.array(F.struct(*(c for c in df.columns if c not in plain)))
    return df.select(*plain, F.inline_outer(derived)).select(*df.columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
