"""Declared integrity as checks over DataFrames, and what deletes do to referring rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.catalogue import NOW, TABLES, Ref, Table
from scanloom.operators.credentials import spread_nulls
from scanloom.session import checkpoint
from scanloom.sources.reports import union_all


def _either(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _unpivot(one_row: DataFrame, label: str, value: str) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias(label), F.col(f"`{c}`").alias(value)) for c in one_row.columns]
    return one_row.select(F.inline(F.array(*pairs)))


def _present(df: DataFrame, table: Table):
    return [c for c in table.columns if c.name in df.columns]


def null_counts(df: DataFrame, table: Table) -> DataFrame:
    """Nulls per required column, all columns in one pass."""
    required = [c.name for c in _present(df, table) if c.required]
    return _unpivot(df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required]), "column", "n_null")


def null_rows(df: DataFrame, table: Table) -> DataFrame:
    return df.filter(_either([F.col(c.name).isNull() for c in _present(df, table) if c.required]))


def duplicates(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys held by several rows. A key with a null part never collides."""
    whole = ~_either([F.col(c).isNull() for c in key])
    return df.filter(whole).groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def unique_violations(df: DataFrame, table: Table) -> DataFrame:
    """Colliding keys of every uniqueness rule of the table: (rule, key, n)."""
    rules = [key for key in table.keys if set(key) <= set(df.columns)]
    return union_all(
        [
            duplicates(df, key).select(
                F.lit(",".join(key)).alias("rule"),
                F.concat_ws(",", *[F.col(c).cast("string") for c in key]).alias("key"),
                "n",
            )
            for key in rules
        ]
    )


def orphans(child: DataFrame, ref: Ref, parent: DataFrame) -> DataFrame:
    """Rows whose reference has no target; null references are allowed."""
    keys = parent.select(F.col(ref.parent_column).alias(ref.column))
    return child.filter(F.col(ref.column).isNotNull()).join(keys, ref.column, "left_anti")


def orphan_counts(child: DataFrame, ref: Ref, parent: DataFrame) -> DataFrame:
    """Missing targets and their number of references.

    References are counted per value before the join, so a value that a third of the rows share
    crosses the network as one row per task.
    """
    values = child.filter(F.col(ref.column).isNotNull()).groupBy(ref.column).agg(F.count("*").alias("n_rows"))
    return values.join(parent.select(F.col(ref.parent_column).alias(ref.column)), ref.column, "left_anti")


def too_long(df: DataFrame, table: Table) -> DataFrame:
    """Values beyond their declared length, counted per column in one pass."""
    sized = [c for c in _present(df, table) if c.size]
    counted = df.agg(*[F.count_if(F.length(c.name) > c.size).alias(c.name) for c in sized])
    return _unpivot(counted, "column", "n_too_long")


def outside_sets(df: DataFrame, table: Table) -> DataFrame:
    """Values outside their closed set, counted per column and value."""
    closed = [c for c in _present(df, table) if c.values]
    # All closed columns in one pass: a row yields an entry for each of its odd values only.
    odd = F.array(
        *[
            F.when(~F.col(c.name).isin(*c.values), F.struct(F.lit(c.name).alias("column"), F.col(c.name).alias("value")))
            for c in closed
        ]
    )
    entries = df.select(F.explode(F.array_compact(odd)).alias("e")).select("e.*")
    return entries.groupBy("column", "value").agg(F.count("*").alias("n"))


def apply_defaults(df: DataFrame, table: Table, now: Column) -> DataFrame:
    """Columns the write leaves out get their default (or null); written nulls stay null."""
    missing = [c for c in table.columns if c.name not in df.columns and c.name != table.key]
    values = {
        c.name: (now if c.default == NOW else F.lit(c.default)).cast(c.kind) for c in missing
    }
    return df.withColumns(values)


def facts(tables: dict[str, DataFrame]) -> DataFrame:
    """What the declared columns of all tables break: (table, column, fact, n), one pass over each table.

    Facts are ``null`` in a required column, ``too_long`` and ``outside`` of a closed set. What is kept yields no row, columns
    a table does not bring are not judged.
    """
    found = []
    for name, df in tables.items():
        tests = {}
        for c in _present(df, TABLES[name]):
            value = F.col(c.name)
            tests |= {("null", c.name): value.isNull()} if c.required else {}
            tests |= {("too_long", c.name): F.length(value) > c.size} if c.size else {}
            tests |= {("outside", c.name): ~value.isin(*c.values)} if c.values else {}
        if not tests:
            continue
        counted = df.agg(*[F.count_if(test).alias(f"n{i}") for i, test in enumerate(tests.values())])
        rows = [
            F.struct(F.lit(name).alias("table"), F.lit(column).alias("column"), F.lit(fact).alias("fact"), F.col(f"n{i}").alias("n"))
            for i, (fact, column) in enumerate(tests)
        ]
        found.append(counted.select(F.inline(F.array(*rows))))
    return union_all(found).where("n > 0")


def _entry(columns: tuple[str, ...]) -> Column:
    """The values as one text that differs if any value does; null if any is null."""
    values = [F.col(c).cast("string") for c in columns]
    whole = ~_either([v.isNull() for v in values])
    return F.when(whole, values[0] if len(values) == 1 else F.to_json(F.array(*values)))


def colliding_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys held by several rows, for every uniqueness rule of all tables: (table, rule, key, n), one pass over each table.

    A key of several columns is a JSON list. Keys with a null part never collide. A row enters
    the shuffle once for each rule, and equal ones of a task as one.
    """
    entries = []
    for name, df in tables.items():
        rules = [key for key in TABLES[name].keys if set(key) <= set(df.columns)]
        if rules:
            each = [F.struct(F.lit(name).alias("table"), F.lit(",".join(key)).alias("rule"), _entry(key).alias("key")) for key in rules]
            entries.append(df.select(F.inline(F.array(*each))).where(F.col("key").isNotNull()))
    return union_all(entries).groupBy("table", "rule", "key").agg(F.count("*").alias("n")).where("n > 1")


def dangling(tables: dict[str, DataFrame]) -> DataFrame:
    """References without a target, over all tables given: (table, column, parent, value, n), one anti join in all.

    Every row enters with its references that are not null, counted per value before the join, so that a value
    that a third of the rows share crosses the network as one row a task. References to tables not given are not judged.
    """
    entries, targets = [], {}
    for name, df in tables.items():
        refs = [r for r in TABLES[name].refs if r.column in df.columns and r.parent in tables and r.parent_column in tables[r.parent].columns]
        if refs:
            each = [
                F.struct(F.lit(name).alias("table"), F.lit(r.column).alias("column"), F.lit(r.parent).alias("parent"),
                         F.lit(r.parent_column).alias("parent_column"), F.col(r.column).cast("string").alias("value"))
                for r in refs
            ]
            entries.append(df.select(F.inline(F.array(*each))).where(F.col("value").isNotNull()))
            targets |= {(r.parent, r.parent_column): None for r in refs}
    keys = [
        tables[parent].select(F.lit(parent).alias("parent"), F.lit(column).alias("parent_column"), F.col(column).cast("string").alias("value"))
        for parent, column in targets
    ]
    target = ["parent", "parent_column", "value"]
    counted = union_all(entries).groupBy("table", "column", *target).agg(F.count("*").alias("n"))
    return counted.join(union_all(keys), target, "left_anti").select("table", "column", "parent", "value", "n")


KEPT, DELETED, BLOCKING = "kept", "deleted", "blocking"


@dataclass
class Deletion:
    """What a delete does: keys gone per table, rows kept per table, rows that forbid it.

    ``fates`` has every row of a table once, as it is afterwards, with its ``fate``: deleted, kept, or kept and blocking, and
    then with the references that forbid it (``blocked_by``). The other three are filters of it.
    """

    deleted: dict[str, DataFrame]
    kept: dict[str, DataFrame]
    blocking: dict[str, DataFrame]
    fates: dict[str, DataFrame]


def _parents_first(tables: dict[str, DataFrame]) -> list[str]:
    """Parents before children."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in tables:
            return
        for ref in TABLES[name].refs:
            visit(ref.parent)
        order.append(name)

    for name in tables:
        visit(name)
    return order


def delete(tables: dict[str, DataFrame], root: str, keys: DataFrame) -> Deletion:
    """Delete ``keys`` (one column, the primary key) from ``root`` and follow the declared rules.

    Each table is joined once per reference to the deleted keys of the parent. These are settled once a table, so every
    result reads its own table once and keys, but no parent again. Rows whose reference is null get a key of
    their own for the join, so that they do not pile up in one task. Null keys delete nothing, repeated ones count once.
    """
    out = Deletion({}, {}, {}, {})
    lost: dict[tuple[str, str], DataFrame] = {}
    for name in _parents_first(tables):
        table, rows = TABLES[name], tables[name]
        salt = F.col(table.key) if table.key in rows.columns else F.xxhash64(*rows.columns)
        gone, blocked, marked = [], [], rows.withColumn("__salt", salt.cast("string"))

        def matched(marked: DataFrame, column: str, target: DataFrame, flag: str) -> DataFrame:
            key = spread_nulls(F.col(column), F.col("__salt"))
            return marked.withColumn("__key", key).join(target.withColumn(flag, F.lit(True)), "__key", "left").drop("__key")

        if name == root:
            wanted = keys.where(F.col(table.key).isNotNull()).select(F.col(table.key).cast("string").alias("__key")).distinct()
            marked = matched(marked, table.key, wanted, "__root")
            gone.append(F.col("__root").isNotNull())
        for n, ref in enumerate(table.refs):
            target = lost.get((ref.parent, ref.parent_column))
            if target is None or ref.column not in rows.columns:
                continue
            flag = f"__ref{n}"
            marked = matched(marked, ref.column, target, flag)
            if ref.on_delete == "cascade":
                gone.append(F.col(flag).isNotNull())
            elif ref.on_delete == "set null":
                marked = marked.withColumn(ref.column, F.when(F.col(flag).isNull(), F.col(ref.column)))
            else:
                blocked.append(F.when(F.col(flag).isNotNull(), ref.column))
        against = F.array_compact(F.array(*blocked)).cast("array<string>")
        fate = F.when(_either(gone), DELETED).when(F.size(against) > 0, BLOCKING).otherwise(KEPT)
        fates = marked.withColumns({"fate": fate, "blocked_by": against}).select(*rows.columns, "fate", "blocked_by")
        out.fates[name] = fates
        if gone:
            dead = fates.where(F.col("fate") == DELETED)
            out.deleted[name] = dead.select(*rows.columns)
            used = {r.parent_column for t in tables for r in TABLES[t].refs if r.parent == name and r.parent_column in rows.columns}
            for column in sorted(used):
                lost[name, column] = checkpoint(
                    dead.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("__key")).distinct()
                )
        if blocked:
            out.blocking[name] = fates.where(F.col("fate") == BLOCKING).select(*rows.columns)
        out.kept[name] = fates.where(F.col("fate") != DELETED).select(*rows.columns)
    return out
