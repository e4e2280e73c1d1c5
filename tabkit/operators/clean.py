"""Typing, column pruning and row rules, with reports of what each of them cost."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_true, num, strict_day, strict_moment, to_day, to_moment
from ..functions.scalars import MISSING_TOKENS
from .profile import missing_report, unfold


def normalise_tokens(df: DataFrame) -> DataFrame:
    """Null for missing-value texts in all text columns."""
    tokens = ", ".join(f"'{t}'" for t in MISSING_TOKENS)
    names = [("`" + c.replace("`", "``") + "`", kind) for c, kind in df.dtypes]
    return df.selectExpr(*[f"case when {c} not in ({tokens}) then {c} end as {c}" if kind == "string" else c for c, kind in names])


def filter_category(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) == value)


def complement_filter(df: DataFrame, column: str, value: str) -> DataFrame:
    """All other rows, null included."""
    return df.where(~F.col(column).eqNullSafe(value))


def drop_columns(df: DataFrame, names: Sequence[str], strict: bool = False) -> DataFrame:
    """Drop columns; absent names are ignored unless ``strict``."""
    absent = [n for n in names if n not in df.columns]
    if strict and absent:
        raise ValueError(f"columns not found: {absent}")
    return df.drop(*names)


def high_missing_columns(df: DataFrame, threshold: float = 90.0, report: DataFrame | None = None) -> list[str]:
    """Columns whose rounded missing percentage lies strictly above the threshold.

    Brings at most one row per column to the driver: the schema of the result depends on it.
    """
    report = missing_report(df) if report is None else report
    return [r["column"] for r in report.where(F.col("missing_pct") > threshold).collect()]


def drop_high_missing(
    df: DataFrame,
    threshold: float = 90.0,
    keep: Collection[str] = (),
    report: DataFrame | None = None,
) -> DataFrame:
    """Drop mostly missing columns, except those in ``keep``."""
    return df.drop(*[c for c in high_missing_columns(df, threshold, report) if c not in keep])


@dataclass(frozen=True)
class Typing:
    """Which text columns become dates, timestamps and numbers."""

    dates: Sequence[str] = ()
    moments: Sequence[str] = ()
    numbers: Sequence[str] = ()
    strict_dates: bool = False

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        kinds = dict(df.dtypes)

        def text(names: Sequence[str]) -> list[str]:
            return [n for n in names if kinds.get(n) == "string"]

        day, moment = (strict_day, strict_moment) if self.strict_dates else (to_day, to_moment)
        return {
            **{c: day(F.col(c)) for c in text(self.dates)},
            **{c: moment(F.col(c)) for c in text(self.moments)},
            **{c: num(F.col(c)) for c in text(self.numbers)},
        }


def coerce(df: DataFrame, typing: Typing) -> DataFrame:
    return df.withColumns(typing.expressions(df))


def coercion_counts(df: DataFrame, typing: Typing) -> dict[str, Column]:
    """The aggregates over the untyped frame that a coercion report is made of."""
    return {c: F.count_if(F.col(c).isNotNull() & e.isNull()) for c, e in typing.expressions(df).items()}


def coerce_beside(df: DataFrame, typing: Typing) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """The typed frame with the texts beside the typed columns, the aggregates over it that a coercion report is made of, and the names of the texts.

    So each text is parsed once, where counts over the untyped frame parse it a second time.
    """
    texts = {c: f"__text_{i}_{c}" for i, c in enumerate(typing.expressions(df))}
    typed = coerce(df.withColumns({text: F.col(c) for c, text in texts.items()}), typing)
    return typed, {c: F.count_if(F.col(text).isNotNull() & F.col(c).isNull()) for c, text in texts.items()}, list(texts.values())


def coercion_from(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    return counts.unpivot([], list(columns), "column", "new_nulls")


def coercion_report(df: DataFrame, typing: Typing) -> DataFrame:
    """Rows (column, new_nulls): values that typing turns into null, all columns in one pass."""
    counted = coercion_counts(df, typing)
    if not counted:
        return df.sparkSession.createDataFrame([], "column string, new_nulls long")
    return coercion_from(df.agg(*[c.alias(name) for name, c in counted.items()]), list(counted))


@dataclass(frozen=True)
class Rule:
    """A row is kept where ``condition`` is true; the rule is skipped when its column is absent."""

    name: str
    column: str
    condition: str


def require_positive(column: str) -> Rule:
    return Rule(f"{column} <= 0 or missing", column, f"coalesce(`{column}` > 0, false)")


def null_or_positive(column: str) -> Rule:
    return Rule(f"{column} <= 0", column, f"coalesce(`{column}` > 0, true)")


def null_or_nonneg(column: str) -> Rule:
    return Rule(f"{column} < 0", column, f"coalesce(`{column}` >= 0, true)")


def _present(df: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    return [r for r in rules if r.column in df.columns]


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    for rule in _present(df, rules):
        df = df.where(rule.condition)
    return df


def ledger_counts(steps: Sequence[tuple[str, Column]]) -> dict[str, Column]:
    """The aggregates that a ledger is made of: all rows, and those that fail each condition first."""
    failed = F.coalesce(*[F.when(~is_true(c), F.lit(i)) for i, (_, c) in enumerate(steps)], F.lit(len(steps)))
    return {"n": F.count("*"), **{f"r{i}": F.count_if(failed == i) for i in range(len(steps))}}


def ledger_from(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """The ledger from one row of ``ledger_counts``."""
    rows, before = [], F.col("n")
    for i, name in enumerate(names):
        after = before - F.col(f"r{i}")
        rows.append([F.lit(i + 1), F.lit(name), before, F.col(f"r{i}"), after])
        before = after
    return unfold(counts, rows, ["step", "name", "rows_before", "removed", "rows_after"])


def ledger(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows (step, name, rows_before, removed, rows_after) for a sequence of keep conditions.

    Each row is counted under the first condition it fails, so one pass gives the same
    counts as applying the steps one after another.
    """
    if not steps:
        shape = "step int, name string, rows_before long, removed long, rows_after long"
        return df.sparkSession.createDataFrame([], shape)
    counted = df.agg(*[c.alias(name) for name, c in ledger_counts(steps).items()])
    return ledger_from(counted, [name for name, _ in steps])


def rule_steps(df: DataFrame, rules: Sequence[Rule]) -> list[tuple[str, Column]]:
    return [(r.name, F.expr(r.condition)) for r in _present(df, rules)]


def row_ledger(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return ledger(df, rule_steps(df, rules))
