"""Preprocessing programs: an ordered list of ``{column, operation}`` steps.

Steps that keep all rows and touch only their own columns are gathered into a
wave: the statistics of the whole wave come from one aggregate, its results
from one projection.  A program of k scalings on different columns therefore
reads the data once, not k times.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..operators import clean, encode, fill, scale
from ..operators.columns import fit, numeric_columns, q, replace, require, type_of
from ..session import materialize

ALL = "All Columns"
EXCLUDE = "Exclude from All Columns list"

# The accepted step labels.
ALL_COLUMN_STEPS = (
    "Drop Null", "Fill 0 Unknown False", "Fill Mean", "Fill Median", "Drop Duplicates",
    "L1 Norm", "L2 Norm", "L inf Norm", "Min-Max", "Z-score", "Remove Outliers",
)
COLUMN_STEPS = (
    "Drop Null", "Drop Duplicates", "Drop Column", "Fill 0", "Fill mean", "Fill Mode", "Fill Median",
    "Fill Unknown", "Fill False", "L1 Norm", "L2 Norm", "L inf Norm", "Min-Max", "Z-score",
    "Remove Outliers", "Log", "Square", "Square Root", "Label Encoding", "One Hot Encoding",
)
# Steps offered per kind of column.
NUMERIC_STEPS = (
    "Drop Column", "Drop Null", "Fill 0", "Fill mean", "Fill Mode", "Fill Median", "Drop Duplicates",
    "L1 Norm", "L2 Norm", "L inf Norm", "Min-Max", "Z-score", "Log", "Square", "Square Root",
    "Remove Outliers", "One Hot Encoding", EXCLUDE,
)
STRING_STEPS = ("Drop Column", "Drop Null", "Fill Unknown", "Drop Duplicates", "Label Encoding", "One Hot Encoding", EXCLUDE)

MEDIAN_ERROR = 0.001


@dataclass(frozen=True)
class StepReport:
    number: int
    column: str
    operation: str
    status: str
    message: str = ""


@dataclass
class Local:
    """A step of a wave: what it must know, and the columns it then yields."""

    targets: list[str]
    needs: dict = field(default_factory=dict)
    build: Callable[[dict], dict[str, Column]] = lambda stats: {}
    hidden: dict[str, Column] = field(default_factory=dict)


def offered_steps(df: DataFrame, column: str) -> tuple[str, ...]:
    """Steps that suit a column's type."""
    if column == ALL:
        return ALL_COLUMN_STEPS
    kind = type_of(df, column)
    if isinstance(kind, T.NumericType):
        return NUMERIC_STEPS
    return STRING_STEPS if isinstance(kind, T.StringType) else ()


def _scaled(column: str, method: str) -> Local:
    return Local([column], scale.column_statistics(column, method),
                 lambda stats: {column: scale.column_expression(column, method, stats)})


def _imputed(df: DataFrame, columns: list[str], strategy: str, error: float) -> Local | None:
    if strategy == "median" and error == 0:
        return None
    _need_numeric(df, columns)

    def build(stats: dict) -> dict[str, Column]:
        empty = [c for c in columns if stats[c] is None]
        if empty:
            raise ValueError(f"no value to impute from in column(s) {empty}")
        return {c: fill.fill_expression(df, c, stats[c]) for c in columns}

    return Local(columns, fill.impute_statistics(df, columns, strategy, error or MEDIAN_ERROR), build)


def _need_numeric(df: DataFrame, columns: list[str]) -> None:
    wrong = [c for c in columns if not isinstance(type_of(df, c), T.NumericType)]
    if wrong:
        raise ValueError(f"not numeric: {wrong}")


def _rows(df: DataFrame, columns: list[str], method: str) -> Local:
    """Row-family steps: broken vectors are counted first, so the step fails here and not at the write."""
    if not columns:
        return Local([])
    needs: dict = {"broken": scale.incomplete_rows(df, columns)}
    if method in ("Min-Max", "Z-score"):
        needs.update(scale.all_statistics(columns, method))

    def build(stats: dict) -> dict[str, Column]:
        if stats["broken"]:
            raise ValueError(f"{stats['broken']} row(s) hold a NULL or NaN")
        if method in ("Min-Max", "Z-score"):
            return scale.all_expressions(columns, method, stats)
        return scale.row_expressions(columns)

    return Local(list(columns), needs, build, {scale.CHECK: scale.row_check(df, columns, method)})


def _constant(df: DataFrame, column: str, value) -> Local:
    return Local([column], {}, lambda stats: {column: fill.fill_expression(df, column, value)} if fill.accepts(type_of(df, column), value) else {})


def _local(df: DataFrame, step: dict, everything: list[str], numeric: list[str], median_error: float) -> Local | None:
    """The wave form of a step, or None when it changes rows or the schema."""
    column, operation = step["column"], step["operation"]
    if column == ALL:
        if operation == "Fill 0 Unknown False":
            def fills(stats: dict) -> dict[str, Column]:
                return {c: fill.fill_expression(df, c, v) for c in everything for v in (0, "unknown", False) if fill.accepts(type_of(df, c), v)}
            return Local(everything, {}, fills)
        if operation in ("Fill Mean", "Fill Median"):
            return _imputed(df, numeric, operation.split()[1].lower(), median_error)
        if operation in scale.METHODS:
            return _rows(df, numeric, operation)
        return None
    if operation in ("Fill mean", "Fill Median"):
        return _imputed(df, [column], operation.split()[1].lower(), median_error)
    if operation in scale.METHODS:
        _need_numeric(df, [column])
        return _scaled(column, operation)
    if operation in ("Log", "Square", "Square Root"):
        _need_numeric(df, [column])
        return Local([column], {}, lambda stats: {column: scale.transform_expression(column, operation)})
    constants = {"Fill 0": 0, "Fill Unknown": "Unknown", "Fill False": False}
    if operation in constants:
        return _constant(df, column, constants[operation])
    return None


def _direct(df: DataFrame, step: dict, everything: list[str], numeric: list[str], quantile_error: float, median_error: float) -> DataFrame:
    """Steps that change rows or the schema, or need a job of their own."""
    column, operation = step["column"], step["operation"]
    if column == ALL:
        if operation == "Drop Null":
            return clean.drop_null(df, everything)
        if operation == "Drop Duplicates":
            return clean.drop_duplicates(df)
        if operation == "Remove Outliers":
            return clean.remove_outliers(df, numeric, relative_error=quantile_error)
        if operation == "Fill Median":
            return fill.impute(df, numeric, "median", median_error)
        raise ValueError(f"unknown operation {operation!r} for all columns")
    if operation == "Drop Null":
        return clean.drop_null(df, [column])
    if operation == "Drop Duplicates":
        order = [q(c).asc() for c in df.columns if c != column and not isinstance(type_of(df, c), (T.MapType, T.VariantType))]
        return clean.drop_duplicates_by(df, [column], order or [q(column)])
    if operation == "Drop Column":
        return clean.drop_column(df, column)
    if operation == "Fill Mode":
        return fill.impute(df, [column], "mode")
    if operation == "Fill Median":
        return fill.impute(df, [column], "median", median_error)
    if operation == "Remove Outliers":
        return clean.remove_outliers(df, [column], relative_error=quantile_error)
    if operation == "Label Encoding":
        return encode.label_encode(df, column)
    if operation == "One Hot Encoding":
        return encode.one_hot_encode(df, column)
    raise ValueError(f"unknown operation {operation!r} for a column")


def preprocess(df: DataFrame, steps: list[dict], on_error: str = "raise", quantile_error: float = 0.01,
               median_error: float = MEDIAN_ERROR) -> tuple[DataFrame, list[StepReport]]:
    """Apply the steps in order; returns the lazy result and one report per step.

    ``on_error="skip"`` reports a failing step and goes on with the unchanged
    data.  Steps on all columns see the current columns minus the excluded ones.
    """
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error must be 'raise' or 'skip'")
    run = _Run(df, on_error, quantile_error, median_error)
    for number, step in enumerate(steps, start=1):
        run.add(number, step, last=number == len(steps))
    run.flush()
    return run.df, sorted(run.reports, key=lambda r: r.number)


class _Run:
    """Folds steps over a DataFrame, one wave at a time."""

    def __init__(self, df: DataFrame, on_error: str, quantile_error: float, median_error: float) -> None:
        self.df = df
        self.on_error = on_error
        self.quantile_error = quantile_error
        self.median_error = median_error
        self.excluded: set[str] = set()
        self.wave: list[tuple[int, dict, Local]] = []
        self.reports: list[StepReport] = []

    def add(self, number: int, step: dict, last: bool) -> None:
        self._guard(number, step, lambda: self._add(number, step, last))

    def _guard(self, number: int, step: dict, action: Callable[[], None]) -> None:
        try:
            action()
        except (ValueError, PySparkException) as error:
            if self.on_error == "raise":
                raise
            self.reports.append(StepReport(number, step["column"], step["operation"], "skipped", str(error).split("\n")[0]))

    def _done(self, number: int, step: dict) -> None:
        self.reports.append(StepReport(number, step["column"], step["operation"], "applied"))

    def _add(self, number: int, step: dict, last: bool) -> None:
        column, operation = step["column"], step["operation"]
        if operation == EXCLUDE:
            require(self.df, [column])
            self.excluded.add(column)
            self._done(number, step)
            return
        if column != ALL:
            require(self.df, [column])
        local = self._as_local(step)
        if local is not None and self._collides(local):
            self.flush()
            local = self._as_local(step)
        if local is not None:
            self.wave.append((number, step, local))
            return
        self.flush()
        everything, numeric = self._lists()
        self.df = _direct(self.df, step, everything, numeric, self.quantile_error, self.median_error)
        if operation == "Drop Duplicates" and not last:
            # later statistics would repeat the shuffle
            self.df = materialize(self.df)
        self._done(number, step)

    def _lists(self) -> tuple[list[str], list[str]]:
        everything = [c for c in self.df.columns if c not in self.excluded]
        return everything, numeric_columns(self.df, self.excluded)

    def _as_local(self, step: dict) -> Local | None:
        everything, numeric = self._lists()
        return _local(self.df, step, everything, numeric, self.median_error)

    def _collides(self, local: Local) -> bool:
        """A wave may hold each column once; steps on all columns stand alone."""
        taken = {c for _, _, other in self.wave for c in other.targets}
        return bool(taken & set(local.targets))

    def flush(self) -> None:
        """Fit the statistics of the wave in one job and apply it in one projection."""
        wave, self.wave = self.wave, []
        stats = self._fit(wave)
        changed: dict[str, Column] = {}
        hidden: dict[str, Column] = {}
        for number, step, local in wave:
            def apply(number=number, step=step, local=local) -> None:
                known = fit(self.df, local.needs) if stats is None else {k: stats[(number, k)] for k in local.needs}
                changed.update(local.build(known))
                hidden.update(local.hidden)
                self._done(number, step)
            self._guard(number, step, apply)
        if changed:
            self.df = replace(self.df, changed, hidden)

    def _fit(self, wave: list[tuple[int, dict, Local]]) -> dict | None:
        """Statistics of the whole wave, or None when a failing one must be found step by step."""
        try:
            return fit(self.df, {(n, k): e for n, _, local in wave for k, e in local.needs.items()})
        except PySparkException:
            if self.on_error == "raise":
                raise
            return None
