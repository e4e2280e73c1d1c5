"""The full pipeline, its quick variant and the page extract, for either configuration."""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import days_between, prefer, quotient
from ..operators import clean as C
from ..operators import enrich as E
from ..operators import features as X
from ..operators import flags as Q
from ..operators import outliers as O
from ..operators import profile as P
from ..operators import segment as G
from ..session import scratch_path
from ..sources import pages as J
from ..sources.monthly import CSV_ENCODING
from ..sources.sinks import Counts, checkpoint_stage, slices_for, write_month, write_report, write_stage
from .config import DATE_COLUMNS, MOMENT_COLUMNS, NUMERIC_COLUMNS, PipelineConfig

TYPING = C.Typing(dates=DATE_COLUMNS, moments=MOMENT_COLUMNS, numbers=NUMERIC_COLUMNS)
STRICT_TYPING = C.Typing(dates=DATE_COLUMNS, moments=MOMENT_COLUMNS, numbers=NUMERIC_COLUMNS, strict_dates=True)


def row_rules(cfg: PipelineConfig) -> list[C.Rule]:
    return [
        C.require_positive(cfg.price),
        C.null_or_positive("LivingArea"),
        *[C.null_or_nonneg(c) for c in ("DaysOnMarket", "BedroomsTotal", "BathroomsTotalInteger")],
    ]


def combine(raw: DataFrame, cfg: PipelineConfig) -> DataFrame:
    return C.filter_category(raw, cfg.category, cfg.category_value)


def clean(df: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Typed rows that pass the row rules, with quality flags."""
    return Q.quality_flags(C.apply_rules(C.coerce(df, TYPING), row_rules(cfg)))


def prune(df: DataFrame, cfg: PipelineConfig, high_missing: list[str]) -> DataFrame:
    return C.drop_columns(df, [*cfg.dropped, *[c for c in high_missing if c not in cfg.essential]])


def add_features(df: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Price ratios, durations and time columns, each where its inputs exist."""

    def has(*columns: str) -> bool:
        return all(c in df.columns for c in columns)

    new = {}
    original = "OriginalListPrice"
    if has(cfg.price, original):
        new["price_ratio"] = X.guarded_ratio(cfg.price, original, cfg.ratio_guard, 4, cfg.ratio_bounds)
    if has(cfg.price, "LivingArea"):
        new["price_per_sqft"] = X.guarded_ratio(cfg.price, "LivingArea", 0, 2)
    if cfg.closed_ratio and has(original):
        paid = prefer("ClosePrice", F.col("ClosePrice") > 0, "ListPrice") if has("ClosePrice") else "ListPrice"
        new["close_to_original_list_ratio"] = X.guarded_ratio(paid, original, 0, 4)
    if has("PurchaseContractDate", "ListingContractDate"):
        new["listing_to_contract_days"] = days_between("PurchaseContractDate", "ListingContractDate")
    if has("CloseDate", "PurchaseContractDate"):
        new["contract_to_close_days"] = days_between("CloseDate", "PurchaseContractDate")
    df = df.withColumns(new)
    if "price_ratio" in new and not cfg.closed_ratio:
        df = df.withColumn("close_to_original_list_ratio", F.col("price_ratio"))
    if has(cfg.event_date):
        parts = [f"{cfg.time_prefix}_{p}" for p in ("year", "month", "yrmo")]
        df = X.time_parts(df, cfg.event_date, *parts)
    return df


def segment_report(df: DataFrame, cfg: PipelineConfig) -> DataFrame:
    medians = {
        cfg.median_price_name: cfg.price,
        "median_price_per_sqft": "price_per_sqft",
        "median_price_ratio": "price_ratio",
        "median_dom": "DaysOnMarket",
        "median_list_to_contract": "listing_to_contract_days",
    }
    summary = G.segment_summary(df, cfg.segment, medians, cfg.price, cfg.count_name)
    return G.order_by_desc(summary, cfg.median_price_name, cfg.segment)


def flag_outliers(df: DataFrame, cfg: PipelineConfig) -> DataFrame:
    return O.outlier_flags(df, cfg.outlier_fields, cfg.iqr_factor)


def final_filter(flagged: DataFrame, cfg: PipelineConfig) -> DataFrame:
    kept = Q.drop_flagged(flagged, cfg.outlier_flags)
    return Q.drop_out_of_band_postal(Q.in_region(kept))


def final_ledger(flagged: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Rows removed as outliers, by region and by postal code."""
    return C.ledger(
        flagged,
        [
            ("outlier", ~Q.any_of(flagged, cfg.outlier_flags)),
            ("region", Q.region_condition(flagged)),
            ("postal", ~Q.outside_codes("PostalCode", *Q.POSTAL_BAND) if "PostalCode" in flagged.columns else F.lit(True)),
        ],
    )


QUALITY_FLAGS = [
    "listing_after_close_flag", "purchase_after_close_flag", "negative_timeline_flag",
    "missing_coords_flag", "zero_coords_flag", "positive_longitude_flag", "out_of_state_flag",
    "non_ca_postal_flag",
]


STAGES = ("combined", "enriched", "cleaned", "flagged", "final")


class PipelineRun:
    """The stages of one run, each prepared when first asked for, and reports on them.

    With ``out`` the stages named in ``stages`` are written there and read back, so that each is
    computed once; all others are computed from the stage before at every use. Reports on stages up to the cleaned one
    (missing values, the rate check, coercion, row ledger, quality flags) then come from the jobs that write them.
    """

    def __init__(
        self,
        raw: DataFrame,
        cfg: PipelineConfig,
        rates: DataFrame | None = None,
        out: str | None = None,
        as_of: str | None = None,
        stages: Collection[str] = STAGES,
        stage_format: str = "parquet",
    ):
        self.raw, self.cfg, self.rates = raw, cfg, rates
        self.out, self.as_of, self.stages, self.stage_format = out, as_of, stages, stage_format
        self._counts: dict[str, Counts] = {}

    def _written(self, name: str) -> bool:
        return bool(self.out) and name in self.stages

    def _path(self, name: str) -> str:
        return f"{self.out}/{self.cfg.name}_{name}"

    def _stage(self, name: str, df: DataFrame) -> DataFrame:
        if not self._written(name):
            return df
        periods = ["year_month", f"{self.cfg.time_prefix}_yrmo"]
        options = {"period_columns": periods} if self.stage_format == "csv" else {}
        path = self._path(name)
        # The curated tables are laid out by month, so that a reader of one month opens one folder.
        by = [periods[1]] if name in ("flagged", "final") and periods[1] in df.columns else []
        dealt = name == "final" and self._written("flagged")
        # Flagged rows are cleaned rows with more columns, so that they can be dealt slice by slice.
        sliced = name == "flagged" and by and self._written("cleaned")
        slices = slices_for(df.sparkSession, self._path("cleaned")) if sliced else 1
        return checkpoint_stage(df.sparkSession, df, path, self.stage_format, by, dealt, slices, **options)

    def _counting(self, name: str, df: DataFrame, counted: dict[str, Column]) -> DataFrame:
        """The frame, counted while the stage made from it is written."""
        if not counted:
            return df
        self._counts[name] = Counts(**counted)
        return self._counts[name].of(df)

    def _counted(self, name: str, stage: str, otherwise: Callable[[], DataFrame], report: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
        """A report from what was counted while the stage was written; a job of its own where it is not written."""
        if self._written(stage):
            getattr(self, stage)
            if name in self._counts:
                counts = self._counts[name]
                return report(counts.row(self.raw.sparkSession), list(counts.counted))
        return otherwise()

    @cached_property
    def combined(self) -> DataFrame:
        df = combine(self.raw, self.cfg)
        if self._written("combined"):
            df = self._counting("missing", df, P.missing_counts(df.columns))
        return self._stage("combined", df)

    @cached_property
    def missing(self) -> DataFrame:
        """Counted once; one row per column comes to the driver."""
        report = self._counted("missing", "combined", lambda: P.missing_report(self.combined), lambda row, names: P.missing_from(row, names[1:]))
        return self.raw.sparkSession.createDataFrame(report.collect(), report.schema).orderBy(F.desc("missing_pct"), "column")

    @cached_property
    def high_missing(self) -> list[str]:
        """Measured before enrichment and typing."""
        return C.high_missing_columns(self.combined, self.cfg.missing_threshold, self.missing)

    @cached_property
    def monthly(self) -> DataFrame | None:
        return E.resample_monthly(self.rates) if self.rates is not None else None

    @cached_property
    def enriched(self) -> DataFrame:
        df = E.enrich_or_null(self.combined, self.monthly, self.cfg.event_date)
        if self._written("enriched"):
            df = self._counting("rates", df, {"rows": F.count("*"), "null_rows": F.count_if(F.col(E.RATE).isNull())})
        return self._stage("enriched", df)

    @cached_property
    def pruned(self) -> DataFrame:
        return prune(self.enriched, self.cfg, self.high_missing)

    @cached_property
    def cleaned(self) -> DataFrame:
        if not self._written("cleaned"):
            return clean(self.pruned, self.cfg)
        beside, lost, texts = C.coerce_beside(self.pruned, TYPING)
        typed = self._counting("coercion", beside, lost).drop(*texts)
        typed = self._counting("ledger", typed, C.ledger_counts(C.rule_steps(typed, row_rules(self.cfg))))
        df = Q.quality_flags(C.apply_rules(typed, row_rules(self.cfg)))
        present = [f for f in QUALITY_FLAGS if f in df.columns]
        return self._stage("cleaned", self._counting("flags", df, P.flag_counts(present) if present else {}))

    def row_ledger(self) -> DataFrame:
        typed = C.coerce(self.pruned, TYPING)
        names = [name for name, _ in C.rule_steps(typed, row_rules(self.cfg))]
        return self._counted("ledger", "cleaned", lambda: C.row_ledger(typed, row_rules(self.cfg)), lambda row, _: C.ledger_from(row, names))

    def quality_flags(self) -> DataFrame:
        return self._counted("flags", "cleaned", lambda: P.flag_summary(self.cleaned, QUALITY_FLAGS), lambda row, names: P.flags_from(row, names[1:]))

    def coercion(self) -> DataFrame:
        return self._counted("coercion", "cleaned", lambda: C.coercion_report(self.pruned, TYPING), C.coercion_from)

    def rate_check(self) -> DataFrame:
        return self._counted("rates", "enriched", lambda: P.null_check(self.enriched, E.RATE), lambda row, _: row)

    @cached_property
    def featured(self) -> DataFrame:
        return add_features(self.cleaned, self.cfg)

    @cached_property
    def flagged(self) -> DataFrame:
        return self._stage("flagged", flag_outliers(self.featured, self.cfg))

    @cached_property
    def final(self) -> DataFrame:
        return self._stage("final", final_filter(self.flagged, self.cfg))

    @cached_property
    def typed(self) -> DataFrame:
        return C.coerce(self.combined, TYPING)

    def report(self, name: str) -> DataFrame:
        return self.reports()[name]()

    def reports(self) -> dict[str, Callable[[], DataFrame]]:
        cfg = self.cfg
        reports = {
            "category_before": lambda: P.frequency_table(self.raw, cfg.category),
            "category_after": lambda: P.frequency_table(self.combined, cfg.category),
            "category_share": lambda: P.category_share(self.raw, cfg.category, cfg.category_value),
            "other_categories": lambda: P.frequency_table(
                C.complement_filter(self.raw, cfg.category, cfg.category_value), cfg.category
            ),
            "schema": lambda: P.describe_schema(self.combined),
            "missing_values": lambda: self.missing,
            "numeric_distribution": lambda: P.numeric_profile(self.combined, cfg.profile_fields),
            "price_center": lambda: P.center_and_skew(self.combined, cfg.price),
            "days_on_market": lambda: P.value_distribution(self.combined, "DaysOnMarket"),
            "top_segments": lambda: G.top_k(
                G.group_center(self.typed, cfg.segment, cfg.price, cfg.median_price_name, cfg.count_name),
                cfg.median_price_name,
                cfg.segment,
            ),
            "coercion": self.coercion,
            "row_ledger": self.row_ledger,
            "quality_flags": self.quality_flags,
            "rate_check": self.rate_check,
            "segment_summary": lambda: segment_report(self.featured, cfg),
            "fences": lambda: O.iqr_fences(self.cleaned, cfg.outlier_fields, cfg.iqr_factor),
            "outlier_flags": lambda: P.flag_summary(self.flagged, cfg.outlier_flags, 1),
            "median_shift": lambda: O.median_shift(self.flagged, cfg.outlier_fields, cfg.outlier_flags),
            "final_ledger": lambda: final_ledger(self.flagged, cfg),
            "final_span": lambda: P.dataset_span(self.final, cfg.event_date),
            "key_stats": lambda: P.key_stats(self.final, cfg.key_fields),
        }
        if cfg.closed_ratio:
            reports |= {
                "status": lambda: P.frequency_table(self.combined, "MlsStatus"),
                "price_changes": lambda: P.price_change_buckets(self.typed, "OriginalListPrice", "ListPrice"),
                "date_order": lambda: P.listing_date_issues(
                    self.typed, "ListingContractDate", "CloseDate", self.as_of
                ),
            }
        else:
            reports |= {
                "above_at_below": lambda: P.above_at_below(self.typed, "ClosePrice", "ListPrice"),
                "date_order": lambda: P.date_order_counts(
                    self.typed, "CloseDate", "ListingContractDate", "PurchaseContractDate"
                ),
            }
        if self.rates is not None:
            reports |= {
                "rate_range": lambda: E.series_range(self.rates),
                "last_rates": lambda: G.last_k(self.monthly, "year_month"),
            }
        return reports


def run_pipeline(
    raw: DataFrame,
    cfg: PipelineConfig,
    rates: DataFrame | None = None,
    out: str | None = None,
    as_of: str | None = None,
    stages: Collection[str] = STAGES,
    stage_format: str = "parquet",
) -> PipelineRun:
    """All stages from raw text columns to the final table, and the three report files, under ``out``.

    ``rates`` is a dated series (date, rate); without it the rate column is null. Without ``out``
    nothing is written and stages are prepared on demand.
    """
    run = PipelineRun(raw, cfg, rates, out, as_of, stages, stage_format)
    if out:
        # These reports read stages up to the cleaned one: their shuffles are gone before the last two tables take room.
        write_report(run.missing, f"{out}/reports/{cfg.name}_missing_value_report", index="column")
        write_report(run.report("numeric_distribution"), f"{out}/reports/{cfg.name}_numeric_distribution")
        write_report(run.report("segment_summary"), f"{out}/reports/{cfg.name}_county_summary")
        _ = run.final
    return run


def run_quick(
    raw: DataFrame, cfg: PipelineConfig, k: float | None = None, out: str | None = None, encoding: str = CSV_ENCODING
) -> DataFrame:
    """The quick variant: required columns, strict dates, fences on already trimmed rows, plain ratios.

    With ``out`` the result is also written there as CSV.
    """
    quick = cfg.quick
    required = C.filter_category(raw, cfg.category, cfg.category_value).dropna(subset=[cfg.price, "LivingArea"])
    typed = C.coerce(C.drop_columns(required, quick.dropped, strict=quick.strict_drop), STRICT_TYPING)
    # The text is parsed once; fences and rows are read from the typed table.
    staged = checkpoint_stage(raw.sparkSession, typed, scratch_path(raw.sparkSession, "quick"))
    trimmed = O.iqr_filter_sequential(staged, cfg.outlier_fields, k or cfg.iqr_factor, staged=True)
    priced = trimmed.withColumns(
        {
            quick.price_per_area: quotient(cfg.price, "LivingArea"),
            quick.ratio: quotient("ClosePrice", "ListPrice"),
        }
    )
    result = X.time_parts(priced, cfg.event_date, quick.year, quick.month, quick.yrmo)
    if out:
        write_stage(result, out, "csv", encoding=encoding)
    return result


def quick_missing(raw: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Missing values of the critical columns only."""
    return P.missing_report(raw, [c for c in cfg.quick.critical if c in raw.columns])


def pages_to_monthly(
    spark: SparkSession, pages: str, month: str, cfg: PipelineConfig, folder: str, prefix: str, one_per_file: bool = True
) -> str:
    """Landed pages to one monthly export: projection, status and half-open month, CSV with header."""
    records = J.read_pages(spark, pages, cfg.export_columns, one_per_file)
    selected = (
        J.closed_month(records, month, cfg.status) if cfg.status else J.listing_month(records, month)
    )
    return write_month(selected, folder, prefix, month, cfg.export_columns)
