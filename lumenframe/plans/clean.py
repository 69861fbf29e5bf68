"""Cleaning by configuration: one chain of table steps in a fixed order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from lumenframe.functions.stats import numeric_columns, string_columns
from lumenframe.operators import encode, nulls, outliers, scale, select
from lumenframe.operators.project import drop_columns, fill_zero, replace_infinite
from lumenframe.plans.roles import Roles
from lumenframe.session import cut_lineage


@dataclass(frozen=True)
class CleaningConfig:
    """Options of a cleaning run; a step whose option is empty is skipped."""

    target: str | None = None
    key: str | None = None
    zero_fill: bool = False
    remove_columns: tuple[str, ...] = ()
    remove_duplicates: bool = False
    column_nulls: Sequence[Mapping[str, str]] | Mapping[str, str] = ()
    nulls: str | None = None
    outliers: str | None = None
    # drop_rows, mask (blank the cells), or report (leave the rows; only quality figures see the mask).
    outlier_mode: str = "drop_rows"
    encoder: str | None = None
    normalization: str | None = None
    scaling: str | None = None
    selector: str | None = None


# What an upload gets when nothing is chosen.
DEFAULTS = CleaningConfig(
    zero_fill=True,
    nulls=nulls.CONSTANT,
    outliers=outliers.IQR,
    outlier_mode="report",
    encoder=encode.LABEL,
    normalization="L2 Normalization",
    scaling="Standard Scaler",
)

ALLOWED = {
    "nulls": nulls.METHODS,
    "outliers": outliers.METHODS,
    "encoder": encode.METHODS,
    "normalization": scale.NORMALIZERS,
    "scaling": scale.SCALERS,
}


def from_choices(choices: Mapping[str, str], base: CleaningConfig = DEFAULTS) -> CleaningConfig:
    """The defaults with every valid choice put in; a name that is not known keeps its default."""
    valid = {k: v for k, v in choices.items() if k not in ALLOWED or v in ALLOWED[k]}
    return replace(base, **valid)


def prepare(df: DataFrame, config: CleaningConfig) -> DataFrame:
    """The table as loaded: unwanted columns gone and, when asked, nulls and infinities set to zero."""
    df = drop_columns(df, config.remove_columns)
    return fill_zero(replace_infinite(df)) if config.zero_fill else df


def handle_nulls(df: DataFrame, config: CleaningConfig) -> DataFrame:
    if config.column_nulls:
        df = nulls.apply_rules(df, config.column_nulls, key=config.key)
    return nulls.handle(df, config.nulls, key=config.key) if config.nulls else df


def masked(df: DataFrame, config: CleaningConfig) -> DataFrame:
    """The table with outlier cells blanked, as the quality figures see it."""
    if config.outliers not in (outliers.Z_SCORE, outliers.IQR):
        return df
    return outliers.handle(df, config.outliers, mode="mask", key=config.key)


def clean(df: DataFrame, config: CleaningConfig) -> DataFrame:
    """Nulls, outliers, encoding, duplicates, row norms, column scales, selection."""
    roles = Roles(config.target, config.key)
    target = roles.target_of(df)
    df = handle_nulls(prepare(df, config), config)
    if config.outliers and config.outlier_mode != "report":
        # Every later step fits on this table; it is computed once, not again for each fit.
        df = cut_lineage(outliers.handle(df, config.outliers, mode=config.outlier_mode, key=config.key))
    if config.encoder:
        df = encode.handle(df, config.encoder, [c for c in string_columns(df) if c not in (target, config.key)])
        if target in df.columns:
            df = encode.label_target(df, target)
    if config.remove_duplicates:
        df = encode.drop_duplicates(df, [c for c in df.columns if c != config.key])
    if config.normalization:
        df = scale.normalize(df, config.normalization, _features(df, target, config.key))
    if config.scaling:
        df = scale.scale(df, config.scaling, _features(df, target, config.key))
    if config.selector:
        df = select.apply(df, config.selector, target, _features(df, target, config.key))
    return df


def _features(df: DataFrame, target: str, key: str | None) -> list[str]:
    return numeric_columns(df, [c for c in (target, key) if c])
