"""A preparation plan: named steps with parameters, folded over a table.

Any order of steps is allowed. Steps are plain data, so a recipe can be kept
as JSON beside the tables it made.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tabwright.operators import dedup, features, filters, missing, outliers, scaling, text

STEPS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        filters.filter_categorical,
        filters.filter_range,
        filters.drop_columns,
        filters.select_numeric,
        filters.select_categorical,
        filters.first_numeric,
        missing.standardize_missing,
        missing.fill_mean,
        missing.fill_median,
        missing.fill_zero,
        missing.fill_constant,
        missing.fill_mode,
        missing.fill_unknown,
        missing.forward_fill,
        missing.backward_fill,
        missing.drop_missing_rows,
        missing.drop_sparse_columns,
        missing.impute_all,
        text.standardize_column_names,
        text.trim_text,
        text.lower_text,
        text.strip_characters,
        text.auto_numeric,
        text.format_standardize,
        text.remap_value,
        text.remap_values,
        text.to_numeric,
        text.to_boolean,
        text.to_text,
        dedup.drop_duplicates,
        outliers.iqr_remove,
        outliers.iqr_cap,
        outliers.zscore_remove,
        outliers.zscore_cap,
        outliers.percentile_cap,
        scaling.standard_scale,
        scaling.minmax_scale,
        scaling.one_hot,
        scaling.label_encode,
        features.log,
        features.log1p,
        features.sqrt,
        features.square,
        features.zscore,
        features.minmax,
        features.binning,
        features.add,
        features.multiply,
        features.ratio,
        features.to_datetime,
        features.date_part,
    )
}


@dataclass(frozen=True)
class Recipe:
    steps: list[tuple[str, dict[str, Any]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        unknown = [name for name, _ in self.steps if name not in STEPS]
        if unknown:
            raise ValueError(f"unknown steps: {', '.join(unknown)}")

    def then(self, name: str, **params: Any) -> "Recipe":
        return Recipe([*self.steps, (name, params)])

    def run(self, df: DataFrame) -> DataFrame:
        for name, params in self.steps:
            df = STEPS[name](df, **params)
        return df

    def to_json(self) -> str:
        return json.dumps([{"step": n, "params": p} for n, p in self.steps])

    @staticmethod
    def from_json(text: str) -> "Recipe":
        return Recipe([(s["step"], s["params"]) for s in json.loads(text)])

    @staticmethod
    def of(steps: Iterable[tuple[str, dict[str, Any]]]) -> "Recipe":
        return Recipe(list(steps))
