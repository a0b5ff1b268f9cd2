"""The feature plan: impute, dates, text, encode, scale, generate, select."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablewright.operators.dates import date_features
from tablewright.operators.encode import FittedEncoder, fit_by_cardinality
from tablewright.operators.generate import generate_features
from tablewright.operators.impute import fit_chained, fit_fill, fit_neighbours
from tablewright.operators.scale import fit_scaler
from tablewright.operators.schema import datetime_columns, numeric_columns, string_columns
from tablewright.operators.select import select_features
from tablewright.operators.text import FittedText, detect_text_columns, fit_text
from tablewright.session import hold
from tablewright.sources.stored_plans import storable


@storable
@dataclass(frozen=True)
class FeatureOptions:
    """What each stage does; ``key`` and ``passthrough`` columns are carried along."""

    numeric_impute: str = "median"
    categorical_impute: str = "most_frequent"
    fill_value: object = None
    low_encoding: str = "target"
    high_encoding: str = "target"
    cardinality_threshold: int = 20
    scaling: str = "robust"
    dates: bool = True
    text: bool = True
    text_exclude: tuple[str, ...] = ()
    text_features: int = 500
    generate: bool = True
    degree: int = 2
    select: bool = True
    selection: str = "mutual_info"
    max_features: int = 50

    @classmethod
    def from_config(cls, config: dict) -> "FeatureOptions":
        """Options from a plain mapping; unknown names are an error."""
        known = set(cls.__dataclass_fields__)
        unknown = set(config) - known
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return cls(**config)


@storable
@dataclass(frozen=True)
class FittedFeatures:
    """Fitted stages; transforming is a chain of projections and bounded joins."""

    inputs: tuple[str, ...]
    carried: tuple[str, ...]
    key: str | None
    options: FeatureOptions
    fill: object
    dates: tuple[str, ...]
    texts: tuple[FittedText, ...]
    encoders: tuple[FittedEncoder, ...]
    scaler: object
    generated: bool
    outputs: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        absent = [c for c in self.inputs if c not in df.columns]
        if absent:
            raise ValueError(f"columns missing at transform time: {absent}")
        carried = [c for c in self.carried if c in df.columns]
        out = _prepare(df.select(*carried, *self.inputs), self)
        if self.generated:
            out = _generate(out, carried, self.options)
        return out.select(*carried, *self.outputs)


def _generate(df: DataFrame, carried: Sequence[str], options: FeatureOptions) -> DataFrame:
    return generate_features(df, [c for c in numeric_columns(df) if c not in carried], options.degree)


def _prepare(df: DataFrame, fitted: FittedFeatures) -> DataFrame:
    """All stages before generation."""
    out = fitted.fill.transform(df)
    if fitted.dates:
        out = date_features(out, fitted.dates)
    for text in fitted.texts:
        wide = text.wide(text.tfidf(out, fitted.key), fitted.key)
        names = [c for c in wide.columns if c != fitted.key]
        out = out.join(wide, fitted.key, "left").fillna(0.0, names).drop(text.column)
    for encoder in fitted.encoders:
        out = encoder.transform(out)
    return fitted.scaler.transform(out)


def fit_features(
    df: DataFrame,
    target: str | None = None,
    classification: bool = False,
    options: FeatureOptions = FeatureOptions(),
    key: str | None = None,
    passthrough: Sequence[str] = (),
) -> FittedFeatures:
    """Fit stage by stage on one table, each stage on the output of those before."""
    carried = [c for c in (key, target, *passthrough) if c]
    carried = list(dict.fromkeys(carried))
    inputs = [c for c in df.columns if c not in carried]
    # Every stage reads the rows several times; they may come out of joins.
    base = hold(df.select(*carried, *inputs))
    if options.numeric_impute == "knn":
        fill = _Chain((fit_neighbours(base, [c for c in numeric_columns(base) if c in inputs]),
                       fit_fill(base, "none", options.categorical_impute, options.fill_value, inputs)))
    elif options.numeric_impute == "iterative":
        fill = _Chain((fit_chained(base, [c for c in numeric_columns(base) if c in inputs]),
                       fit_fill(base, "none", options.categorical_impute, options.fill_value, inputs)))
    else:
        fill = fit_fill(base, options.numeric_impute, options.categorical_impute, options.fill_value, inputs)
    out = fill.transform(base)

    dates = tuple(c for c in datetime_columns(out) if c in inputs) if options.dates else ()
    if dates:
        out = date_features(out, dates)
    texts: list[FittedText] = []
    text_names = [c for c in string_columns(out) if c in inputs and c not in options.text_exclude]
    if options.text and text_names:
        if key is None:
            raise ValueError("text features need a key column")
        found = detect_text_columns(out.select(*text_names)).where("is_text").collect()
        for row in found:
            fitted_text = fit_text(out, row["column"], max_features=options.text_features)
            wide = fitted_text.wide(fitted_text.tfidf(out, key), key)
            names = [c for c in wide.columns if c != key]
            out = out.join(wide, key, "left").fillna(0.0, names).drop(row["column"])
            texts.append(fitted_text)
    encoders: list[FittedEncoder] = []
    categories = [c for c in string_columns(out) if c in inputs]
    if categories:
        numeric_target = target if target in numeric_columns(out) else None
        low, high = options.low_encoding, options.high_encoding
        if numeric_target is None:       # class names have no mean to encode by
            low, high = ("ordinal" if s in ("target", "woe") else s for s in (low, high))
        encoders = fit_by_cardinality(out, low, high, numeric_target, categories, options.cardinality_threshold)
        for encoder in encoders:
            out = encoder.transform(out)
    booleans = [c for c, t in out.dtypes if t == "boolean" and c not in carried]
    if booleans:
        raise ValueError(f"cast boolean columns to int first: {booleans}")
    # Scaling and generation are cheap projections; what comes before is read many times.
    held = out = hold(out)
    scaler = fit_scaler(out, options.scaling, [c for c in numeric_columns(out) if c not in carried])
    out = scaler.transform(out)
    if options.generate:
        out = _generate(out, carried, options)
    outputs = [c for c in numeric_columns(out) if c not in carried]
    if options.select and target is not None:
        chosen = set(select_features(out, target, classification, options.selection, outputs,
                                     max_features=options.max_features))
        outputs = [c for c in outputs if c in chosen]
    held.unpersist()
    base.unpersist()
    return FittedFeatures(tuple(inputs), tuple(carried), key, options, fill, dates, tuple(texts),
                          tuple(encoders), scaler, options.generate, tuple(outputs))


@storable
@dataclass(frozen=True)
class _Chain:
    parts: tuple[object, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        for part in self.parts:
            df = part.transform(df)
        return df
