"""Datasets by name: a loader that runs when the dataset is first asked for, and facts about it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LOADERS: dict[str, Callable[..., DataFrame]] = {}
METADATA: dict[str, dict] = {}


def register_dataset(name: str, loader: Callable[..., DataFrame] | None = None, **metadata):
    """Makes ``loader(spark, **options)`` available as ``name``, with facts such as class names; a name is taken once. Also a decorator."""

    def add(f):
        if name in LOADERS:
            raise ValueError(f"dataset {name} is registered already")
        LOADERS[name], METADATA[name] = f, dict(metadata)
        return f

    return add(loader) if loader is not None else add


def load_dataset(spark: SparkSession, name: str, mapper: str | Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """The dataset as a DataFrame, after a mapper (DataFrame to DataFrame, or its registered name) where one is given."""
    if name not in LOADERS:
        raise KeyError(f"unknown dataset {name}; there are {sorted(LOADERS)}")
    df = LOADERS[name](spark, **options)
    f = MAPPERS[mapper] if isinstance(mapper, str) else mapper
    return f(df) if f else df


def as_views(spark: SparkSession, names: list[str], **options) -> None:
    """Registers datasets as views of their names for SQL."""
    for name in names:
        load_dataset(spark, name, **options).createOrReplaceTempView(name)


def metadata(name: str) -> dict:
    return METADATA[name]


MAPPERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_mapper(name: str):
    """Decorator: a function of a DataFrame that gives the rows a consumer wants becomes available to ``load_dataset``."""

    def add(f):
        MAPPERS[name] = f
        return f

    return add
