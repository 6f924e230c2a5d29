"""How operators are written and registered."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import INTERNAL, EngineError

STORAGE, DATA = "storage", "data"
#: What a model keeps of a partition at most, in values of some 8 bytes, and what it keeps of a row besides its features.
PART_VALUES, ROW_VALUES = 8 << 20, 24


@dataclass(frozen=True)
class Operator:
    """run(frames, params) -> DataFrame; multi tells whether it takes more than the first frame."""

    category: str
    name: str
    run: Callable[[list[DataFrame], dict[str, str]], DataFrame]
    description: str = ""
    position: str = DATA
    multi: bool = False
    kind: str = "builtin"
    plugin: str = ""

    @property
    def full(self) -> str:
        return f"{self.category}.{self.name}"

    def __call__(self, frames: list[DataFrame], params: dict[str, str] | None = None) -> DataFrame:
        """An operator for one frame gets the first of several."""
        return self.run(frames if self.multi else frames[:1], dict(params or {}))


@dataclass
class Registry:
    """Operators that a module defines by decorators; the last definition of a name wins."""

    found: dict[str, Operator] = field(default_factory=dict)

    def take(self) -> list[Operator]:
        out = list(self.found.values())
        self.found.clear()
        return out


DEFINED = Registry()


def operator(category: str, name: str, description: str = "", position: str = DATA, multi: bool = False, kind: str = "python") -> Callable:
    """Decorates f(df, params) -> DataFrame, or f(frames, params) if multi."""

    def wrap(f: Callable) -> Callable:
        run = f if multi else lambda frames, params: f(frames[0], params)
        DEFINED.found[f"{category.lower()}.{name.lower()}"] = Operator(category.lower(), name, run, description or (f.__doc__ or "").strip(), position, multi, kind)
        return f

    return wrap


class OperatorBase:
    """A class form: a new instance for each query, so no parameter of one query is seen by the next.

    work gets and returns a Spark DataFrame. With whole_table it gets the whole table as one pandas frame
    and returns one; then schema must be set to its columns, as `a bigint, b string`. With by_partition it gets pandas batches.
    """

    schema: str | None = None
    whole_table = by_partition = False

    def __init__(self) -> None:
        self.config: dict[str, str] = {}

    def configure(self, key: str, value: str) -> None:
        self.config[key] = value

    def get_config(self, key: str, default: str | None = None) -> str | None:
        return self.config.get(key, default)

    def work(self, df):
        raise NotImplementedError


def frame_operator(category: str, name: str, description: str = "", position: str = DATA) -> Callable[[type], type]:
    """Registers a subclass of OperatorBase."""

    def wrap(cls: type) -> type:
        if not issubclass(cls, OperatorBase):
            raise TypeError(f"{cls.__name__} must be a subclass of OperatorBase")

        def run(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
            made = cls()
            for k, v in params.items():
                made.configure(k, v)
            return _run(made, frames[0])

        DEFINED.found[f"{category.lower()}.{name.lower()}"] = Operator(category.lower(), name, run, description, position, False, "python")
        return cls

    return wrap


def _run(made: OperatorBase, df: DataFrame) -> DataFrame:
    if not (made.whole_table or made.by_partition):
        return made.work(df)
    schema = made.schema or df.schema
    if made.by_partition:

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield made.work(part)

        return df.mapInPandas(batches, schema)
    # One group by contract: the code sees the whole table at once.
    return df.withColumn("_whole", F.lit(1)).groupBy("_whole").applyInPandas(lambda part: made.work(part.drop(columns="_whole")), schema)


def flag(value: str | None) -> bool:
    return str(value).lower() in ("1", "true")


def number(params: dict[str, str], key: str, default: float) -> float:
    try:
        return float(params.get(key, default))
    except ValueError:
        raise EngineError(f"parameter {key} must be a number, got: {params[key]}") from None


def columns_of(df: DataFrame, params: dict[str, str], key: str = "columns", numeric: bool = True) -> list[str]:
    """Columns named in a parameter, separated by commas or semicolons; else all, or all numeric ones."""
    named = [c.strip() for c in params.get(key, "").replace(";", ",").split(",") if c.strip()]
    for c in named:
        require(df, c)
    return named or [c for c, t in df.dtypes if not numeric or is_numeric(t)]


def dealt(df: DataFrame, rows: int, features: int) -> DataFrame:
    """df in partitions of a bounded number of rows, for models that keep rows in memory and go through them again and again; those of an input grow with it."""
    parts = -(-rows * (features + ROW_VALUES) // PART_VALUES)
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism)) if parts > 1 else df


def require(df: DataFrame, column: str) -> str:
    if column not in df.columns:
        raise EngineError(f"column not found: {column}", INTERNAL)
    return column


def is_numeric(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
