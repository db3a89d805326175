"""Models held by Python workers: loaded once in each, asked in batches of texts of like length."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame

_loaded: dict[str, Callable[[list[str]], list]] = {}


@dataclass(frozen=True)
class Model:
    """``load`` gives a function from a list of texts to a list of results; ``name`` tells models apart."""

    name: str
    load: Callable[[], Callable[[list[str]], list]]
    #: Spark SQL type of a result.
    result: str = "double"
    batch: int = 128

    def held(self) -> Callable[[list[str]], list]:
        """This worker's model; loaded when it is first asked for."""
        if self.name not in _loaded:
            _loaded[self.name] = self.load()
        return _loaded[self.name]

    def of(self, texts: pd.Series) -> pd.Series:
        """Results of texts (null: none), ``batch`` at a time, in the order of their lengths, so that little is padded."""
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        some = np.flatnonzero(texts.notna().to_numpy())
        order = some[np.argsort(texts.iloc[some].str.len().to_numpy(), kind="stable")]
        for at in range(0, len(order), self.batch):
            part = order[at : at + self.batch]
            for i, value in zip(part, self.held()(texts.iloc[part].tolist())):
                out.iloc[i] = value
        return out


def with_result(rows: DataFrame, text: str, model: Model, to: str, profile: ResourceProfile | None = None) -> DataFrame:
    """Adds the model's result for a text column; ``profile`` asks for executors with, say, an accelerator for this stage alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{to: model.of(b[text])})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, `{to}` {model.result}", profile=profile)
