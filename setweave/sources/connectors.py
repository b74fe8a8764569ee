"""Annotation providers behind one interface, with a cache of what has been fetched."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass
class Provider:
    """Annotations from a table (offline), or from a function of a list of ids that returns (id, term, name) rows.

    The function runs in the tasks, ``batch`` ids a call, at most ``per_second`` calls a second in each,
    and is tried ``tries`` times.
    """

    name: str
    table: DataFrame | None = None
    fetch: Callable[[list[str]], list[tuple[str, str, str]]] | None = None
    batch: int = 20
    per_second: float = 3.0
    tries: int = 3

    def annotate(self, ids: DataFrame) -> DataFrame:
        """(id, term, name) of the ids; ids without annotations give no rows."""
        if self.table is not None:
            return self.table.join(ids.select("id").distinct(), "id", "left_semi").select("id", "term", "name")
        if self.fetch is None:
            raise ValueError(f"{self.name} has neither a table nor a function")
        fetch, batch, pause, tries = self.fetch, self.batch, 1 / self.per_second, self.tries

        def call(frames: Iterator) -> Iterator:
            import pandas as pd

            for frame in frames:
                todo = frame["id"].tolist()
                for k in range(0, len(todo), batch):
                    for n in range(tries):
                        began = time.monotonic()
                        try:
                            rows = fetch(todo[k : k + batch])
                            break
                        except OSError:
                            if n == tries - 1:
                                raise
                            time.sleep(pause * 2**n)
                    time.sleep(max(0.0, pause - (time.monotonic() - began)))
                    yield pd.DataFrame(rows, columns=["id", "term", "name"])

        return ids.select("id").distinct().mapInPandas(call, "id string, term string, name string")


def cached(provider: Provider, ids: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Annotations of ``ids``: what the cache has, and what only has to be fetched for the rest."""
    if cache is None:
        return provider.annotate(ids)
    missing = ids.join(cache.select("id").distinct(), "id", "left_anti")
    return cache.join(ids.select("id").distinct(), "id", "left_semi").select("id", "term", "name").unionByName(provider.annotate(missing))


def batched_prompts(context: DataFrame, generate: Callable[[list[str]], list[str]] | None = None, column: str = "prompt") -> DataFrame:
    """Adds summary: a model's answer to each prompt, or, without a model, the prompt's first sentence."""
    if generate is None:
        return context.withColumn("summary", F.trim(F.regexp_extract(column, r"^[^.\n]*", 0)))

    @F.pandas_udf("string")
    def answer(prompts):
        import pandas as pd

        return pd.Series(generate(prompts.tolist()))

    return context.withColumn("summary", answer(F.col(column)))
