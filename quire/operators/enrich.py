"""Steps that need a model, as batch stages over rows with an offline default."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Client(Protocol):
    def chat(self, prompt: str) -> str: ...

    def count_tokens(self, text: str) -> int: ...


class Offline:
    """Answers with the start of what it is asked about."""

    def chat(self, prompt: str) -> str:
        body = prompt.rpartition("\n\n")[2]
        return body if len(body) < 50 else body[:200] + "..."

    def count_tokens(self, text: str) -> int:
        return len(text) // 4


_CLIENTS: dict[str, Callable[..., Client]] = {"offline": Offline}


def register(name: str, make: Callable[..., Client]) -> None:
    _CLIENTS[name] = make


def client(name: str = "offline", **options) -> Client:
    if name not in _CLIENTS:
        from quire.operators import clients  # noqa: F401  # brings its own names
    if name not in _CLIENTS:
        raise ValueError(f"no client {name!r}; there are {sorted(_CLIENTS)}")
    return _CLIENTS[name](**options)


def retried(call: Callable[[], str], attempts: int = 3, pause: float = 1.0) -> str:
    for left in range(attempts - 1, -1, -1):
        try:
            return call()
        except Exception:
            if not left:
                raise
            time.sleep(pause)
    raise AssertionError


def answered(rows: DataFrame, column: str, out: str, prompt: str, make: Callable[[], Client] = Offline, least: int = 50, attempts: int = 3) -> DataFrame:
    """``rows`` with ``out``: the client's answer about a text, or the text itself if it is under ``least`` characters; null stays null."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = make()
        for batch in batches:
            ask = lambda t: None if t is None else t if len(t) < least else retried(lambda: one.chat(f"{prompt}\n\n{t}"), attempts)  # noqa: B023,E731
            yield batch.assign(**{out: [ask(t) for t in batch[column]]})

    return rows.mapInPandas(run, schema)


def summaries(nodes: DataFrame, text: str = "text", **options) -> DataFrame:
    return answered(nodes, text, "summary", "Summarise this part of a document.", **options)


def translated(nodes: DataFrame, columns: list[str], language: str, **options) -> DataFrame:
    for c in columns:
        nodes = answered(nodes, c, f"{c}_{language}", f"Translate into {language}.", least=1, **options)
    return nodes
