"""A registry of named procedures: scripts by their SHA-1, and scalar functions for SQL."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def digest(source: str) -> str:
    return hashlib.sha1(source.encode()).hexdigest()


def reply(value: Any) -> Any:
    """A script's value as a reply: true is 1, false and none are null, numbers lose their
    fraction, a sequence ends at its first null, {ok} and {err} are a status and an error."""
    if value is None or value is False:
        return None
    if value is True:
        return 1
    if isinstance(value, float):
        return int(value)
    if isinstance(value, dict):
        if "err" in value:
            return f"ERR {value['err']}"
        if "ok" in value:
            return str(value["ok"])
    if isinstance(value, list | tuple):
        out = []
        for v in value:
            if v is None:
                break
            out.append(reply(v))
        return out
    return value


class Scripts:
    """Procedures take (session, keys, args) and compose the library's operators."""

    def __init__(self) -> None:
        self._by_sha: dict[str, Callable] = {}
        self._functions: dict[str, str] = {}

    def load(self, fn: Callable, source: str | None = None) -> str:
        sha = digest(source if source is not None else inspect.getsource(fn))
        self._by_sha[sha] = fn
        return sha

    def exists(self, *shas: str) -> list[int]:
        return [int(s.lower() in self._by_sha) for s in shas]

    def flush(self) -> None:
        self._by_sha.clear()

    def run(self, spark: SparkSession, sha: str, keys: list[str] = (), args: list[str] = ()) -> Any:
        fn = self._by_sha.get(sha.lower())
        if fn is None:
            raise KeyError("NOSCRIPT No matching script. Please use EVAL.")
        out = fn(spark, list(keys), list(args))
        return out if isinstance(out, DataFrame) else reply(out)

    def kill(self, spark: SparkSession, group: str) -> None:
        spark.sparkContext.cancelJobGroup(group)

    def load_function(self, spark: SparkSession, name: str, fn: Callable, returns: str = "bigint") -> None:
        """A scalar function under a name, for SQL."""
        spark.udf.register(name, fn, returns)
        self._functions[name] = returns

    def call(self, spark: SparkSession, name: str, *args: int) -> Any:
        if name not in self._functions:
            raise KeyError(f"ERR no such function '{name}'")
        return spark.sql(f"SELECT {name}({', '.join(str(int(a)) for a in args)}) AS v").first().v

    def list_functions(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self._functions.items()), "name string, returns string")

    def delete_function(self, spark: SparkSession, name: str) -> int:
        if self._functions.pop(name, None) is None:
            return 0
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        return 1


def parse_memory(text: str) -> int:
    """`512mb` and the like as bytes."""
    t = text.strip().lower()
    for unit, n in (("gb", 1 << 30), ("mb", 1 << 20), ("kb", 1 << 10), ("g", 1 << 30), ("m", 1 << 20), ("k", 1 << 10), ("b", 1)):
        if t.endswith(unit):
            return int(t[: -len(unit)]) * n
    return int(t)
