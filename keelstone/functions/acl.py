"""Access rules of users, from rule tokens to rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "user string, enabled boolean, role string, is_admin boolean, read_only boolean, password string, patterns array<string>"


@dataclass
class User:
    name: str
    enabled: bool = False
    role: str = "readwrite"
    password: str | None = None
    patterns: list[str] = field(default_factory=lambda: ["*"])

    def apply(self, tokens: list[str]) -> None:
        """on, off, >password, ~pattern (the first one replaces all), admin, +@all, readwrite, +@write, readonly, +@read."""
        named = False
        for t in tokens:
            low = t.lower()
            if low in ("on", "off"):
                self.enabled = low == "on"
            elif t[:1] == ">":
                self.password = sha256(t[1:].encode()).hexdigest()
            elif t[:1] == "~":
                self.patterns = [*(self.patterns if named else []), t[1:]]
                named = True
            elif low in ("admin", "+@all"):
                self.role = "admin"
            elif low in ("readwrite", "+@write"):
                self.role = "readwrite"
            elif low in ("readonly", "+@read"):
                self.role = "readonly"
            else:
                raise ValueError(f"ERR unknown rule '{t}'")


class Users:
    """A small registry; the default user is an administrator and cannot be deleted."""

    def __init__(self) -> None:
        self._by: dict[str, User] = {"default": User("default", True, "admin")}

    def set_user(self, name: str, *tokens: str) -> None:
        self._by.setdefault(name, User(name)).apply(list(tokens))

    def delete_user(self, *names: str) -> int:
        return sum(n != "default" and self._by.pop(n, None) is not None for n in names)

    def names(self) -> list[str]:
        return sorted(self._by)

    def describe(self, name: str) -> str:
        u = self._by[name]
        return f"user {u.name} {'on' if u.enabled else 'off'} {u.role} {' '.join('~' + p for p in u.patterns)}"

    def authenticate(self, name: str, password: str) -> bool:
        u = self._by.get(name)
        return bool(u and u.enabled and (u.password is None or u.password == sha256(password.encode()).hexdigest()))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(u.name, u.enabled, u.role, u.role == "admin", u.role == "readonly", u.password, u.patterns) for u in self._by.values()], SCHEMA)
