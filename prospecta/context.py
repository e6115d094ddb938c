"""Workspaces: every tenant relation is read under one, or with a stated reason under none."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_current: ContextVar[Workspace | None] = ContextVar("workspace", default=None)
_unscoped: ContextVar[str | None] = ContextVar("unscoped", default=None)
#: What a workspace id may look like: UUID, ULID, a positive number, or a short key.
_ID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9A-HJKMNP-TV-Z]{26}|[1-9][0-9]*|w[0-9]+")


class MissingWorkspace(RuntimeError):
    """A tenant relation was read without a workspace."""


@dataclass(frozen=True)
class Workspace:
    id: str

    def __post_init__(self) -> None:
        if not _ID.fullmatch(self.id):
            raise ValueError(f"not a workspace id: {self.id!r}")

    def scope(self, df: DataFrame) -> DataFrame:
        """Rows of this workspace; the predicate reaches the Parquet scan."""
        return df.where(F.col("workspace_id") == self.id)

    @contextmanager
    def use(self) -> Iterator[Workspace]:
        token = _current.set(self)
        try:
            yield self
        finally:
            _current.reset(token)


@contextmanager
def without_scope(why: str) -> Iterator[None]:
    """A block that may read across workspaces; it must say why."""
    if not why.strip():
        raise ValueError("reading across workspaces needs a reason")
    token = _unscoped.set(why)
    try:
        yield
    finally:
        _unscoped.reset(token)


def table(spark: SparkSession, path: str, live_only: bool = True) -> DataFrame:
    """A tenant table under the current workspace; rows with a deletion time are left out unless asked for."""
    df = spark.read.parquet(path)
    if _current.get() is not None:
        df = _current.get().scope(df)
    elif _unscoped.get() is None:
        raise MissingWorkspace(f"no workspace is set for {path}")
    return df.where(F.col("deleted_at").isNull()) if live_only and "deleted_at" in df.columns else df
