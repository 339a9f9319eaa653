"""An environment: a named set of tables with declared keys and links."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.names import DEFAULT_POLICY, NamePolicy
from plumbline.session import configure


@dataclass(frozen=True)
class Link:
    """``table.column`` points at ``ref_table.ref_column``."""

    table: str
    column: str
    ref_table: str
    ref_column: str
    how: str = "configured link"


def _kept(load: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """A loader that looks for files and reads the schema the first time only."""
    return lru_cache(maxsize=1)(load)


@dataclass(frozen=True)
class Env:
    """Tables are looked up when they are first asked for; files that change afterwards need a new environment."""

    spark: SparkSession
    loaders: dict[str, Callable[[], DataFrame]]
    name: str = "default"
    keys: dict[str, str] = field(default_factory=dict)
    links: tuple[Link, ...] = ()
    policy: NamePolicy = DEFAULT_POLICY

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, tables: Iterable[str], **options) -> "Env":
        """Tables stored as ``<path>/<table>.parquet`` (a file or a folder)."""
        configure(spark)
        return cls(spark, {t: _kept(lambda t=t: spark.read.parquet(f"{path}/{t}.parquet")) for t in tables}, **options)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str, **options) -> "Env":
        """All tables of a catalog schema."""
        configure(spark)
        names = [t.name for t in spark.catalog.listTables(database)]
        return cls(spark, {t: _kept(lambda t=t: spark.table(f"`{database}`.`{t}`")) for t in names}, **options)

    @property
    def tables(self) -> list[str]:
        return sorted(self.loaders)

    def table(self, name: str) -> DataFrame:
        if name not in self.loaders:
            raise KeyError(f"no table named {name!r} in environment {self.name!r}")
        return self.loaders[name]()

    def safe_table(self, name: str) -> DataFrame:
        """Every column except the secret-named ones; the scan never reads those."""
        df = self.table(name)
        return df.select(*[f"`{c}`" for c in self.policy.safe(df.columns)])

    @contextmanager
    def as_views(self, tables: Iterable[str] | None = None) -> Iterator[SparkSession]:
        """The session with tables of the environment as temporary views; views of the caller come back afterwards."""
        named = list(self.tables if tables is None else tables)
        temporary = {t.name.lower() for t in self.spark.catalog.listTables() if t.isTemporary}
        held = {t: self.spark.table(f"`{t}`") for t in named if t.lower() in temporary}
        try:
            for t in named:
                self.table(t).createOrReplaceTempView(f"`{t}`")
            yield self.spark
        finally:
            for t in named:
                if t in held:
                    held[t].createOrReplaceTempView(f"`{t}`")
                else:
                    self.spark.catalog.dropTempView(t)

    @contextmanager
    def isolated(self, tables: Iterable[str] | None = None) -> Iterator[SparkSession]:
        """A session of its own, with the settings of this one, in which tables of the environment are temporary views.

        Views of the caller and of other batches are neither seen nor replaced.
        """
        tag, named = f"batch_{uuid.uuid4().hex}", list(self.tables if tables is None else tables)
        session = self.spark.newSession()
        for row in self.spark.sql("SET").collect():
            if session.conf.isModifiable(row["key"]):
                session.conf.set(row["key"], row["value"])
        try:
            for i, t in enumerate(named):
                self.table(t).createGlobalTempView(f"{tag}_{i}")
                session.sql(f"CREATE TEMPORARY VIEW `{t}` AS SELECT * FROM global_temp.`{tag}_{i}`")
            yield session
        finally:
            for i in range(len(named)):
                self.spark.catalog.dropGlobalTempView(f"{tag}_{i}")

    def with_tables(self, name: str | None = None, drop: Iterable[str] = (), **frames: DataFrame) -> "Env":
        """The same environment with some tables replaced, added or dropped."""
        loaders = {t: f for t, f in self.loaders.items() if t not in set(drop)}
        for table, df in frames.items():
            loaders[table] = lambda df=df: df
        return replace(self, loaders=loaders, name=name or self.name)

    def only(self, *tables: str) -> "Env":
        return replace(self, loaders={t: self.loaders[t] for t in tables})

    def links_from(self, table: str) -> list[Link]:
        return [k for k in self.links if k.table == table]

    def links_to(self, table: str) -> list[Link]:
        return [k for k in self.links if k.ref_table == table]
