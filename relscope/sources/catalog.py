"""Entities over Parquet files, tables or given DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import UnknownFieldError


@dataclass(frozen=True)
class Assoc:
    """kind: one (the owner holds the key), has_one, many, through or m2m."""

    kind: str
    target: str
    owner_key: str = ""
    related_key: str = ""
    via: tuple[str, ...] = ()  # through: associations to follow; m2m: join table, its owner key, its target key


def belongs_to(target: str, key: str, related: str) -> Assoc:
    return Assoc("one", target, key, related)


def has_one(target: str, key: str, related: str) -> Assoc:
    return Assoc("has_one", target, key, related)


def has_many(target: str, key: str, related: str) -> Assoc:
    return Assoc("many", target, key, related)


def through(target: str, *path: str) -> Assoc:
    return Assoc("through", target, via=path)


def many_to_many(target: str, key: str, related: str, join_table: str, join_owner: str, join_target: str) -> Assoc:
    return Assoc("m2m", target, key, related, (join_table, join_owner, join_target))


@dataclass
class Entity:
    name: str
    key: tuple[str, ...]
    assocs: dict[str, Assoc] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    order: tuple[str, ...] = ()

    def __post_init__(self):
        self.order = self.order or self.key


class Catalog:
    """Entities by name. A source is a path of Parquet files, a function of the session, or a DataFrame."""

    def __init__(self, spark: SparkSession, one_join: str = "inner"):
        self.spark, self.one_join = spark, one_join
        self.entities: dict[str, Entity] = {}
        self.sources: dict[str, str | DataFrame | Callable[[SparkSession], DataFrame]] = {}
        self._frames: dict[str, DataFrame] = {}

    def add(self, entity: Entity, source) -> Catalog:
        self.entities[entity.name] = entity
        self.sources[entity.name] = source
        return self

    def frame(self, name: str) -> DataFrame:
        if name not in self.entities:
            raise UnknownFieldError(f"{name} is no entity; there are {', '.join(sorted(self.entities))}")
        if name not in self._frames:
            source = self.sources[name]
            self._frames[name] = self.spark.read.parquet(source) if isinstance(source, str) else source(self.spark) if callable(source) else source
        return self._frames[name]

    def fields(self, name: str) -> dict[str, str]:
        return dict(self.frame(name).dtypes)

    def assoc(self, name: str, key: str) -> Assoc | None:
        return self.entities[name].assocs.get(key)

    def check(self, name: str, key: str) -> None:
        if key not in self.fields(name) and key not in self.entities[name].assocs:
            raise UnknownFieldError(f"{name} has neither field nor association {key}; fields: {', '.join(self.fields(name))}; associations: {', '.join(self.entities[name].assocs)}")

    def scope(self, name: str):
        from ..plans.scope import Scope

        return Scope.of(self, name)

    __call__ = scope
