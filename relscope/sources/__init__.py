"""Entities, their associations and where their rows come from."""

from .catalog import Assoc, Catalog, Entity, belongs_to, has_many, has_one, many_to_many, through

__all__ = ["Assoc", "Catalog", "Entity", "belongs_to", "has_many", "has_one", "many_to_many", "through"]
