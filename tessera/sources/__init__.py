"""Where tables come from."""

from tessera.sources.catalog import Catalog, Table

__all__ = ["Catalog", "Table"]
