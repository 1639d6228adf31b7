"""Typed access to a query's matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {"string": "string", "double": "double", "int": "long", "long": "long", "uint64": "decimal(20,0)", "bytes": "binary", "bool": "boolean", "enum": "string"}


class Results:
    """Rows of matches: a struct for each binding.  Nothing is collected but what is asked for."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def first(self):
        """The first row, or None."""
        got = self.df.limit(1).collect()
        return got[0] if got else None

    def single(self):
        """The only row; raises unless there is exactly one."""
        got = self.df.limit(2).collect()
        if len(got) != 1:
            raise ValueError(f"expected one row, found {'none' if not got else 'more'}")
        return got[0]

    def column(self, binding: str) -> DataFrame:
        """The facts of a binding."""
        return self.df.select(f"{binding.lstrip('$')}.*")

    def field(self, binding: str, name: str, kind: str | None = None) -> DataFrame:
        """A field of a binding, as a kind; a fraction for a whole kind raises."""
        col = F.col(binding.lstrip("$")).getField(name)
        if kind in ("int", "long") and self.column(binding).schema[name].dataType.simpleString() in ("double", "float"):
            col = F.when(col == F.floor(col), col).when(col.isNotNull(), F.raise_error(F.lit(f"{name} is no whole number")))
        return self.df.select((col.cast(KINDS[kind]) if kind else col).alias(name))
