"""Facts from documents that arrive in pieces: nothing is inserted before ``finish``, then all of it at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.session import Session
from . import readers


class Feed:
    """``form``: json, yaml, csv or xml; ``path`` picks facts within JSON and YAML documents."""

    def __init__(self, session: Session, kind: str, form: str, path: str = "$", first: bool = False, entry_point: str | None = None, max_bytes: int = 64 << 20):
        if form not in ("json", "yaml", "csv", "xml"):
            raise ValueError(f"unknown form {form!r}")
        self.session, self.kind, self.form, self.path, self.first = session, kind, form, path, first
        self.entry_point, self.max_bytes = entry_point, max_bytes
        self.parts: list[bytes] = []
        self.open = True

    def feed(self, chunk: str | bytes) -> Feed:
        """Adds a piece; it may end within a character."""
        if not self.open:
            raise ValueError("the feed is finished")
        self.parts.append(chunk.encode() if isinstance(chunk, str) else bytes(chunk))
        if sum(map(len, self.parts)) > self.max_bytes:
            raise ValueError(f"more than {self.max_bytes} bytes: read the files with the session's spark instead")
        return self

    def cancel(self) -> None:
        self.open, self.parts = False, []

    def finish(self) -> DataFrame:
        """Parses and inserts; a document that does not parse inserts nothing."""
        if not self.open:
            raise ValueError("the feed is finished")
        self.open = False
        text = b"".join(self.parts).decode()
        spark, schema = self.session.spark, self.session.kb.schemas[self.session.kb.resolve(self.kind)]
        doc = spark.createDataFrame([(text,)], "doc string")
        if self.form in ("json", "yaml"):
            read = readers.json_facts if self.form == "json" else readers.yaml_facts
            facts = read(doc, "doc", schema, self.path, self.first)
        elif self.form == "xml":
            facts = readers.xml_column(doc, "doc", schema)
        else:
            import csv
            import io

            from pyspark.sql import functions as F

            rows = list(csv.DictReader(io.StringIO(text)))
            names = [f.name for f in schema.fields]
            cells = spark.createDataFrame([tuple(r.get(n) or None for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))
            facts = cells.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        return self.session.insert(self.kind, facts.coalesce(1), self.entry_point)
