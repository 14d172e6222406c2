"""Declared index schemas: builder, checks, fingerprint."""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import types as T

from quillmill.functions.scalars import fnv1a31

#: Column types and what they are in Spark.
TYPES = {"TEXT": T.StringType(), "INTEGER": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}
IDENTIFIER = re.compile(r"[a-z_]+")


@dataclasses.dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    key: bool = False


#: Columns that every index has.
BASE = (
    Field("id", "TEXT", True, True), Field("short_id", "TEXT", True), Field("path", "TEXT", True), Field("mtime_ns", "INTEGER", True), Field("size_bytes", "INTEGER", True), Field("title", "TEXT", True),
)


class SchemaError(ValueError):
    pass


@dataclasses.dataclass(frozen=True)
class Schema:
    """An index schema.  Every method returns a new one."""

    name: str = "documents"
    fields: tuple[Field, ...] = BASE
    indexes: tuple[tuple[tuple[str, ...], bool], ...] = ((("short_id",), False),)

    def table(self, name: str) -> Schema:
        return dataclasses.replace(self, name=name)

    def _with(self, name: str, kind: str, required: bool) -> Schema:
        return dataclasses.replace(self, fields=(*self.fields, Field(name, kind, required)))

    def text(self, name: str, required: bool = False) -> Schema:
        return self._with(name, "TEXT", required)

    def integer(self, name: str, required: bool = False) -> Schema:
        return self._with(name, "INTEGER", required)

    def real(self, name: str, required: bool = False) -> Schema:
        return self._with(name, "REAL", required)

    def blob(self, name: str, required: bool = False) -> Schema:
        return self._with(name, "BLOB", required)

    def retyped(self, name: str, kind: str) -> Schema:
        return dataclasses.replace(self, fields=tuple(dataclasses.replace(f, type=kind) if f.name == name else f for f in self.fields))

    def index(self, *columns: str, unique: bool = False) -> Schema:
        return dataclasses.replace(self, indexes=(*self.indexes, (columns, unique)))

    @property
    def custom(self) -> list[str]:
        return [f.name for f in self.fields[len(BASE) :]]

    def check(self) -> Schema:
        """Raises SchemaError for the first fault."""
        if not IDENTIFIER.fullmatch(self.name):
            raise SchemaError(f"invalid table name {self.name!r}")
        names: set[str] = set()
        for f in self.fields:
            if not IDENTIFIER.fullmatch(f.name):
                raise SchemaError(f"invalid column name {f.name!r}")
            if f.type not in TYPES:
                raise SchemaError(f"unknown type {f.type!r}")
            if f.name in names:
                raise SchemaError(f"duplicate column {f.name!r}")
            names.add(f.name)
        for f in BASE:
            if f.name not in names:
                raise SchemaError(f"missing required column {f.name!r}")
        for columns, _ in self.indexes:
            for c in columns:
                if c not in names:
                    raise SchemaError(f"index references unknown column {c!r}")
        return self

    def fingerprint(self) -> int:
        """A number of 31 bits that the order of columns and indexes does not change."""
        parts = sorted(f"{f.name}\t{f.type}\t{f.required:d}\t{f.key:d}" for f in self.fields)
        parts += sorted(f"{','.join(columns)}\t{unique:d}" for columns, unique in self.indexes)
        return fnv1a31("\n".join([self.name, *parts]))

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, TYPES[f.type], not f.required) for f in self.fields])

    def ddl(self) -> str:
        """The schema as a CREATE TABLE statement, for people to read."""
        lines = [f"    {f.name} {f.type}" + (" PRIMARY KEY" if f.key else " NOT NULL" if f.required else "") for f in self.fields]
        return f"CREATE TABLE {self.name} (\n" + ",\n".join(lines) + "\n)"
