"""Statements in SQL over named tables: queries, data changes, and changes of the catalog.

Queries go to Spark's own parser, after three forms that it lacks are written out: BETWEEN SYMMETRIC,
GROUP BY (), and HAVING without GROUP BY or aggregate, which selects rows. Times of day are strings, so
TIME literals are string literals. Data changes make a new table from the old one: a session's tables
are DataFrames by name, and no stored file is altered.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.catalog import Catalog, ColumnMeta, ForeignKey, IndexMeta, TableMeta
from sparkloom.operators import access
from sparkloom.sources.shared import stored
from sparkloom.types import DataType

#: Changes of a table after which it is written, so that its plan doesn't grow for ever.
CHANGES = 8
#: The catalog as tables.
SYSTEM = ("sys_tables", "sys_columns", "sys_constraints", "sys_indexes")
_OPERAND = r"(?:'(?:[^']|'')*'|\([^()]*\)|[\w.+-]+(?:\([^()]*\))?)"
_SYMMETRIC = re.compile(rf"\bBETWEEN\s+SYMMETRIC\s+({_OPERAND})\s+AND\s+({_OPERAND})", re.I)
_AGGREGATE = re.compile(r"\b(count|sum|avg|min|max)\s*\(", re.I)
_QUOTED = re.compile(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", re.S)


class StatementError(ValueError):
    pass


def statements(text: str) -> list[str]:
    """A script's statements, without comments."""
    bare = _QUOTED.sub(lambda m: m[0] if m[0][0] == "'" else " ", text)
    return [s.strip() for s in _split(bare, ";") if s.strip()]


def _split(text: str, sign: str) -> list[str]:
    """Parts between ``sign`` outside of quotes and parentheses."""
    out, depth, at, quoted = [], 0, 0, False
    for k, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == sign and not depth:
                out.append(text[at:k])
                at = k + 1
    return [*out, text[at:]]


def standard(query: str) -> str:
    """A query in forms that Spark parses."""
    query = _SYMMETRIC.sub(r"BETWEEN least(\1, \2) AND greatest(\1, \2)", query)
    query = re.sub(r"\bGROUP\s+BY\s*\(\s*\)", "", query, flags=re.I)
    query = re.sub(r"\bTIME\s+(?=')", "", query, flags=re.I)
    if re.search(r"\bHAVING\b", query, re.I) and not re.search(r"\bGROUP\s+BY\b", query, re.I) and not _AGGREGATE.search(query):
        query = re.sub(r"\bHAVING\b", "AND" if re.search(r"\bWHERE\b", query, re.I) else "WHERE", query, flags=re.I)
    return query


class Session:
    """Named tables, their catalog, and statements over both."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, catalog: Catalog | None = None):
        self.spark, self.tables, self.catalog = spark, dict(tables or {}), catalog or Catalog()
        self._changes: dict[str, int] = {}

    def script(self, text: str) -> DataFrame | None:
        """Run all statements; the result of the last one."""
        out = None
        for s in statements(text):
            out = self.run(s)
        return out

    def run(self, text: str) -> DataFrame | None:
        """Result of a query; ``None`` for other statements."""
        for pattern, action in self._ACTIONS:
            if m := re.fullmatch(pattern, text.strip().rstrip(";").strip(), re.I | re.S):
                return action(self, **m.groupdict())
        raise StatementError(f"no statement: {text}")

    def _query(self, query: str) -> DataFrame:
        used = set(re.findall(r"\w+", _QUOTED.sub(" ", query)))
        for name in used & set(self.tables):
            self.tables[name].createOrReplaceTempView(name)
        for name in used & set(SYSTEM):
            getattr(self.catalog, name)(self.spark).createOrReplaceTempView(name)
        return self.spark.sql(standard(query))

    def _changed(self, name: str, df: DataFrame) -> None:
        self._changes[name] = self._changes.get(name, 0) + 1
        self.tables[name] = stored(df, f"table-{name}") if self._changes[name] % CHANGES == 0 else df

    def _there(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise StatementError(f"no table {name}")
        return self.tables[name]

    def _insert(self, name: str, columns: str | None, rows: str) -> None:
        old = self._there(name)
        into = [c.strip() for c in columns.strip("() ").split(",")] if columns else old.columns
        if re.match(r"VALUES\b", rows, re.I):
            listed = re.sub(r"\bROW\s*(?=\()", "", rows.strip()[6:], flags=re.I)
            new = self.spark.sql(standard(f"SELECT * FROM VALUES {listed}"))
        else:
            new = self._query(rows)
        if len(new.columns) != len(into):
            raise StatementError(f"{len(new.columns)} values for {len(into)} columns")
        types = {f.name: f.dataType for f in old.schema}
        new = new.toDF(*into).select(*(F.col(c).cast(types[c]).alias(c) for c in into))
        self._refuse_repeated(name, new, old)
        self._changed(name, access.insert(old, new))

    def _keys(self, name: str) -> list[tuple[str, ...]]:
        meta = self.catalog.tables.get(name)
        return [*meta.keys, *(i.columns for i in meta.indexes if i.unique and not any(i.prefix))] if meta else []

    def _refuse_repeated(self, name: str, new: DataFrame, old: DataFrame | None) -> None:
        """Keys of new rows may be neither there already nor among them twice; nulls are not equal."""
        for key in self._keys(name):
            if not set(key) <= set(new.columns):
                continue
            rows = new.select(*key).dropna()
            if not access.duplicates(rows, *key).isEmpty() or (old is not None and not rows.join(old.select(*key), list(key), "left_semi").isEmpty()):
                raise StatementError(f"({', '.join(key)}) of {name} repeats")

    def _update(self, name: str, to: str, where: str | None) -> None:
        if name.startswith("sys_"):
            return self._statistics(name, to, where)
        old, given = self._there(name), dict(self._assignment(a) for a in _split(to, ","))
        types = {f.name: f.dataType.simpleString() for f in old.schema}
        if unknown := set(given) - set(types):
            raise StatementError(f"no column {', '.join(sorted(unknown))}")
        where = where or "true"
        values = ", ".join(f"CAST({given[c]} AS {types[c]}) AS `{c}`" if c in given else f"`{c}`" for c in old.columns)
        new = self._query(f"SELECT {values} FROM {name} WHERE {where} UNION ALL SELECT * FROM {name} WHERE NOT coalesce(({where}), false)")
        if any(set(k) & set(given) for k in self._keys(name)):
            self._refuse_repeated(name, new, None)
        self._changed(name, new)

    @staticmethod
    def _assignment(text: str) -> tuple[str, str]:
        column, value = text.split("=", 1)
        return column.strip(), value.strip()

    def _statistics(self, name: str, to: str, where: str | None) -> None:
        """An update of the catalog's tables: of rows (``sys_tables``) and distinct values (``sys_columns``)."""
        allowed = {"sys_tables": "n_rows", "sys_columns": "n_distinct"}.get(name)
        given = dict(self._assignment(a) for a in _split(to, ","))
        if set(given) != {allowed}:
            raise StatementError(f"{name} takes new values of {allowed} only")
        for r in self._query(f"SELECT *, CAST({given[allowed]} AS DOUBLE) AS value FROM {name} WHERE {where or 'true'}").collect():
            if name == "sys_tables":
                self.catalog.with_statistics(r.table_name, r.value)
            else:
                self.catalog.with_statistics(r.table_name, **{r.column_name: r.value})

    def _delete(self, name: str, where: str | None) -> None:
        old = self._there(name)
        self._changed(name, self._query(f"SELECT * FROM {name} WHERE NOT coalesce(({where}), false)") if where else old.limit(0))

    def _create_table(self, name: str, body: str) -> None:
        columns, keys, foreign = [], [], []
        for part in map(str.strip, _split(body, ",")):
            if m := re.fullmatch(r"(?:CONSTRAINT\s+\w+\s+)?(PRIMARY\s+KEY|UNIQUE)\s*\((.*)\)", part, re.I | re.S):
                keys.insert(0 if m[1][0] in "pP" else len(keys), self._listed(m[2]))
            elif m := re.fullmatch(r"(?:CONSTRAINT\s+\w+\s+)?FOREIGN\s+KEY\s*\((.*?)\)\s*REFERENCES\s+(\w+)\s*(?:\((.*)\))?", part, re.I | re.S):
                foreign.append(ForeignKey(self._listed(m[1]), m[2], self._referenced(m[2], m[3])))
            elif m := re.fullmatch(r"(\w+)\s+([A-Za-z]+(?:\s+VARYING)?)\s*(?:\(\s*(\d+)[^)]*\))?(.*)", part, re.I | re.S):
                kind = DataType.parse(re.sub(r"\s+", " ", m[2]))
                columns.append(ColumnMeta(m[1], kind, int(m[3] or 0) if kind.width is None else 0))
                if re.search(r"\bPRIMARY\s+KEY\b", m[4], re.I):
                    keys.insert(0, (m[1],))
                elif re.search(r"\bUNIQUE\b", m[4], re.I):
                    keys.append((m[1],))
                if r := re.search(r"\bREFERENCES\s+(\w+)\s*(?:\((.*)\))?", m[4], re.I | re.S):
                    foreign.append(ForeignKey((m[1],), r[1], self._referenced(r[1], r[2])))
            else:
                raise StatementError(f"no column or constraint: {part}")
        meta = TableMeta(name, tuple(columns), 0.0, tuple(keys), tuple(foreign))
        for c in {c for k in (*keys, *(f.columns for f in foreign)) for c in k}:
            meta.column(c)
        self.catalog.create_table(meta)
        self.tables[name] = self.spark.createDataFrame([], T.StructType([T.StructField(c.name, c.kind.spark) for c in columns]))

    @staticmethod
    def _listed(text: str) -> tuple[str, ...]:
        return tuple(c.strip() for c in text.split(","))

    def _referenced(self, table: str, columns: str | None) -> tuple[str, ...]:
        if table not in self.catalog.tables:
            raise StatementError(f"no table {table}")
        return self._listed(columns) if columns else self.catalog.tables[table].keys[0]

    def _create_index(self, unique: str | None, name: str, kind: str | None, table: str, kind_after: str | None, body: str) -> None:
        columns, descending, prefix = [], [], []
        for part in _split(body, ","):
            m = re.fullmatch(r"\s*(\w+)\s*(?:\(\s*(\d+)\s*\))?\s*(ASC|DESC)?\s*", part, re.I)
            if not m:
                raise StatementError(f"no key column: {part}")
            columns.append(m[1])
            prefix.append(int(m[2]) if m[2] else None)
            descending.append((m[3] or "").upper() == "DESC")
        if table not in self.catalog.tables:
            df = self._there(table)
            self.catalog.create_table(TableMeta(table, tuple(ColumnMeta(f.name, DataType.of(f.dataType)) for f in df.schema)))
        index = IndexMeta(name, (kind or kind_after or "BTREE").upper(), tuple(columns), unique=bool(unique), descending=tuple(descending), prefix=tuple(prefix))
        self.catalog.create_index(table, index, self.tables.get(table))

    def _drop(self, what: str, name: str) -> None:
        if what.upper() == "INDEX":
            if not any(i.name == name for t in self.catalog.tables.values() for i in t.indexes):
                raise StatementError(f"no index {name}")
            return self.catalog.drop_index(name)
        self._there(name)
        if users := [t.name for t in self.catalog.tables.values() if t.name != name and any(f.table == name for f in t.foreign)]:
            raise StatementError(f"{name} is referred to by {', '.join(users)}")
        del self.tables[name]
        if name in self.catalog.tables:
            self.catalog.drop_table(name)
        self.spark.catalog.dropTempView(name)

    _ACTIONS = (
        (r"(?P<query>(?:SELECT|WITH)\b.*)", _query),
        (r"INSERT\s+INTO\s+(?P<name>\w+)\s*(?P<columns>\([^()]*\))?\s*(?:OVERRIDING\s+(?:USER|SYSTEM)\s+VALUE\s+)?(?P<rows>(?:VALUES|SELECT)\b.*)", _insert),
        (r"UPDATE\s+(?P<name>\w+)\s+SET\s+(?P<to>.*?)(?:\s+WHERE\s+(?P<where>.*))?", _update),
        (r"DELETE\s+FROM\s+(?P<name>\w+)(?:\s+WHERE\s+(?P<where>.*))?", _delete),
        (r"CREATE\s+TABLE\s+(?P<name>\w+)\s*\((?P<body>.*)\)", _create_table),
        (r"CREATE\s+(?P<unique>UNIQUE\s+)?INDEX\s+(?P<name>\w+)\s+(?:USING\s+(?P<kind>\w+)\s+)?ON\s+(?P<table>\w+)\s*(?:USING\s+(?P<kind_after>\w+)\s*)?\((?P<body>.*)\)", _create_index),
        (r"DROP\s+(?P<what>TABLE|INDEX)\s+(?P<name>\w+)", _drop),
    )
