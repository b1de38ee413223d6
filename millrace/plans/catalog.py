"""Statements that change or show the catalog: databases, tables, indexes, tablespaces, session variables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import sources
from .dialect import _close, _split, _type, lex


class Catalog:
    """Databases and tables are Spark's. Indexes and tablespaces are names kept here: Parquet and ORC statistics serve as
    indexes, a tablespace is a place under which tables are put."""

    def __init__(self, spark: SparkSession, translate: Callable[[str], str]):
        """translate: the dialect's queries into Spark SQL, with the types of what they divide."""
        self.spark, self.translate = spark, translate
        self.indexes: dict[str, tuple[str, str]] = {}
        self.tablespaces: dict[str, str] = {}
        self.variables: dict[str, str] = {}

    def _said(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "result string")

    def run(self, text: str) -> DataFrame | None:
        """The statement's result, or None if it is none of the catalog's."""
        for pattern, method in (
            (r"create\s+database\s+(if\s+not\s+exists\s+)?([\w\"]+)$", self._create_database),
            (r"drop\s+database\s+(if\s+exists\s+)?([\w\"]+)$", self._drop_database),
            (r"create\s+(external\s+)?table\s+(if\s+not\s+exists\s+)?([\w.\"]+)\s+like\s+([\w.\"]+)$", self._like),
            (r"create\s+(external\s+)?table\s+(if\s+not\s+exists\s+)?([\w.\"]+)\s*(.*)$", self._create_table),
            (r"drop\s+table\s+(if\s+exists\s+)?([\w.\"]+)(\s+purge)?$", self._drop_table),
            (r"truncate\s+(?:table\s+)?([\w.\"]+(?:\s*,\s*[\w.\"]+)*)$", self._truncate),
            (r"alter\s+tablespace\s+(\w+)\s+location\s+'([^']*)'$", self._tablespace),
            (r"create\s+tablespace\s+(\w+)\s+location\s+'([^']*)'$", self._tablespace),
            (r"alter\s+table\s+([\w.\"]+)\s+(.*)$", self._alter),
            (r"create\s+(unique\s+)?index\s+(\w+)\s+on\s+([\w.\"]+)\s*(?:using\s+\w+\s*)?(\(.*\))$", self._index),
            (r"drop\s+index\s+(\w+)$", self._drop_index),
            (r"set\s+catalog\s+([\w\"]+)$", self._use),
            (r"set\s+(?:session\s+)?time\s+zone\s+(?:to\s+)?'?([^']+)'?$", self._zone),
            (r"set\s+(?:session\s+)?([\w.]+)\s*(?:to|=)\s*(.+)$", self._set),
            (r"reset\s+([\w.]+)$", self._reset),
        ):
            if m := re.match(pattern, text, re.IGNORECASE | re.DOTALL):
                return method(*m.groups())
        if re.search(r"\binformation_schema\s*\.", text, re.IGNORECASE):
            return self._system(text)
        return None

    def _create_database(self, quiet, name):
        self.spark.sql(f"CREATE DATABASE {quiet or ''}{name.strip(chr(34))}")
        return self._said(name)

    def _drop_database(self, quiet, name):
        self.spark.sql(f"DROP DATABASE {quiet or ''}{name.strip(chr(34))} CASCADE")
        return self._said(name)

    def _like(self, external, quiet, name, other):
        self.spark.sql(f"CREATE TABLE {quiet or ''}{name} LIKE {other}".replace('"', "`"))
        return self._said(name)

    def _create_table(self, external, quiet, name, rest):
        name = name.replace('"', "`")
        tokens, at, columns, free = lex(rest), 0, [], False
        if tokens[:1] == ["("]:
            end = _close(tokens, 0)
            inner = tokens[1:end]
            free = inner == ["*"]
            columns = [] if free else [(c[0].strip('"'), _type(c, 1)[0]) for c in _split(inner)]
            at = end + 1
        kind, options, location, partitions, query = "parquet", {}, "", [], ""
        while at < len(tokens):
            low = tokens[at].lower()
            if low == "using":
                kind, at = tokens[at + 1], at + 2
            elif low == "with" and tokens[at + 1] == "(":
                end = _close(tokens, at + 1)
                options, at = sources.options_of(" ".join(tokens[at + 2 : end])), end + 1
            elif low == "partition" and tokens[at + 1].lower() == "by":
                at += 2 + (tokens[at + 2].lower() == "column")
                end = _close(tokens, at)
                partitions, at = [(c[0].strip('"'), _type(c, 1)[0] if len(c) > 1 else "") for c in _split(tokens[at + 1 : end])], end + 1
            elif low == "location":
                location, at = tokens[at + 1].strip("'"), at + 2
            elif low == "tablespace":
                location, at = self.tablespaces[tokens[at + 1]], at + 2
                if location.startswith("jdbc:"):  # the table is a table of that database
                    kind, options, location, free = "jdbc", {"url": location, "dbtable": name.strip("`"), **options}, "", True
                else:
                    location = f"{location}/{name.strip('`')}"
            elif low == "as":
                query, at = self.translate(" ".join(tokens[at + 1 :])), len(tokens)
            else:
                raise ValueError(f"CREATE TABLE: {tokens[at]} isn't understood")
        form, own = sources.spark_format(kind, options)
        if free:
            sources.read(self.spark, location, kind, options).createOrReplaceTempView(name.strip("`"))
            return self._said(name)
        defined = ", ".join(f"`{c}` {t}" for c, t in [*columns, *((c, t) for c, t in partitions if t)])
        text = f"CREATE TABLE {quiet or ''}{name} " + (f"({defined}) " if defined and not query else "") + f"USING {form} "
        text += f"OPTIONS ({', '.join(f'{chr(39)}{k}{chr(39)} {chr(39)}{v}{chr(39)}' for k, v in own.items())}) " if own else ""
        text += f"PARTITIONED BY ({', '.join(f'`{c}`' for c, _ in partitions)}) " if partitions else ""
        text += f"LOCATION '{location}' " if location else ""
        self.spark.sql(text + (f"AS {query}" if query else ""))
        if external and partitions and location:
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return self._said(name)

    def _drop_table(self, quiet, name, purge):
        name = name.replace('"', "`")
        if self.spark.catalog.dropTempView(name.strip("`")):
            return self._said(name)
        self.spark.sql(f"DROP TABLE {quiet or ''}{name}{' PURGE' if purge else ''}")
        return self._said(name)

    def _truncate(self, names):
        for n in names.split(","):
            self.spark.sql(f"TRUNCATE TABLE {n.strip()}")
        return self._said(names)

    def _alter(self, name, what):
        name = name.replace('"', "`")
        what = what.replace('"', "`")
        if m := re.match(r"add\s+column\s+(`?\w+`?)\s+(.*)$", what, re.IGNORECASE):
            what = f"ADD COLUMNS ({m[1]} {_type(lex(m[2]), 0)[0]})"
        elif m := re.match(r"set\s+property\s+(.*)$", what, re.IGNORECASE):
            what = f"SET TBLPROPERTIES ({m[1].strip('()')})"
        elif m := re.match(r"unset\s+property\s+(.*)$", what, re.IGNORECASE):
            what = f"UNSET TBLPROPERTIES ({m[1].strip('()')})"
        elif re.match(r"repair\s+partition$", what, re.IGNORECASE):
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
            return self._said(name)
        elif m := re.match(r"(add|drop)\s+(if\s+(?:not\s+)?exists\s+)?partition\s*(\(.*?\))\s*(?:location\s*('[^']*'))?(\s+purge)?$", what, re.IGNORECASE):
            what = f"{m[1]} {m[2] or ''}PARTITION {m[3]}" + (f" LOCATION {m[4]}" if m[4] else "") + (m[5] or "")
        self.spark.sql(f"ALTER TABLE {name} {what}")
        return self._said(name)

    def _tablespace(self, name, location):
        self.tablespaces[name] = location
        return self._said(name)

    def _index(self, unique, name, table, columns):
        self.indexes[name] = table, columns.strip("()")
        return self._said(name)

    def _drop_index(self, name):
        del self.indexes[name]
        return self._said(name)

    def _use(self, name):
        self.spark.catalog.setCurrentDatabase(name.strip('"'))
        return self._said(name)

    def _zone(self, zone):
        self.spark.conf.set("spark.sql.session.timeZone", zone)
        return self._said(zone)

    def _set(self, name, value):
        value = value.strip().strip("'")
        if name.lower() == "timezone":
            return self._zone(value)
        self.variables[name] = value
        if name.startswith("spark."):
            self.spark.conf.set(name, value)
        return self._said(f"{name}={value}")

    def _reset(self, name):
        self.variables.pop(name, None)
        if name.startswith("spark."):
            self.spark.conf.unset(name)
        return self._said(name)

    def _system(self, text: str) -> DataFrame:
        """Queries on information_schema: its tables are made as views when they are named."""
        s = self.spark
        tables = [(t.namespace[0] if t.namespace else "", t.name, t.tableType, t.isTemporary) for t in s.catalog.listTables()]
        named = set(re.findall(r"information_schema\s*\.\s*(\w+)", text.lower()))
        columns = [(n, c, k, i) for _, n, _, _ in tables for i, (c, k) in enumerate(s.table(n).dtypes)] if "columns" in named else []
        partitions = [(n, r[0]) for _, n, kind, temp in tables if not temp and "partitions" in named and any(c.isPartition for c in s.catalog.listColumns(n)) for r in s.sql(f"SHOW PARTITIONS {n}").collect()]
        stats = [(n, int(s.table(n)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for _, n, _, _ in tables] if "table_stats" in named else []
        options = [(n, r.key, r.value) for _, n, _, temp in tables if not temp and "table_options" in named for r in s.sql(f"SHOW TBLPROPERTIES {n}").collect()]
        views = {
            "databases": ([(d.name, d.locationUri) for d in s.catalog.listDatabases()], "db_name string, space string"),
            "tables": (tables, "db_name string, table_name string, table_type string, temporary boolean"),
            "columns": (columns, "table_name string, column_name string, data_type string, ordinal_position int"),
            "indexes": ([(n, t, c) for n, (t, c) in self.indexes.items()], "index_name string, table_name string, columns string"),
            "tablespaces": (list(self.tablespaces.items()), "space_name string, uri string"),
            "table_options": (options, "table_name string, key string, value string"),
            "table_stats": (stats, "table_name string, num_bytes long"),
            "partitions": (partitions, "table_name string, partition string"),
            "cluster": ([(s.sparkContext.master, s.sparkContext.defaultParallelism)], "master string, slots int"),
            "session": (list(self.variables.items()), "key string, value string"),
        }
        for name in named:
            rows, schema = views[name]
            s.createDataFrame(rows, schema).createOrReplaceTempView(f"information_schema_{name}")
        return s.sql(self.translate(re.sub(r"(?i)information_schema\s*\.\s*", "information_schema_", text)))
