"""The engine: SQL of the dialect, its catalog and its statements, over one SparkSession."""

from __future__ import annotations

import re
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .functions import window
from .functions.registry import REGISTRY
from .operators.joins import size_of
from .plans import blocks, dialect
from .plans.catalog import Catalog
from .session import dialect_session, place
from .udf import Functions, two_phases

#: Bytes, by Catalyst's estimate, of a statement's result up to which one task may put all rows in an order.
ORDERED = 4 << 20


class Engine:
    """engine.sql(text) runs a statement of the dialect; queries come back as DataFrames that aren't run yet."""

    def __init__(self, spark: SparkSession, windows: str = "whole", own_session: bool = True):
        self.given, self.spark = spark, dialect_session(spark) if own_session else spark
        self.windows = windows
        self.catalog = Catalog(self.spark, self.translated)
        self.functions = Functions(self.spark)

    def register(self, folder: str, tables: list[str]) -> Engine:
        """Parquet files folder/<table>.parquet as views."""
        for t in tables:
            self.spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)
        return self

    def script(self, text: str) -> list[DataFrame]:
        """Runs statements divided by ;."""
        parts, own = [], []
        for t in dialect.LEX.findall(text):
            if t == ";":
                parts.append("".join(own))
                own = []
            else:
                own.append(t)
        return [self.sql(p) for p in [*parts, "".join(own)] if p.strip()]

    def sql_file(self, path: str) -> list[DataFrame]:
        return self.script(Path(path).read_text())

    def translated(self, text: str) -> str:
        """Spark SQL of a query; where it divides, Spark is asked for the types first."""
        mode = dialect.Mode(self.windows)
        out = dialect.translate(text, mode)
        if not mode.quotients:
            return out
        probe = dialect.translate(text, dialect.Mode(self.windows, probe=True))
        kinds = dialect.kinds_in(self.spark.sql(f"EXPLAIN EXTENDED {probe}").collect()[0][0])
        return dialect.translate(text, dialect.Mode(self.windows, kinds))

    def explain(self, text: str, mode: str = "formatted") -> str:
        """mode: formatted, extended, cost or codegen."""
        return self.spark.sql(f"EXPLAIN {mode.upper()} {self.translated(text.strip().rstrip(';'))}").collect()[0][0]

    def sql(self, text: str) -> DataFrame:
        text = text.strip().rstrip(";")
        if (done := self.catalog.run(text)) is not None:
            return done
        if m := re.match(r"(?is)explain\s+(global\s+)?(.*)", text):
            return self.spark.createDataFrame([(self.explain(m[2]),)], "plan string")
        if m := re.match(r"(?is)insert\s+(overwrite\s+)?into\s+location\s+'([^']*)'\s+(?:using\s+(\w+)\s+)?(?:with\s*\((.*?)\)\s+)?(select.*)", text):
            out = self.sql(m[5])
            sources.write(out, m[2], m[3] or "csv", sources.options_of(m[4] or ""), "overwrite" if m[1] else "append")
            return self.spark.createDataFrame([(m[2],)], "location string")
        if m := re.match(r"(?is)insert\s+(overwrite\s+)?into\s+([\w.`\"]+)\s*(\([^)]*\))?\s*((?:select|values|with|table).*)", text):
            return self._insert(m[2].replace('"', "`"), [c.strip() for c in (m[3] or "()")[1:-1].split(",") if c.strip()], m[4], bool(m[1]))
        return self.query(text)

    def query(self, text: str) -> DataFrame:
        """A query of the dialect. Functions of all rows in an order, of more than ORDERED, and class-style aggregates of groups are
        worked out over all tasks, in derived tables too."""
        out = self.spark.sql(self.translated(text))
        if not self._apart(dialect.lex(text)):
            return out
        for way in (self._two_phased, self._placed, self._derived):
            if (made := way(text, out)) is not None:
                return made
        return out

    def _apart(self, tokens: list[str]) -> bool:
        words = {t.lower() for t in tokens}
        return bool(words & self.functions.classes.keys() or "over" in words and words & blocks.PLACES)

    def _derived(self, text: str, plain: DataFrame) -> DataFrame | None:
        """A statement whose derived tables are queries of their own, where they need nothing from outside."""
        tokens, out, views, k = dialect.lex(text), [], [], 0
        names = {tokens[j].lower() for j in range(len(tokens) - 2) if tokens[j + 1].lower() == "as" and tokens[j + 2] == "("}
        try:
            while k < len(tokens):
                if tokens[k] == "(" and tokens[k + 1].lower() in ("select", "with"):
                    end = dialect._close(tokens, k)
                    own = tokens[k + 1 : end]
                    if self._apart(own) and not names & {t.lower().strip('`"') for t in own}:
                        try:
                            rows = self.query(" ".join(own))
                            view = f"_derived_{uuid.uuid4().hex}"
                            rows.createTempView(view)
                            views.append(view)
                            out += ["(", "select", "*", "from", view, ")"]
                            k = end + 1
                            continue
                        except AnalysisException:  # it needs names from outside
                            pass
                out.append(tokens[k])
                k += 1
            made = self.spark.sql(self.translated(" ".join(out))) if views else None
        except AnalysisException:
            made = None
        finally:
            for view in views:
                self.spark.catalog.dropTempView(view)
        return made if made is not None and made.dtypes == plain.dtypes else None

    def _aggregate(self, name: str) -> bool:
        """Whether a function of SQL is an aggregate."""
        if name in self.functions.grouped:
            return True
        jvm, known = self.spark._jvm, self.spark._jsparkSession.sessionState().functionRegistry()
        words = {name, *(w for t in REGISTRY.get(name, {}).values() for w in re.findall(r"\w+", t))}
        found = [known.lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(w)) for w in words]
        return any(f.isDefined() and f.get().getGroup() == "agg_funcs" for f in found)

    def _two_phased(self, text: str, plain: DataFrame) -> DataFrame | None:
        """A grouping statement with class-style aggregates, which are worked out in two phases; other aggregates are joined to them."""
        b = blocks.block(text)
        parts = b and blocks.grouping(b.body, b.items)
        if not parts:
            return None
        source, keys, having = parts
        kinds = self.functions.classes
        calls: dict[tuple, str] = {}
        others: dict[tuple, str] = {}
        pieces = [*map(blocks.unnamed, b.items), having, b.tail]
        words = {t.lower() for p in pieces for t in p}
        if "select" in words or words & self.functions.foreign or len(b.items) != len(plain.columns):
            return None
        pieces = [blocks.aggregated(p, kinds.keys(), self._aggregate, calls, others) for p in pieces]
        if not calls or any(p is None for p in pieces):
            return None
        arguments: list[list[str]] = []
        for c in calls:
            arguments += [a for a in dialect._split(list(c[2:-1])) if a not in arguments]
        named = [*((k, f"_group{n}") for n, k in enumerate(keys)), *((a, f"_value{n}") for n, a in enumerate(arguments))]

        def grouped_of(named: list[tuple[list[str], str]], *more: str) -> DataFrame:
            return self.query(" ".join([*b.head, "select", ", ".join(f"{' '.join(e)} as {n}" for e, n in named), *source, *more]))

        try:
            try:
                rows = grouped_of(named)
            except AnalysisException:  # a key may be the name of an item
                aliases = {name.lower(): blocks.unnamed(i) for name, i in zip(plain.columns, b.items, strict=True)}
                named = [(aliases.get(e[0].lower(), e) if len(e) == 1 and n.startswith("_group") else e, n) for e, n in named]
                rows = grouped_of(named)
            own = [n for _, n in named[: len(keys)]]
            if any(rows.schema[n].dataType.typeName() in ("array", "struct", "map", "variant") for n in own):
                return None
            rows = rows.withColumns({n: F.col(n).cast("timestamp_ntz") for n, kind in rows.dtypes if kind == "timestamp" and n not in own})
            found = two_phases(rows, own, {to: ([f"_value{arguments.index(a)}" for a in dialect._split(list(c[2:-1]))], *kinds[c[0].lower()]) for c, to in calls.items()})
            if others:
                joined = [*((e, n.replace("_group", "_same")) for e, n in named[: len(keys)]), *((list(c), to) for c, to in others.items())]
                beside = grouped_of(joined, *(["group by", ", ".join(" ".join(e) for e, _ in named[: len(keys)])] if keys else []))
                on = [found[n].eqNullSafe(beside[n.replace("_group", "_same")]) for n in own]
                found = found.join(beside, on) if on else found.crossJoin(beside)
            view = f"_groups_{uuid.uuid4().hex}"
            found.createOrReplaceTempView(view)
            # A group's expression may stand with or without its table's name.
            forms = [f for k, n in [*zip(keys, own, strict=True), *named[: len(keys)]] for f in ([(k, n), (k[-1:], n)] if len(k) == 3 and k[1] == "." else [(k, n)])]
            bare = {k[0].lower(): n for k, n in forms if len(k) == 1}
            qualified = [(p[k - 2 : k + 1], bare[p[k].lower()]) for p in pieces for k in range(2, len(p)) if p[k - 1] == "." and p[k].lower() in bare]
            forms += [q for q in qualified if q not in forms]
            items = [blocks.replaced(p, forms) for p in pieces[:-2]]
            outputs = [([name], f"( {' '.join(i)} )") for name, i in zip(plain.columns, items, strict=True)]
            names = {name.lower() for name in plain.columns}
            where = blocks.replaced(blocks.replaced(pieces[-2][1:], forms), [o for o in outputs if o[0][0].lower() not in bare])
            tail = blocks.replaced(pieces[-1], [f for f in forms if len(f[0]) > 1 or f[0][0].lower() not in names])
            outer = ["select", ", ".join(f'{" ".join(i)} as "{name.replace(chr(34), chr(34) * 2)}"' for i, name in zip(items, plain.columns, strict=True)), "from", view, *(["where", *where] if where else []), *tail]
            try:
                out = self.spark.sql(self.translated(" ".join(outer)))
            finally:
                self.spark.catalog.dropTempView(view)
        except AnalysisException:
            return None
        return out if out.dtypes == plain.dtypes else None

    def _placed(self, text: str, plain: DataFrame) -> DataFrame | None:
        b = blocks.block(text)
        calls, items = [], []
        for item in b.items if b else []:
            items.append(blocks.places(blocks.unnamed(item), len(calls)))
            calls += items[-1][1] if items[-1] else []
        left = [i for i, p in zip(b.items, items, strict=True) if not p] if calls else []
        if not calls or size_of(plain) <= ORDERED or not (self.given.conf.get("spark.checkpoint.dir", None) or self.given.sparkContext.master.startswith("local[")):
            return None
        outer = [p[0] for p in items if p]
        if blocks.grouping(b.body) is None or any(i[-1] == "*" for i in left) or any(not blocks.needs_no_column(o, "_place") or {"/", "%"} & set(o) for o in outer) or any(len(c.arguments) != (c.function == "ntile") for c in calls):
            return None
        if any(not (len(c.arguments[0]) == 1 and c.arguments[0][0].isdigit() and int(c.arguments[0][0])) for c in calls if c.arguments):
            return None
        # The keys of each order stand beside the other items; a key that is an item already isn't written twice.
        keys: list[list[str]] = []
        known = [blocks.unnamed(i) for i in left]
        orders: dict[str, tuple[list, dict]] = {}
        for c in calls:
            own = [blocks.without_direction(i) for i in c.order]
            keys += [e for e, _, _ in own if e not in known and e not in keys]
            orders.setdefault(repr(own), (own, {}))[1][c.name] = (c.function, int(c.arguments[0][0]) if c.arguments else 0)
        inner = [*(" ".join(i) for i in left), *(f"{' '.join(e)} as _key{k}" for k, e in enumerate(keys))]
        try:
            frame = self.query(" ".join([*b.head, "select", ", ".join(inner), *b.body])).toDF(*[f"_c{k}" for k in range(len(inner))])
            for own, named in orders.values():
                by = []
                for e, down, first in own:
                    c = F.col(f"_c{known.index(e) if e in known else len(left) + keys.index(e)}")
                    by.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else c.asc_nulls_first() if first else c.asc_nulls_last())
                frame = window.placed(frame, by, named, place(self.given, "ordered"))
            at = iter(range(len(left)))
            columns = [F.expr(dialect.translate(" ".join(p[0]))) if p else F.col(f"_c{next(at)}") for p in items]
            out = frame.select(*[c.alias(name) for c, name in zip(columns, plain.columns, strict=True)])
            if b.tail:
                view = f"_placed_{uuid.uuid4().hex}"
                out.createOrReplaceTempView(view)
                try:
                    out = self.spark.sql(self.translated(" ".join(["select * from", view, *b.tail])))
                finally:
                    self.spark.catalog.dropTempView(view)
        except AnalysisException:
            return None
        return out if out.dtypes == plain.dtypes else None

    def _insert(self, table: str, columns: list[str], query: str, overwrite: bool) -> DataFrame:
        """Columns left out are NULL; partition columns come last; only partitions that get rows are overwritten."""
        rows = self.query(query)
        fields = self.spark.table(table).schema.fields
        if columns:
            rows = rows.toDF(*[c.lower() for c in columns])
            rows = rows.select(*[(F.col(f.name.lower()) if f.name.lower() in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        elif len(rows.columns) < len(fields):
            rows = rows.toDF(*[f.name for f in fields[: len(rows.columns)]])
            rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        rows.write.insertInto(table, overwrite=overwrite)
        return self.spark.createDataFrame([(table,)], "table string")
