"""User-defined functions: Python scalars, class-style aggregates, table functions, and Java ones."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.dialect import _type, lex


#: Ranges of addresses that are sent to the executors: 24 bytes and a code each.
COUNTRY_RANGES = 1_000_000
#: Keys that a task of two_phase holds before it hands their partial results on.
HELD = 100_000


def output_type(kind: str) -> Callable:
    """Marks a function or an aggregate class with its result type; BLOB without it."""

    def mark(f):
        f.output_type = kind
        return f

    return mark


def _kind(f, kind: str | None) -> str:
    return _type(lex(kind or getattr(f, "output_type", "blob")), 0)[0]


class Functions:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        #: Class-style aggregates by name, (class, Spark type); names of other aggregates, and of functions that may be ones.
        self.classes: dict[str, tuple[type, str]] = {}
        self.grouped: set[str] = set()
        self.foreign: set[str] = set()

    def _known_as(self, name: str, group: set[str] | None = None) -> None:
        self.classes.pop(name.lower(), None)
        for g in (self.grouped, self.foreign):
            g.discard(name.lower())
        if group is not None:
            group.add(name.lower())

    def scalar(self, name: str, f: Callable, kind: str | None = None, vectorised: bool = False) -> None:
        """A scalar for SQL. vectorised: f takes and returns pandas Series; else it is called value by value in Arrow batches."""
        made = F.pandas_udf(f, _kind(f, kind)) if vectorised else F.udf(f, _kind(f, kind), useArrow=True)
        self.spark.udf.register(name, made)
        self._known_as(name)

    def table(self, name: str, handler: type, kind: str) -> None:
        self.spark.udtf.register(name, F.udtf(handler, returnType=kind))

    def java(self, name: str, class_name: str, kind: str | None = None, aggregate: bool = False) -> None:
        self._known_as(name, self.foreign)
        (self.spark.udf.registerJavaUDAF if aggregate else self.spark.udf.registerJavaFunction)(name, class_name, *([] if aggregate or not kind else [_type(lex(kind), 0)[0]]))

    def aggregate(self, name: str, handler: type, kind: str | None = None) -> None:
        """A class with eval(*values), get_partial_result(), merge(partial), get_final_result(), for SQL.

        The engine runs statements that group by two_phases(), where it can take them apart. Elsewhere, and in OVER, SQL sees a
        grouped pandas function, which has a group in one task; for groups that don't fit one use two_phase().
        """
        self._known_as(name)
        if all(hasattr(handler, f) for f in ("eval", "get_partial_result", "merge", "get_final_result")):
            self.classes[name.lower()] = handler, _kind(handler, kind)
        else:
            self.grouped.add(name.lower())

        def run(*columns: pd.Series):
            own = handler()
            for values in zip(*columns, strict=True):
                own.eval(*values)
            return own.get_final_result()

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # a function of any number of columns has no annotations that say what it is
            self.spark.udf.register(name, F.pandas_udf(run, _kind(handler, kind), F.PandasUDFType.GROUPED_AGG))

    def window(self, name: str, f: Callable[..., object], kind: str | None = None) -> None:
        """For SQL with OVER: f takes the values of the window, a pandas Series for each argument, and returns one value."""
        self._known_as(name, self.grouped)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            self.spark.udf.register(name, F.pandas_udf(f, _kind(f, kind), F.PandasUDFType.GROUPED_AGG))

    def jar(self, name: str, class_name: str, jar: str) -> None:
        """A Hive function of a jar; needs a session with Hive support."""
        self._known_as(name, self.foreign)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} AS '{class_name}' USING JAR '{jar}'")

    def countries(self, ranges: DataFrame) -> None:
        """geoip_country_code(address) and geoip_in_country(address, code), of IPv4 texts or numbers.

        ranges: (first long, last long, code string), not overlapping.  They are sent to the executors, so there may be no more
        than COUNTRY_RANGES; for more use functions.net.with_country, which joins.
        """
        rows = ranges.select("first", "last", "code").orderBy("first").limit(COUNTRY_RANGES + 1).toPandas()
        if len(rows) > COUNTRY_RANGES:
            raise ValueError(f"more than {COUNTRY_RANGES} ranges")
        first, last, codes = rows["first"].to_numpy("int64"), rows["last"].to_numpy("int64"), rows["code"].to_numpy(object)

        def number(address) -> int:
            if isinstance(address, str):
                parts = address.split(".")
                ok = len(parts) == 4 and all(p.isdigit() and int(p) < 256 for p in parts)
                return int.from_bytes(bytes(map(int, parts)), "big") if ok else -1
            return -1 if address is None or address != address else int(address) & 0xFFFFFFFF

        def code_of(addresses: pd.Series) -> pd.Series:
            n = addresses.map(number).to_numpy("int64")
            at = first.searchsorted(n, "right") - 1
            return pd.Series([codes[k] if k >= 0 and x <= last[k] else None for k, x in zip(at.tolist(), n.tolist(), strict=True)], dtype=object)

        def in_country(addresses: pd.Series, code: pd.Series) -> pd.Series:
            return code_of(addresses).eq(code.reset_index(drop=True))

        self.spark.udf.register("geoip_country_code", F.pandas_udf(code_of, "string"))
        self.spark.udf.register("geoip_in_country", F.pandas_udf(in_country, "boolean"))


def two_phase(frame: DataFrame, keys: list[str], columns: list[str], handler: type, to: str, kind: str) -> DataFrame:
    """A class-style aggregate in two phases: partial results per task and key, then merged by key.

    Only partial results are shuffled, so a hot key is no hot task.
    """
    return two_phases(frame, keys, {to: (columns, handler, kind)})


def two_phases(frame: DataFrame, keys: list[str], calls: dict[str, tuple[list[str], type, str]]) -> DataFrame:
    """Class-style aggregates of the same groups in two phases. calls: name -> (columns, class, type)."""
    import pickle

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    schema = frame.select(*keys).schema
    n, nan = len(keys), float("nan")
    columns = list(dict.fromkeys(c for own, _, _ in calls.values() for c in own))
    handlers = [(h, [n + columns.index(c) for c in own]) for own, h, _ in calls.values()]
    floats = [i for i, f in enumerate(schema.fields) if f.dataType.typeName() in ("float", "double")]

    def listed(c: pa.Array) -> list:
        """to_pylist(), faster for numbers and for values that repeat."""
        if not c.null_count and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type)):
            return c.to_numpy(zero_copy_only=False).tolist()
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            c = c.dictionary_encode("encode")
            return list(map(c.dictionary.to_pylist().__getitem__, c.indices.to_numpy().tolist()))
        return c.to_pylist()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple, list] = {}
        evals: list[dict[tuple, Callable]] = [{} for _ in handlers]

        def taken() -> pa.RecordBatch:
            arrays = [pa.array([k[i] for k in own], batch_types[i]) for i in range(n)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([pickle.dumps([x.get_partial_result() for x in a]) for a in own.values()], pa.binary())], [*keys, "_partial"])

        for batch in batches:
            values = [listed(c) for c in batch.columns]
            for i in floats:  # one NaN for all
                values[i] = [nan if x != x else x for x in values[i]]
            rows = list(zip(*values[:n], strict=True)) if n else [()] * batch.num_rows
            for key in set(rows) - own.keys():
                own[key] = [h() for h, _ in handlers]
                for e, x in zip(evals, own[key], strict=True):
                    e[key] = x.eval
            for e, (_, at) in zip(evals, handlers, strict=True):
                if len(at) == 1:
                    for key, x in zip(rows, values[at[0]], strict=True):
                        e[key](x)
                else:
                    for key, *x in zip(rows, *(values[i] for i in at), strict=True):
                        e[key](*x)
            if len(own) > HELD:
                yield taken()
                own, evals = {}, [{} for _ in handlers]
        yield taken()

    batch_types = [to_arrow_type(f.dataType) for f in schema.fields]
    partials = frame.select(*keys, *columns).mapInArrow(partial, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), "_partial binary"]))

    def merged(place: int, handler: type, kind: str):
        def run(groups: pd.Series) -> pd.Series:
            results = []
            for parts in groups:
                own = handler()
                for p in parts:
                    own.merge(pickle.loads(p)[place])
                results.append(own.get_final_result())
            return pd.Series(results, dtype=None if any(isinstance(r, float) for r in results) else object)

        return F.pandas_udf(run, kind)

    groups = partials.groupBy(*keys).agg(F.collect_list("_partial").alias("_partials"))
    return groups.select(*keys, *[merged(k, h, kind)("_partials").alias(to) for k, (to, (_, h, kind)) in enumerate(calls.items())])
