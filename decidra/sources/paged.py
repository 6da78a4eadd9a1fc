"""Tables behind a service that answers queries in pages, as a data source.

A service counts the rows of a condition and hands out pages of them in a fixed order.  Filters that a service can
answer are given to it, so pages that hold no wanted row are never asked for; columns are named by the option ``columns``.  A page
is a task: it is tried again after failures of the line, and fails if it is short, so a table that changes or a transfer
that breaks off is never read in part.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from http.client import HTTPException
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Condition:
    """``operator`` is =, <, <=, >, >=, in, null or known."""

    column: str
    operator: str
    value: object = None


class Service(Protocol):
    def count(self, where: Sequence[Condition]) -> int: ...

    def fetch(self, columns: Sequence[str], where: Sequence[Condition], offset: int, rows: int) -> list[tuple]: ...


class Changed(ValueError):
    """The service has other rows than it declared."""


_OPERATORS = {ds.EqualTo: "=", ds.LessThan: "<", ds.LessThanOrEqual: "<=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.In: "in"}


def condition(f: ds.Filter) -> Condition | None:
    """A filter as the service understands it, if it does."""
    path = getattr(f, "attribute", ())
    if len(path) != 1:
        return None
    if isinstance(f, ds.IsNotNull):
        return Condition(path[0], "known")
    if isinstance(f, ds.IsNull):
        return Condition(path[0], "null")
    operator = _OPERATORS.get(type(f))
    return Condition(path[0], operator, f.value) if operator else None


def text(columns: Sequence[str], where: Sequence[Condition], order: str, offset: int, rows: int) -> str:
    """The query in the words of services that take SQL-like text."""

    def literal(v: object) -> str:
        return str(v) if isinstance(v, int | float) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"

    def one(c: Condition) -> str:
        if c.operator in ("known", "null"):
            return f"{c.column} IS {'NOT ' * (c.operator == 'known')}NULL"
        return f"{c.column} IN ({', '.join(map(literal, c.value))})" if c.operator == "in" else f"{c.column} {c.operator} {literal(c.value)}"

    conditions = f" WHERE {' AND '.join(map(one, where))}" if where else ""
    return f"SELECT {', '.join(columns)}{conditions} ORDER BY {order} LIMIT {rows} OFFSET {offset}"


class Page(ds.InputPartition):
    def __init__(self, offset: int, rows: int, places: object = None):
        self.offset, self.rows, self.places = offset, rows, places


class _Reader(ds.DataSourceReader):
    def __init__(self, service: Service, columns: list[str], page: int, tries: int, wait: float, expected: int | None):
        self.service, self.columns, self.page, self.tries, self.wait, self.expected = service, columns, page, tries, wait, expected
        self.where: list[Condition] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        for f in filters:
            c = condition(f)
            if c is None:
                yield f
            else:
                self.where.append(c)

    def partitions(self) -> list[Page]:
        if self.expected is not None and (n := self._tried(lambda: self.service.count(()))) != self.expected:
            raise Changed(f"the service has {n} rows, {self.expected} were declared")
        total = self._tried(lambda: self.service.count(self.where))
        located = getattr(self.service, "located", lambda *_: None)  # a service that finds pages once needn't search for each
        return [Page(k, n, located(self.where, k, n)) for k in range(0, total, self.page) for n in [min(self.page, total - k)]]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition is None:
            return
        if partition.places is not None:
            rows = self._tried(lambda: self.service.fetch_at(self.columns, self.where, partition.places))
        else:
            rows = self._tried(lambda: self.service.fetch(self.columns, self.where, partition.offset, partition.rows))
        if len(rows) != partition.rows:
            raise Changed(f"{len(rows)} rows at {partition.offset} instead of {partition.rows}")
        yield from rows

    def _tried(self, act):
        """Failures of the line, also within a page, are waited out, twice as long each time."""
        for attempt in range(self.tries):
            try:
                return act()
            except (OSError, HTTPException):
                if attempt + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**attempt)


def source(name: str, service: Service, schema: StructType, page: int = 50_000, tries: int = 4, wait: float = 1.0, expected: int | None = None) -> type[ds.DataSource]:
    """A data source for ``spark.dataSource.register``; ``expected`` is the number of all rows, held against the service's."""

    class Paged(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def _names(self) -> list[str]:
            asked = self.options.get("columns")
            return asked.split(",") if asked else schema.names

        def schema(self) -> StructType:
            return StructType([schema[c] for c in self._names()])

        def reader(self, schema: StructType) -> ds.DataSourceReader:
            return _Reader(service, self._names(), page, tries, wait, expected)

    return Paged


def read(spark: SparkSession, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """The registered source's columns; filters on them go to the service."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    out = spark.read.format(name)
    return (out.option("columns", ",".join(columns)) if columns else out).load()


@dataclass(frozen=True)
class ParquetService:
    """A Parquet table in a folder that all machines see, served in the order of ``order``.

    The table must not change while it is served.  A page costs the row groups that hold it, if the table is sorted."""

    path: str
    order: str

    def _where(self, where: Sequence[Condition]):
        from functools import reduce

        from pyarrow import dataset

        def one(c: Condition):
            x = dataset.field(c.column)
            if c.operator == "in":
                return x.isin(list(c.value))
            plain = {"null": x.is_null, "known": x.is_valid, "=": lambda: x == c.value, "<": lambda: x < c.value, "<=": lambda: x <= c.value, ">": lambda: x > c.value, ">=": lambda: x >= c.value}
            return plain[c.operator]()

        return reduce(lambda a, b: a & b, map(one, where)) if where else None

    def count(self, where: Sequence[Condition]) -> int:
        return sum(r.rows for r in _runs(self, _fixed(where)))

    def fetch(self, columns: Sequence[str], where: Sequence[Condition], offset: int, rows: int) -> list[tuple]:
        return self.fetch_at(columns, where, self.located(where, offset, rows))

    def located(self, where: Sequence[Condition], offset: int, rows: int) -> list[_Place]:
        """Where a page lies: the runs of row groups that hold it."""
        found, before = [], 0
        for run in _runs(self, _fixed(where)):
            first, last = max(offset - before, 0), min(offset + rows - before, run.rows)
            before += run.rows
            if first < last:
                found.append(_Place(tuple((f.path, f.row_groups[0].id) for f in run.fragments), run.keyed, first, last))
        return found

    def fetch_at(self, columns: Sequence[str], where: Sequence[Condition], places: Sequence[_Place]) -> list[tuple]:
        """Reads the places only; of a run of many row groups the order first, then the page's keys."""
        from pyarrow import dataset

        files = {f.path: f for f in dataset.dataset(self.path).get_fragments()}
        return [r for p in places for r in self._page(p, [files[path].subset(row_group_ids=[group]) for path, group in p.groups], columns, self._where(where), dataset.field(self.order))]

    def _page(self, place: _Place, fragments: list, columns: Sequence[str], condition, key) -> list[tuple]:
        from pyarrow import dataset

        first, last = place.first, place.last
        parts = dataset.FileSystemDataset(fragments, fragments[0].physical_schema, fragments[0].format, fragments[0].filesystem)
        if place.keyed and len(fragments) > 1:
            keys = parts.to_table(columns=[self.order], filter=condition, use_threads=False).column(0).sort()
            low, high = keys[first], keys[last - 1]
            earlier = parts.count_rows(filter=key < low if condition is None else condition & (key < low))
            between = (key >= low) & (key <= high)
            condition, first, last = between if condition is None else condition & between, first - earlier, last - earlier
        page = parts.to_table(columns=list(dict.fromkeys([*columns, self.order])), filter=condition, use_threads=False).sort_by(self.order).slice(first, last - first)
        return list(zip(*(page.column(c).to_pylist() for c in columns), strict=True))


@dataclass(frozen=True)
class _Place:
    """Rows ``first`` to ``last`` of a run, by its (file, row group)."""

    groups: tuple[tuple[str, int], ...]
    keyed: bool
    first: int
    last: int


@dataclass(frozen=True)
class _Run:
    """Row groups whose keys lie among each other, and their rows of a condition; ``keyed``: no key is null."""

    fragments: list
    rows: int
    keyed: bool


def _fixed(where: Sequence[Condition]) -> tuple[Condition, ...]:
    return tuple(Condition(c.column, c.operator, tuple(c.value)) if c.operator == "in" else c for c in where)


def _rows(fragment, condition) -> int:
    """Without a condition a fragment counts its whole file."""
    return sum(g.num_rows for g in fragment.row_groups) if condition is None else fragment.count_rows(filter=condition)


@lru_cache(maxsize=4)
def _runs(service: ParquetService, where: tuple[Condition, ...]) -> list[_Run]:
    """Runs in the order of their keys, counted once for each process and condition; of a sorted table a run is a row group."""
    from pyarrow import dataset

    condition, groups = service._where(where), []
    for file in dataset.dataset(service.path).get_fragments():
        for f in file.split_by_row_group():
            (info,) = f.row_groups
            if info.num_rows:
                groups.append(((info.statistics or {}).get(service.order), f))
    keyed = not any(f.count_rows(filter=dataset.field(service.order).is_null()) for _, f in groups)
    if not keyed or any(s is None for s, _ in groups):
        return [_Run([f for _, f in groups], sum(_rows(f, condition) for _, f in groups), keyed)] if groups else []
    runs: list[tuple[list, object]] = []
    for s, f in sorted(groups, key=lambda g: (g[0]["min"], g[0]["max"])):
        if runs and s["min"] <= runs[-1][1]:
            runs[-1] = [*runs[-1][0], f], max(runs[-1][1], s["max"])
        else:
            runs.append(([f], s["max"]))
    return [_Run(fs, sum(_rows(f, condition) for f in fs), True) for fs, _ in runs]
