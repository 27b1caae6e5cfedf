"""Remote report tables read in pages: filters go with the request, each page is a task, failures are tried again."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)

#: What every page holds, and what the reader adds to each row.
PAGE = pa.schema([("unique_key", pa.string()), ("created", pa.timestamp("us", "UTC")), ("complaint_type", pa.string()), ("latitude", pa.float64()), ("longitude", pa.float64())])
REPORTS = "source string, unique_key string, created timestamp, complaint_type string, latitude double, longitude double, page int, attempts int, error string"


class Refused(Exception):
    """The service does not accept the request; asking again would not help."""


@dataclass(frozen=True)
class Window:
    """What a request selects: comparisons of the creation time (all hold), and the kinds asked for (None: all)."""

    times: tuple[tuple[str, datetime], ...] = ()
    kinds: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Retry:
    """Tries of a request, with pauses that double from ``first_s`` up to ``longest_s`` and a fixed share of chance.

    ``Refused`` is not tried again; connection errors and time-outs are.
    """

    tries: int = 5
    first_s: float = 1.0
    longest_s: float = 30.0

    def run(self, call: Callable, token: str):
        """(result, number of tries)."""
        for k in range(1, self.tries + 1):
            try:
                return call(), k
            except OSError:
                if k == self.tries:
                    raise
                chance = zlib.crc32(f"{token}:{k}".encode()) % 1000 / 1000  # so that tasks don't ask in step
                time.sleep(min(self.first_s * (2 ** (k - 1) + chance), self.longest_s))


@dataclass(frozen=True)
class Preset:
    """A remote table of reports: where it is, its columns, its rank among a city's sources, and the words that select kinds."""

    name: str
    city: str
    endpoint: str
    time_column: str
    kind_column: str
    key_column: str
    priority: int
    automated: bool = True
    words: tuple[str, ...] = ()


#: Public report tables by city.
PRESETS = (
    Preset("nyc_311", "new_york", "https://data.cityofnewyork.us/resource/erm2-nwe9.csv", "created_date", "complaint_type", "unique_key", 1, words=("Water", "Flood", "Sewer", "Drain", "Street Condition")),
    Preset("seattle_csr", "seattle", "https://data.seattle.gov/resource/5ngg-rpne.csv", "createddate", "webintakeservicerequests", "servicerequestnumber", 1, words=("DRAIN", "FLOOD", "SEWER", "WATER", "STORM")),
    Preset("chicago_311", "chicago", "https://data.cityofchicago.org/resource/v6vf-nfxy.csv", "created_date", "complaint_type", "unique_key", 2, words=("Water", "Flood", "Sewer", "Drainage")),
)


def list_sources(presets: tuple[Preset, ...] = PRESETS, city: str | None = None, automated: bool | None = None) -> list[Preset]:
    """The sources of a city, by priority."""
    return sorted((p for p in presets if city in (None, p.city) and automated in (None, p.automated)), key=lambda p: (p.priority, p.name))


@dataclass
class HttpPages:
    """Pages of the presets' open-data services, as CSV over HTTP with the selection in the query string.

    Client errors but "too many requests" are ``Refused``. Pages are ordered by time and key, so they don't overlap.
    """

    presets: dict[str, Preset]
    timeout_s: float = 120.0

    def _selection(self, p: Preset, window: Window) -> str:
        quoted = lambda s: "'" + s.replace("'", "''") + "'"
        parts = [f"{p.time_column} {op} {quoted(t.strftime('%Y-%m-%dT%H:%M:%S.%f'))}" for op, t in window.times]
        if window.kinds is not None:
            parts.append(f"{p.kind_column} in ({', '.join(map(quoted, window.kinds))})")
        if p.words:
            parts.append("(" + " OR ".join(f"upper({p.kind_column}) LIKE {quoted('%' + w.upper() + '%')}" for w in p.words) + ")")
        return " AND ".join(parts)

    def _get(self, p: Preset, window: Window, **params) -> bytes:
        chosen = self._selection(p, window)
        asked = {f"${k}": v for k, v in params.items()} | ({"$where": chosen} if chosen else {})
        request = urllib.request.Request(f"{p.endpoint}?{urllib.parse.urlencode(asked)}", headers={"Accept": "text/csv"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if 400 <= e.code < 500 and e.code != 429:
                raise Refused(f"{p.name}: HTTP {e.code}") from e
            raise

    def count(self, source: str, window: Window) -> int:
        return int(self._get(self.presets[source], window, select="count(*) AS n").decode().split("\n")[1].strip('"\r '))

    def page(self, source: str, window: Window, offset: int, limit: int) -> pa.Table:
        p = self.presets[source]
        data = self._get(p, window, limit=limit, offset=offset, order=f"{p.time_column} DESC, {p.key_column}")
        text = pa.csv.read_csv(pa.BufferReader(data), convert_options=pa.csv.ConvertOptions(column_types={c: pa.string() for c in (p.key_column, p.time_column, p.kind_column)}, strings_can_be_null=True))
        # times without a zone, with or without fractions
        made = {"unique_key": p.key_column, "created": p.time_column, "complaint_type": p.kind_column, "latitude": "latitude", "longitude": "longitude"}
        columns = [text.column(c) if c in text.column_names else pa.nulls(len(text), pa.string()) for c in made.values()]
        columns[1] = pc.cast(pc.replace_substring(columns[1], "T", " "), pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
        return pa.table([c.cast(f.type) for c, f in zip(columns, PAGE)], schema=PAGE)


@dataclass
class TablePages:
    """Pages of a Parquet table in any store that Arrow reaches, served like a remote service's: the selection is made here.

    ``columns`` names the table's column for each of the page's; ``source`` the one that tells the sources apart.
    Pages follow the files' order.
    """

    uri: str
    columns: dict[str, str]
    source: str

    def _scan(self, source: str, window: Window):
        store, path = pyarrow.fs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri}")
        table = pyarrow.dataset.dataset(path, filesystem=store, format="parquet", exclude_invalid_files=False)
        own = pyarrow.dataset.field(self.columns["created"])
        kind = table.schema.field(self.columns["created"]).type
        chosen = pyarrow.dataset.field(self.source) == source
        for op, t in window.times:
            bound = pa.scalar(t.replace(tzinfo=None), pa.timestamp("us")).cast(pa.timestamp(kind.unit)).cast(kind)
            chosen &= {">": own > bound, ">=": own >= bound, "<": own < bound, "<=": own <= bound}[op]
        if window.kinds is not None:
            chosen &= pyarrow.dataset.field(self.columns["complaint_type"]).isin(list(window.kinds))
        return table, chosen

    def count(self, source: str, window: Window) -> int:
        table, chosen = self._scan(source, window)
        return table.count_rows(filter=chosen)

    def page(self, source: str, window: Window, offset: int, limit: int) -> pa.Table:
        table, chosen = self._scan(source, window)
        parts = []
        for batch in table.to_batches(columns=list(self.columns.values()), filter=chosen):
            if offset < batch.num_rows and limit > 0:
                parts.append(batch.slice(offset, limit))
                limit -= parts[-1].num_rows
            offset = max(0, offset - batch.num_rows)
            if limit <= 0:
                break
        rows = pa.Table.from_batches(parts, parts[0].schema if parts else table.schema)
        made = [rows.column(self.columns[f.name]) if f.name in self.columns else pa.nulls(len(rows), f.type) for f in PAGE]
        naive = lambda c, f: c.cast(pa.timestamp("us")).cast(f.type) if pa.types.is_timestamp(f.type) and c.type.tz is None else c.cast(f.type)
        return pa.table([naive(c, f) for c, f in zip(made, PAGE)], schema=PAGE)


@dataclass
class Failing:
    """Another service whose pages fail ``times`` times before they are served, and that refuses some sources."""

    service: object
    times: int = 0
    refused: tuple[str, ...] = ()
    seen: dict = field(default_factory=dict)

    def count(self, source: str, window: Window) -> int:
        return self.service.count(source, window)

    def page(self, source: str, window: Window, offset: int, limit: int) -> pa.Table:
        if source in self.refused:
            raise Refused(f"{source} is closed")
        tried = self.seen[source, offset] = self.seen.get((source, offset), 0) + 1
        if tried <= self.times:
            raise ConnectionError(f"try {tried}")
        return self.service.page(source, window, offset, limit)


class PagedReader(DataSourceReader):
    """One partition for each source and page; comparisons of ``created`` and equalities of ``complaint_type`` and ``source``
    go to the service."""

    COMPARE = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, service, sources: tuple[str, ...], rows: int, retry: Retry, skip_failures: bool):
        self.service, self.sources, self.rows, self.retry, self.skip = service, sources, rows, retry, skip_failures
        self.window = Window()

    def pushFilters(self, filters):  # noqa: N802
        times, kinds = list(self.window.times), self.window.kinds
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "created" and type(f) in self.COMPARE:
                at = f.value.astimezone(timezone.utc) if f.value.tzinfo else f.value
                times.append((self.COMPARE[type(f)], at.replace(tzinfo=None)))
            elif name == "complaint_type" and isinstance(f, (EqualTo, In)):
                own = (f.value,) if isinstance(f, EqualTo) else tuple(f.value)
                kinds = own if kinds is None else tuple(k for k in kinds if k in own)
            elif name == "source" and isinstance(f, (EqualTo, In)):
                own = (f.value,) if isinstance(f, EqualTo) else tuple(f.value)
                self.sources = tuple(s for s in self.sources if s in own)
            elif name == "source" and isinstance(f, IsNotNull):
                pass
            elif name in ("created", "complaint_type") and isinstance(f, IsNotNull) and any(g is not f and getattr(g, "attribute", None) == f.attribute for g in filters):
                pass  # implied by the comparison that goes to the service
            else:
                yield f
        self.window = Window(tuple(times), kinds)

    def partitions(self):
        out = []
        for s in self.sources:
            try:
                n, _ = self.retry.run(lambda s=s: self.service.count(s, self.window), f"{s}:count")
            except (OSError, Refused):
                if not self.skip:
                    raise
                n = 1  # its page will tell
            out += [InputPartition((s, k, at, min(self.rows, n - at))) for k, at in enumerate(range(0, n, self.rows))]
        return out or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        source, number, offset, limit = partition.value
        try:
            rows, tries, error = *self.retry.run(lambda: self.service.page(source, self.window, offset, limit), f"{source}:{number}"), None
        except (OSError, Refused) as e:
            if not self.skip:
                raise
            rows, tries, error = pa.table([pa.nulls(1, f.type) for f in PAGE], schema=PAGE), 1 if isinstance(e, Refused) else self.retry.tries, str(e)
        n = len(rows)
        added = {"page": pa.array([number] * n, pa.int32()), "attempts": pa.array([tries] * n, pa.int32()), "error": pa.array([error] * n, pa.string())}
        whole = pa.table({"source": pa.array([source] * n, pa.string()), **{f.name: rows.column(f.name) for f in PAGE}, **added})
        yield from whole.combine_chunks().to_batches(max_chunksize=10_000)


def read_paged(spark: SparkSession, service, sources: list[str], where: Column | None = None, rows: int = 50_000, retry: Retry = Retry(), skip_failures: bool = False) -> DataFrame:
    """Reports of all ``sources`` (see ``REPORTS``), read side by side, a task for each page of ``rows`` rows.

    ``service`` has count(source, window) and page(source, window, offset, limit), and is pickled to the executors.
    What ``where`` asks of ``created``, ``complaint_type`` and ``source`` goes with the requests; this switches the
    session's push-down for Python sources on. A page that fails for good fails the query, or with ``skip_failures``
    becomes one row with ``error`` and nulls, whatever the filters on those columns. Counts are asked once for each source
    when the query is planned.

    Filters put on the result stay in Spark: a loaded Python source keeps the filters of the first query that is planned
    on it, so only ``where`` may reach it. The result is observed (its number of rows), which filters do not pass.
    """
    kind, own = f"paged_{uuid.uuid4().hex}", tuple(sources)

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return kind

        def schema(self):
            return REPORTS

        def reader(self, schema):
            return PagedReader(service, own, rows, retry, skip_failures)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Paged)
    loaded = spark.read.format(kind).load()
    return (loaded if where is None else loaded.where(where)).observe(kind, F.count(F.lit(1)).alias("rows"))


def read_presets(spark: SparkSession, presets: list[Preset], since: datetime, until: datetime, **options) -> DataFrame:
    """The presets' reports of a span of time (ends included), each key once."""
    service = HttpPages({p.name: p for p in presets})
    span = (F.col("created") >= F.lit(since)) & (F.col("created") <= F.lit(until))
    return once(read_paged(spark, service, [p.name for p in presets], span, **options))


def once(reports: DataFrame) -> DataFrame:
    """Each key of a source once, the earliest row of repeated ones; rows without a key pass."""
    keyed = reports.where("unique_key is not null")
    order = F.struct("created", "complaint_type", "latitude", "longitude", "page", "attempts", "error")
    first = keyed.groupBy("source", "unique_key").agg(F.min(order).alias("r")).select("source", "unique_key", "r.*")
    return first.unionByName(reports.where("unique_key is null"))


def source_scores(reports: DataFrame) -> DataFrame:
    """(source, n_rows, failed_pages, score): the score is 100 times the mean share of rows with a time, a kind and a
    place; 0 without rows."""
    ok = F.col("error").isNull()
    share = lambda c: F.avg(F.when(ok, c.cast("double")))
    place = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    score = (share(F.col("created").isNotNull()) + share(F.col("complaint_type").isNotNull()) + share(place)) * 100 / 3
    return reports.groupBy("source").agg(F.count_if(ok).alias("n_rows"), F.count_if(~ok).alias("failed_pages"), F.coalesce(score, F.lit(0.0)).alias("score"))


def fall_through(spark: SparkSession, service, presets: list[str], least: float = 80.0, **options) -> tuple[DataFrame, list[tuple[str, float, int]]]:
    """Sources one after the other, by priority, until one without failed pages scores ``least``: its reports, and
    (source, score, failed pages) of all that were tried.

    If none does, the best-scoring one without failures wins, else the best-scoring one. Each source costs one pass that
    returns one row; a source after the good one is never asked.
    """
    tried, frames = [], {}
    for name in presets:
        frames[name] = read_paged(spark, service, [name], skip_failures=True, **options)
        row = source_scores(frames[name]).first()
        tried.append((name, row.score if row else 0.0, row.failed_pages if row else 0))
        if row and row.score >= least and not row.failed_pages:
            break
    if not tried:
        raise ValueError("no sources")
    passed = tried[-1] if tried[-1][1] >= least and not tried[-1][2] else max(tried, key=lambda x: (not x[2], x[1]))
    return frames[passed[0]].where("error is null"), tried


def ensured(spark: SparkSession, path: str, make: Callable[[], DataFrame], oldest_s: float | None = None, required: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """The Parquet table at ``path``, made and written first if it is missing, older than ``oldest_s`` seconds, or lacks a
    required column; and whether it was made.

    The new table is written beside the old one and then takes its place, so a job that dies leaves the old one.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    place = hadoop(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = hadoop(path, "_SUCCESS")
    if store.exists(mark):
        age = time.time() - store.getFileStatus(mark).getModificationTime() / 1000
        old = spark.read.parquet(path)
        if (oldest_s is None or age <= oldest_s) and set(required) <= set(old.columns):
            return old, False
    made = make()
    if missing := set(required) - set(made.columns):
        raise ValueError(f"the source lacks {sorted(missing)}")
    fresh = hadoop(f"{path}.{uuid.uuid4().hex}")
    made.write.parquet(fresh.toString())
    store.delete(place, True)
    store.mkdirs(place.getParent())
    if not store.rename(fresh, place):
        raise OSError(f"{path} could not be replaced")
    return spark.read.parquet(path), True


def summaries_back(spark: SparkSession, folders: dict[str, str], key: str = "name") -> DataFrame:
    """The summary files of several runs (CSV with headers, as ``write_summaries`` leaves them) in one table by name."""
    parts = [spark.read.option("header", True).option("inferSchema", True).csv(f).withColumn(key, F.lit(n)) for n, f in sorted(folders.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
