"""Paged sources: push-down, retries, refusals, HTTP services, and inputs made when they are missing."""

import http.server
import threading
import urllib.parse
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.plans import remote as plans
from tidewatch.sources import remote

FAST = remote.Retry(tries=3, first_s=0.001, longest_s=0.002)


def test_time_filter_goes_with_the_requests(spark, sf_dir):
    service, names = plans.service(spark, sf_dir), ["north", "east", "west"]
    asked = (F.col("created") >= F.lit(plans.SINCE)) & (F.col("complaint_type") == "flood")
    chosen = remote.read_paged(spark, service, names, asked, rows=7, retry=FAST)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(chosen._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(created,2024-01-05" in plan and "EqualTo(complaint_type,flood)" in plan and "Filter (" not in plan
    every = remote.read_paged(spark, service, names, rows=7, retry=FAST)
    want = sorted(r.unique_key for r in every.collect() if r.created and r.created >= plans.SINCE and r.complaint_type == "flood")
    assert 0 < len(want) < every.count() and sorted(r.unique_key for r in chosen.collect()) == want


def test_later_filters_do_not_stick_to_the_source(spark, sf_dir):
    df = remote.read_paged(spark, plans.service(spark, sf_dir), ["north", "east", "west"], rows=50, retry=FAST)
    n = df.count()
    kinds = {k: df.where(F.col("complaint_type") == k).count() for k in ("flood", "drain")}
    assert sum(kinds.values()) == df.count() == n and min(kinds.values()) > 0
    assert df.where("source = 'north'").unionByName(df.where("source <> 'north'")).count() == n


def test_reader_takes_what_the_service_can_select():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan

    r = remote.PagedReader(None, ("a", "b", "c"), 10, FAST, False)
    time = GreaterThan(("created",), datetime(2024, 1, 2))
    rest = list(r.pushFilters([time, IsNotNull(("created",)), In(("source",), ("b", "z")), EqualTo(("complaint_type",), "flood"), LessThan(("latitude",), 3.0), IsNotNull(("latitude",))]))
    assert [type(f).__name__ for f in rest] == ["LessThan", "IsNotNull"]
    assert r.sources == ("b",) and r.window == remote.Window(((">", datetime(2024, 1, 2)),), ("flood",))


def test_retries_refusals_and_failures(spark, sf_dir):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return 7

    assert FAST.run(flaky, "x") == (7, 3)
    with pytest.raises(ConnectionError):
        remote.Retry(tries=2, first_s=0.001).run(lambda: (_ for _ in ()).throw(ConnectionError()), "x")
    closed = plans.service(spark, sf_dir, refused=("north",))
    with pytest.raises(Exception, match="north is closed"):
        remote.read_paged(spark, closed, ["north"], retry=FAST).collect()
    left = remote.read_paged(spark, closed, ["north", "west"], retry=FAST, skip_failures=True)
    assert [(r.source, r.error) for r in left.where("error is not null").collect()] == [("north", "north is closed")]
    dead = plans.service(spark, sf_dir, times=9)
    got = remote.read_paged(spark, dead, ["west"], rows=10_000, retry=FAST, skip_failures=True).collect()
    assert [(r.attempts, r.error) for r in got] == [(3, "try 3")]
    chosen, tried = remote.fall_through(spark, dead, ["west", "east"], retry=FAST)
    assert chosen.count() == 0 and [n for n, *_ in tried] == ["west", "east"]
    with pytest.raises(ValueError):
        remote.fall_through(spark, dead, [])


def test_pages_cover_all_rows_once(spark, sf_dir):
    service = plans.service(spark, sf_dir)
    for rows in (1, 3, 1000):
        if rows == 1 and service.count("north", remote.Window()) > 200:
            continue
        pages = remote.read_paged(spark, service, ["north"], rows=rows)
        assert pages.count() == service.count("north", remote.Window()) == pages.select("unique_key").distinct().count()
    none = remote.Window(((">", datetime(2030, 1, 1)),))
    assert service.count("north", none) == 0 and len(service.page("north", none, 0, 10)) == 0


class Reports(http.server.BaseHTTPRequestHandler):
    rows = [(f"k{i // 2 * 2}", f"2024-01-{i + 1:02d}T05:00:00.000", "Flooding" if i % 2 else "Drain, blocked", 47.5, -122.4) for i in range(20)]
    busy = 2
    asked: list = []

    def do_GET(self):  # noqa: N802
        asked = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
        type(self).asked.append(asked)
        if "bad" in self.path:
            return self.send_error(404)
        if type(self).busy:
            type(self).busy -= 1
            return self.send_error(429)
        low = asked["$where"].split(">= '")[1].split("'")[0]
        rows = [r for r in self.rows if r[1] >= low[:23]]
        if "$select" in asked:
            text = f'"n"\n"{len(rows)}"\n'
        else:
            rows = rows[int(asked["$offset"]) :][: int(asked["$limit"])]
            text = "unique_key,created_date,complaint_type,latitude,longitude\n" + "".join(f'{k},{t},"{c}",{y},{x}\n' for k, t, c, y, x in rows)
        self.send_response(200)
        self.end_headers()
        self.wfile.write(text.encode())

    def log_message(self, *args):
        pass


def test_http_service(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Reports)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        good = remote.Preset("town", "town", f"{at}/reports.csv", "created_date", "complaint_type", "unique_key", 1, words=("flood", "o'drain"))
        got = remote.read_presets(spark, [good], datetime(2024, 1, 5), datetime(2024, 1, 31), rows=6, retry=remote.Retry(first_s=0.01)).collect()
        assert len(got) == 8 and {r.complaint_type for r in got} == {"Drain, blocked"} and min(r.created for r in got) == datetime(2024, 1, 5, 5)
        assert any("upper(complaint_type) LIKE '%O''DRAIN%'" in a["$where"] and "created_date <=" in a["$where"] for a in Reports.asked)
        closed = remote.Preset("shut", "town", f"{at}/bad.csv", "created_date", "complaint_type", "unique_key", 2)
        with pytest.raises(remote.Refused):
            remote.HttpPages({"shut": closed}).count("shut", remote.Window())
    finally:
        server.shutdown()


def test_presets_by_city():
    assert [p.name for p in remote.list_sources(city="seattle")] == ["seattle_csr"]
    assert [p.name for p in remote.list_sources()] == ["nyc_311", "seattle_csr", "chicago_311"]
    assert remote.list_sources(automated=False) == []


def test_ensured_table(spark, tmp_path):
    path, made = f"file://{tmp_path}/t", []

    def make(n=3):
        made.append(n)
        return spark.range(n).withColumnRenamed("id", "precipitation_mm")

    assert remote.ensured(spark, path, make, required=("precipitation_mm",))[1] and not remote.ensured(spark, path, make)[1]
    other, fresh = remote.ensured(spark, path, lambda: spark.range(5).withColumnRenamed("id", "rain"), required=("rain",))
    assert fresh and other.count() == 5 and made == [3]
    with pytest.raises(ValueError):
        remote.ensured(spark, path, make, oldest_s=-1, required=("rain",))
    assert spark.read.parquet(path).count() == 5


def test_summaries_back(spark, tmp_path):
    from tidewatch.sources.writers import write_summaries

    write_summaries(spark.createDataFrame([("mean", 1.5), ("max", 9.0)], "metric string, value double"), str(tmp_path / "a"))
    write_summaries(spark.createDataFrame([("mean", 2.5, 7)], "metric string, value double, n int"), str(tmp_path / "b"))
    back = remote.summaries_back(spark, {"first": str(tmp_path / "a"), "second": str(tmp_path / "b")})
    assert sorted((r.name, r.metric, r.value, r.n) for r in back.collect()) == [("first", "max", 9.0, None), ("first", "mean", 1.5, None), ("second", "mean", 2.5, 7)]
