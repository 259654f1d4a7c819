"""A paged paper API as a Spark data source, for batches and for streams.

Each year of the wanted range is a window and a partition of its own; within a window pages follow one another. The
transport is a parameter, so that tests need no network.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from noctiluca import schema
from noctiluca.operators.records import finalize
from noctiluca.session import cut

ROW = "window int, start int, pos int, title string, abstract string, category string, primary_category string, authors string, published string, updated string, url string, year string, error string"
SPACES = {"a": "http://www.w3.org/2005/Atom", "x": "http://arxiv.org/schemas/atom"}
ATTEMPTS, WAIT = 4, 4.0


class FetchError(RuntimeError):
    """A page could not be had."""


class HttpStatus(Exception):
    """What a transport raises for an answer other than success."""

    def __init__(self, code: int):
        super().__init__(f"HTTP {code}")
        self.code = code


def category_query(categories: list[str]) -> str:
    named = [c.strip() for c in categories if c.strip()] or list(schema.CATEGORIES)
    return " OR ".join("cat:" + c for c in named)


def year_bounds(from_year: int | None, to_year: int | None) -> tuple[int, int] | None:
    """Both bounds in order; one alone stands for itself; none gives None."""
    given = [y for y in (from_year, to_year) if y is not None]
    return (min(given), max(given)) if given else None


def year_query(from_year: int | None = None, to_year: int | None = None) -> str:
    bounds = year_bounds(from_year, to_year)
    return f"submittedDate:[{bounds[0]}0101000000 TO {bounds[1]}1231235959]" if bounds else ""


def combine(*parts: str) -> str:
    stated = [p.strip() for p in parts if p and p.strip()]
    return stated[0] if len(stated) == 1 else " AND ".join(f"({p})" for p in stated)


def windows(from_year: int | None, to_year: int | None) -> list[int | None]:
    """The years of the range, newest first; a single window without bounds if there is none."""
    bounds = year_bounds(from_year, to_year)
    return list(range(bounds[1], bounds[0] - 1, -1)) if bounds else [None]


def http_transport(base: str) -> Callable[[str, int, int, float], str]:
    def get(query: str, start: int, count: int, timeout: float) -> str:
        asked = urllib.parse.urlencode({"search_query": query, "start": start, "max_results": count, "sortBy": "submittedDate", "sortOrder": "descending"})
        try:
            with urllib.request.urlopen(f"{base}?{asked}", timeout=timeout) as answer:
                return answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            raise HttpStatus(e.code) from e

    return get


def fetch_page(transport: Callable[[str, int, int, float], str], query: str, start: int, count: int, timeout: float = 30, sleep: Callable[[float], None] = time.sleep) -> list[tuple]:
    """One page as rows without window, start and pos. Too many requests, time-outs and network errors are tried again
    with growing pauses, any other status fails at once."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return parse_page(transport(query, start, count, timeout))
        except HttpStatus as e:
            if e.code != 429 or attempt == ATTEMPTS:
                raise FetchError(f"status {e.code} at {start}") from e
        except (TimeoutError, OSError) as e:
            if attempt == ATTEMPTS:
                raise FetchError(f"no answer at {start}: {e}") from e
        sleep(WAIT * attempt)
    raise AssertionError


def parse_page(xml: str) -> list[tuple]:
    squeeze = lambda s: " ".join((s or "").split())
    rows = []
    for entry in ET.fromstring(xml).iterfind("a:entry", SPACES):
        terms = [c.get("term", "") for c in entry.iterfind("a:category", SPACES)]
        stated = entry.find("x:primary_category", SPACES)
        ranked = [stated.get("term", "") if stated is not None else "", *[t for t in terms if t.startswith(schema.PREFIX)][:1], *terms[:1], "unknown"]
        category = next(t for i, t in enumerate(ranked) if t or i == len(ranked) - 1)
        published = entry.findtext("a:published", "", SPACES)
        names = [squeeze(a.findtext("a:name", "", SPACES)) for a in entry.iterfind("a:author", SPACES)]
        rows.append((squeeze(entry.findtext("a:title", "", SPACES)), squeeze(entry.findtext("a:summary", "", SPACES)), category, category, ", ".join(n for n in names if n), published, entry.findtext("a:updated", "", SPACES), entry.findtext("a:id", "", SPACES), published[:4]))
    return rows


def read_window(transport: Callable[[str, int, int, float], str], query: str, window: int | None, limit: int, page: int, start: int = 0, pause: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """Rows of one window, page after page, until a page is empty or short or ``limit`` rows were had. A page that can't
    be had ends the window with one row that carries the error, so that other windows go on and it can be counted."""
    had = 0
    while had < limit:
        count = min(page, limit - had)
        try:
            rows = fetch_page(transport, query, start, count, sleep=sleep)
        except FetchError as e:
            yield (window, start, -1, *[None] * 9, str(e))
            return
        for pos, row in enumerate(rows):
            yield (window, start, pos, *row, None)
        had += len(rows)
        start += count
        if len(rows) < count:
            return
        if had < limit:
            sleep(pause)


class Window(InputPartition):
    def __init__(self, year: int | None, start: int = 0, count: int | None = None):
        self.year, self.start, self.count = year, start, count


def _transport(options: dict) -> Callable[[str, int, int, float], str]:
    """The transport named by the option ``transport`` (module:function, called with the options), else HTTP."""
    if "transport" in options:
        import importlib

        module, _, name = options["transport"].partition(":")
        return getattr(importlib.import_module(module), name)(options)
    if "url" not in options:
        raise ValueError("paper_api: option url or transport is needed")
    return http_transport(options["url"])


def _number(options: dict, key: str, default: int | None) -> int | None:
    return int(options[key]) if options.get(key) not in (None, "") else default


def _query(options: dict, year: int | None) -> str:
    return combine(category_query(options.get("categories", "").split(",")), year_query(year, year))


class PaperApiReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Window]:
        return [Window(y) for y in windows(_number(self.options, "from_year", None), _number(self.options, "to_year", None))]

    def read(self, partition: Window) -> Iterator[tuple]:
        pause = float(self.options.get("pause", 3.0))
        yield from read_window(_transport(self.options), _query(self.options, partition.year), partition.year, _number(self.options, "max_results", 500), _number(self.options, "page", 100), pause=pause, sleep=lambda s: time.sleep(min(s, float(self.options.get("longest_wait", s)))))


class PaperApiStream(DataSourceStreamReader):
    """Every trigger takes what has come since the last one: an offset holds, per window, up to which record it was read.
    Offsets depend on the API alone and not on what this object remembers, so after a restart they go on where the
    checkpoint stands. A window that can't be asked stays where it is and is asked again at the next trigger."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.years = windows(_number(options, "from_year", None), _number(options, "to_year", None))
        self.page = _number(options, "page", 100)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {str(y): 0 for y in self.years}

    def _end(self, year: int | None) -> int:
        """The start of the first page that is empty, by halving."""
        most = -(-_number(self.options, "max_results", 500) // self.page)
        low, high = self.known.get(str(year), 0) // self.page, most
        while low < high:
            mid = (low + high) // 2
            if fetch_page(_transport(self.options), _query(self.options, year), mid * self.page, 1, sleep=lambda s: time.sleep(min(s, float(self.options.get("longest_wait", s))))):
                low = mid + 1
            else:
                high = mid
        return low * self.page

    def latestOffset(self) -> dict:
        for year in self.years:
            try:
                self.known[str(year)] = self._end(year)
            except FetchError:
                self.known.setdefault(str(year), 0)
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Window]:
        spans = [(y, start.get(str(y), 0), end.get(str(y), 0)) for y in self.years]
        return [Window(y, at, min(self.page, hi - at)) for y, lo, hi in spans for at in range(lo, hi, self.page)]

    def read(self, partition: Window) -> Iterator[tuple]:
        yield from read_window(_transport(self.options), _query(self.options, partition.year), partition.year, partition.count, self.page, partition.start, pause=0)

    def commit(self, end: dict) -> None:
        for year, at in end.items():  # what was committed before a restart is known again
            self.known[year] = max(self.known.get(year, 0), at)


class PaperApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paper_api"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> PaperApiReader:
        return PaperApiReader(self.options)

    def streamReader(self, schema) -> PaperApiStream:
        return PaperApiStream(self.options)


def fetch(spark: SparkSession, cache: str | None = None, limit: int = 500, **options) -> tuple[DataFrame, DataFrame]:
    """(papers, errors): fetched records in arrival order (newest window first, then page, then position), filtered,
    without repetitions, at most ``limit``, with dense ids. If nothing was fetched and ``cache`` is a CSV of records, that
    is taken instead, whatever was asked for. Errors are rows (window, start, error); with no records at all they raise."""
    from noctiluca.sources.csv import read_papers

    spark.dataSource.register(PaperApi)
    rows = cut(spark.read.format("paper_api").options(**{k: str(v) for k, v in ({"max_results": limit} | options).items() if v is not None}).load())
    errors = rows.where("error is not null").select("window", "start", "error")
    good = rows.where("error is null")
    if good.limit(1).count():
        arrival = F.struct((-F.coalesce("window", F.lit(0))).alias("w"), "start", "pos")
        return finalize(good.withColumn("_at", arrival).drop("window", "start", "pos", "error"), limit, "_at").drop("_at"), errors
    if cache:
        try:
            return finalize(read_papers(spark, cache), limit, "paper_id"), errors
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    first = errors.first()
    raise FetchError(f"no records{': ' + first['error'] if first else ''}, and no cached ones")


def describe(counters: DataFrame) -> str:
    """One line of JSON with the counters of a fetch."""
    return json.dumps(counters.first().asDict())
