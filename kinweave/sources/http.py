"""A paged HTTP source for Spark: partitions of ids, tokens, retries, and pages.

fetch(ids, url, ...) asks for the ids of a DataFrame, wherever its rows are. The
same as a data source: `spark.dataSource.register(HttpSource)`, then
spark.read.format("paged_http") with options url (a template with {ids}), ids
(comma list), batch (ids for each request) and those of Plan. Rows are (request,
ordinal, body): JSON text of each item, to be parsed with a declared schema (see
platform). Null items are dropped; ordinals number items over a request's pages.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Unauthorised(Exception):
    pass


def get_json(url: str, headers: dict[str, str] | None = None, tries: int = 4, pause: float = 0.5, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep, linear: bool = False):
    """GET, with waits of pause * 2**n (or linear steps) between tries; a 429 waits as long as Retry-After says; 401 raises Unauthorised."""
    for n in range(tries):
        try:
            with opener(urllib.request.Request(url, headers=headers or {}), timeout=30) as r:
                return json.loads(r.read().decode("utf-8"))
        except urllib.error.HTTPError as e:
            if e.code == 401:
                raise Unauthorised(url) from e
            if e.code != 429 and e.code < 500 or n == tries - 1:
                raise
            wait = float(e.headers.get("Retry-After") or 0) if e.code == 429 else 0.0
        except (urllib.error.URLError, TimeoutError):
            if n == tries - 1:
                raise
            wait = 0.0
        sleep(wait or (pause * (n + 1) if linear else pause * 2**n))
    raise RuntimeError("unreachable")


class Token:
    """A cached token, fetched again when it is near its end or was refused."""

    def __init__(self, fetch: Callable[[], tuple[str, float]], clock: Callable[[], float] = time.time):
        self.fetch, self.clock, self.value, self.until = fetch, clock, "", 0.0

    def get(self, fresh: bool = False) -> str:
        if fresh or self.clock() > self.until - 30:
            self.value, life = self.fetch()
            self.until = self.clock() + life
        return self.value


def client_token(url: str, client: str, secret: str, opener: Callable = urllib.request.urlopen) -> tuple[str, float]:
    """(token, seconds it lasts) for a client's credentials."""
    import base64

    basic = base64.b64encode(f"{client}:{secret}".encode()).decode()
    ask = urllib.request.Request(url, b"grant_type=client_credentials", {"Authorization": f"Basic {basic}", "Content-Type": "application/x-www-form-urlencoded"})
    with opener(ask, timeout=30) as r:
        got = json.loads(r.read().decode("utf-8"))
    return got["access_token"], float(got.get("expires_in", 3600))


def dig(page, path: str):
    """The value at a dotted path, None where it ends early; an empty path is the page itself."""
    for name in path.split(".") if path else []:
        page = page.get(name) if isinstance(page, dict) else None
    return page


def _items(page, item: str) -> list:
    got = dig(page, item)
    return [got] if isinstance(got, dict) else got or []


def pages(url: str | None, item: str, next_field: str | None, get: Callable = get_json) -> Iterator[dict]:
    """The items of all pages, nulls dropped; an object in the place of a list is one item."""
    while url:
        page = get(url)
        yield from (x for x in _items(page, item) if x is not None)
        url = dig(page, next_field) if next_field else None


def pages_by_offset(url: str, item: str, limit: int, get: Callable = get_json, most: int | None = None) -> Iterator[dict]:
    """Pages of a url with {offset} and {limit}, until one has fewer than `limit` items, or `most` items are there."""
    offset = 0
    while most is None or offset < most:
        got = _items(get(url.replace("{offset}", str(offset)).replace("{limit}", str(limit)).replace("{page}", str(offset // limit + 1))), item)
        for i, x in enumerate(got):
            if x is not None and (most is None or offset + i < most):
                yield x
        if len(got) < limit:
            return
        offset += limit


@dataclass(frozen=True)
class Plan:
    """How a request is made and paged: url (with {ids}, and {offset} or {page} and {limit} where pages are counted), the path of the
    items, the path of the next page's url, the items of a page, the most items of a request, and a fixed token or the place to get one."""

    url: str
    item: str = "items"
    next: str | None = None
    limit: int = 50
    most: int | None = None
    token: str | None = None
    token_url: str | None = None
    client: str = ""
    secret: str = ""
    tries: int = 4
    pause: float = 0.5

    @classmethod
    def of(cls, options: dict) -> Plan:
        kinds = {"limit": int, "most": int, "tries": int, "pause": float}
        names = {f.name for f in fields(cls)}
        return cls(**{k: kinds.get(k, str)(v) for k, v in options.items() if k in names})

    def getter(self) -> Callable:
        """GET with this plan's token; a refused token is fetched again, once for each request."""
        held = Token(lambda: client_token(self.token_url, self.client, self.secret)) if self.token_url else None

        def get(url: str):
            for fresh in (False, True):
                value = held.get(fresh) if held else self.token
                try:
                    return get_json(url, {"Authorization": f"Bearer {value}"} if value else {}, self.tries, self.pause)
                except Unauthorised:
                    if held is None or fresh:
                        raise

        return get

    def ask(self, ids: str, get: Callable) -> Iterator[dict]:
        url = self.url.replace("{ids}", urllib.parse.quote(ids, safe=","))
        if "{offset}" in url or "{page}" in url:
            return pages_by_offset(url, self.item, self.limit, get, self.most)
        return pages(url, self.item, self.next, get)


def answers(ids: DataFrame, plan: Plan, batch: int = 50, per_second: float | None = None) -> DataFrame:
    """request, ordinal, body: the answers for the rows of a column id, `batch` ids to a request; every task asks for its own with its own token, at most per_second requests a second."""

    def run(batches):
        import pandas as pd

        held, due = [], [0.0]
        ask = plan.getter()

        def get(url: str):
            if per_second:
                time.sleep(max(0.0, due[0] - time.monotonic()))
                due[0] = time.monotonic() + 1 / per_second
            return ask(url)

        def frame(some):
            request = ",".join(some)
            return pd.DataFrame([(request, i, json.dumps(x)) for i, x in enumerate(plan.ask(request, get))], columns=["request", "ordinal", "body"])

        for pdf in batches:
            held += list(pdf["id"])
            while len(held) >= batch:
                yield frame(held[:batch])
                held = held[batch:]
        if held:
            yield frame(held)

    return ids.mapInPandas(run, "request string, ordinal long, body string")


def fetch(ids: DataFrame, column: str, plan: Plan, batch: int = 50, per_second: float | None = None) -> DataFrame:
    """answers() for the distinct ids of a column."""
    return answers(ids.select(F.col(column).cast("string").alias("id")).where("id is not null").distinct(), plan, batch, per_second)


class _Batch(InputPartition):
    def __init__(self, value: str):
        super().__init__(value)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.o = dict(options)

    def partitions(self):
        ids, n = [x for x in self.o.get("ids", "").split(",") if x], int(self.o.get("batch", "50"))
        return [_Batch(",".join(ids[i : i + n])) for i in range(0, len(ids), n)] or [_Batch("")]

    def read(self, partition):
        plan = Plan.of(self.o)
        if "{ids}" in plan.url and not partition.value:
            return
        for i, x in enumerate(plan.ask(partition.value, plan.getter())):
            yield (partition.value, i, json.dumps(x))


class HttpSource(DataSource):
    @classmethod
    def name(cls):
        return "paged_http"

    def schema(self):
        return "request string, ordinal long, body string"

    def reader(self, schema):
        return _Reader(self.options)
