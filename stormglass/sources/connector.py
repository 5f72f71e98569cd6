"""A batch reader of feed documents: ``spark.read.format("warning_feed")``.

Options: provider (nws, eccc or meteoalarm); path, a folder or URL prefix with the
feed's documents; country (the European feed's country code); zone or point.  Columns:
provider, request, page_no, body.  Equality filters on ``provider`` and ``request`` are taken
over by the reader, so that only matching documents are fetched.

A GeoJSON scan follows ``pagination.next`` for PAGE_LIMIT pages at most; one that breaks
off, is no FeatureCollection, or exceeds ``timeout`` seconds, fails the read.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLate
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from ..functions import dims

PROVIDERS = ("nws", "eccc", "meteoalarm")


def open_document(place: str, timeout: float) -> str:
    """The whole document within ``timeout`` seconds; a socket's own limit starts anew with each part that comes."""

    def whole() -> str:
        with urlopen(place, timeout=timeout) as f:  # noqa: S310
            return f.read().decode("utf-8")

    if "://" in place:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(whole).result(timeout)
        except TooLate:
            raise TimeoutError(f"{place}: no answer within {timeout:g} s") from None
        finally:
            pool.shutdown(wait=False)
    with open(place, encoding="utf-8") as f:
        return f.read()


def point_of(text: str) -> str | None:
    """The request for a position, rounded to four places; none for a malformed one, which then gives no rows."""
    if not re.match(dims.GPS, text):
        return None
    lat, lon = (round(float(x), 4) for x in text.split(","))
    return f"point={lat},{lon}" if abs(lat) <= 90 and abs(lon) <= 180 else None


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.provider = options.get("provider", "nws")
        if self.provider not in PROVIDERS:
            raise ValueError(f"unknown provider: {self.provider}")
        self.path, self.timeout = options["path"].rstrip("/"), float(options.get("timeout", "30"))
        if self.provider == "nws":
            self.requests = [r for r in (options.get("zone") and f"zone={options['zone']}", point_of(options.get("point", ""))) if r][:1]
        elif self.provider == "eccc":
            self.requests = ["national"]
        else:
            codes = [c.strip().upper() for c in options.get("country", "").split(",") if c.strip()]
            if not codes:
                raise ValueError("no country is set")
            if unknown := [c for c in codes if c not in dims.COUNTRIES]:
                raise ValueError(f"unknown country: {', '.join(unknown)}")
            self.requests = [dims.country_slug(c) for c in codes]

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("request",):
                self.requests = [r for r in self.requests if r == f.value]
            elif isinstance(f, EqualTo) and f.attribute == ("provider",):
                self.requests = self.requests if f.value == self.provider else []
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in self.requests] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        request, began = partition.value, time.monotonic()
        if request is None:
            return
        ending = "xml" if self.provider == "eccc" else "json"
        place: str | None = f"{self.path}/{request}.{ending}"
        for page_no in range(dims.PAGE_LIMIT if self.provider == "nws" else 1):
            # The limit is one for all pages of a fetch.
            left = self.timeout - (time.monotonic() - began)
            if left <= 0:
                raise TimeoutError(f"{request}: no answer within {self.timeout:g} s")
            body = open_document(place, left)
            yield (self.provider, request, page_no, body)
            if self.provider != "nws":
                return
            page = json.loads(body)
            if page.get("type") != "FeatureCollection":
                raise ValueError(f"{request}: {page.get('detail') or page.get('type')}")
            following = (page.get("pagination") or {}).get("next")
            if not following:
                return
            place = following if "://" in following else os.path.join(self.path, following)


class WarningFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warning_feed"

    def schema(self) -> str:
        return "provider string, request string, page_no int, body string"

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarningFeed)
