"""A stream of polls: ``spark.readStream.format("warning_polls")``.

A poll is an offset.  What a poll brought stands in a log, a folder ``poll_seq=N/entry_id=E`` of lines of
JSON (poll_ts, status, detail, request, page_no, body), so a poll can be read again: after a failure, a micro-batch
gets the same documents.  A line without a body tells how the poll of an entry ended, and ``ok`` is the
only status after which its documents count.

Options: ``log``, the folder; to poll feeds as well, ``entries``, a JSON list of objects with an entry_id and the
options of ``warning_feed``, ``interval`` (seconds) and ``start`` (an ISO instant): the number of a poll is then how many intervals
have passed, and it is at its own time, whenever it runs.  A poll that the log lacks is fetched by the task that
reads it and logged in one step before its rows go on; after a standstill only the newest is fetched, as feeds have
no past.  Without ``entries`` the stream replays the log.

Each entry's poll is a partition; files of a log are put together up to PART_BYTES.  A folder may be of any file system that pyarrow knows by its URL.

Cases: an empty or absent log gives no rows; a poll that lists nothing has its status line only; files
whose names begin with a dot or an underscore are no part of the log.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLate
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.error import HTTPError
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .connector import FeedReader

SCHEMA = "entry_id string, poll_seq long, poll_ts timestamp, status string, detail string, request string, page_no int, body string"
#: Bytes of the log that one partition reads, or one file.
PART_BYTES = 2**23
OK, LATE, REFUSED, BROKEN, INVALID = "ok", "timeout", "unreachable", "malformed", "invalid"


def place_of(url: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URL or an absolute path, and the path in it."""
    return fs.FileSystem.from_uri(url if "://" in url or url.startswith("/") else url.replace("file:/", "file:///", 1))


def fetch(options: dict[str, str]) -> list[dict]:
    """What a poll brings: its documents and last a line with its status.

    ``timeout`` bounds the whole fetch, whatever the server does: a socket's own limit starts anew
    with each byte.
    """
    found: list[dict] = []
    limit = float(options.get("timeout", "30"))

    def read() -> None:
        reader = FeedReader(options)
        for part in reader.partitions():
            for _, request, page_no, body in reader.read(part):
                if reader.provider != "eccc":
                    page = json.loads(body)
                    if reader.provider == "meteoalarm" and not isinstance(page.get("warnings"), list):
                        raise ValueError(f"{request}: warnings are no list")
                found.append({"request": request, "page_no": page_no, "body": body})

    pool = ThreadPoolExecutor(1)
    try:
        pool.submit(read).result(limit)
        status, detail = OK, None
    except (TooLate, TimeoutError) as e:
        status, detail = LATE, str(e) or f"no answer within {limit:g} s"
    except json.JSONDecodeError as e:
        status, detail = BROKEN, str(e)
    except (HTTPError, OSError) as e:
        status, detail = REFUSED, str(e)
    except (ValueError, AttributeError) as e:
        status, detail = INVALID, str(e)
    finally:
        pool.shutdown(wait=False)
    return [*(found if status == OK else []), {"status": status, "detail": detail}]


@dataclass
class Fetch(InputPartition):
    """One entry's poll that the log lacks."""

    poll_seq: int
    entry_id: str
    options: dict[str, str]
    poll_ts: str


@dataclass
class Logged(InputPartition):
    """Files of the log, as (poll_seq, entry_id, path)."""

    files: list[tuple[int, str, str]]


class PollReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.log = options["log"].rstrip("/")
        self.entries = json.loads(options.get("entries", "[]"))
        if self.entries:
            self.interval = float(options["interval"])
            self.start = datetime.fromisoformat(options["start"]).timestamp()

    def initialOffset(self) -> dict:
        return {"poll": -1}

    def latestOffset(self) -> dict:
        """The poll that the clock has come to, or the last one of the log."""
        if self.entries:
            return {"poll": int((time.time() - self.start) // self.interval)}
        return {"poll": max((n for n, _ in self._polls()), default=-1)}

    def _polls(self) -> list[tuple[int, str]]:
        system, folder = place_of(self.log)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [(int(f.base_name.removeprefix("poll_seq=")), f.path) for f in found if f.base_name.startswith("poll_seq=")]

    def _files(self, first: int, last: int) -> list[tuple[int, tuple[int, str, str]]]:
        """The files of some polls, each with its size."""
        system, _ = place_of(self.log)
        out = []
        for n, folder in sorted(self._polls()):
            for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if first <= n <= last else ():
                if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and f.size:
                    out.append((f.size, (n, unquote(f.path.rsplit("/entry_id=", 1)[1].split("/")[0]), f.path)))
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = self._files(start["poll"] + 1, end["poll"])
        out: list[InputPartition] = []
        held = PART_BYTES
        for size, file in files:
            if held + size > PART_BYTES:
                out.append(Logged([]))
                held = 0
            out[-1].files.append(file)
            held += size
        newest, here = end["poll"], {file[:2] for _, file in files}
        at = datetime.fromtimestamp(self.start + newest * self.interval, UTC).isoformat() if self.entries else None
        return out + [Fetch(newest, e["entry_id"], {k: str(v) for k, v in e.items()}, at) for e in self.entries if (newest, e["entry_id"]) not in here]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, folder = place_of(self.log)
        files = partition.files if isinstance(partition, Logged) else [(partition.poll_seq, partition.entry_id, self._fetched(system, folder, partition))]
        for poll_seq, entry_id, path in files:
            with system.open_input_stream(path, compression="detect") as f:
                rest = b""
                while block := f.read(2**20):
                    *lines, rest = (rest + block).split(b"\n")
                    yield from (self._row(poll_seq, entry_id, line) for line in lines if line)
                if rest:
                    yield self._row(poll_seq, entry_id, rest)

    @staticmethod
    def _fetched(system: fs.FileSystem, folder: str, poll: Fetch) -> str:
        """The file of a poll, which is fetched if it is not there.  It is named by the poll, so a task that runs twice, or after a failure, leaves one."""
        path = f"{folder}/poll_seq={poll.poll_seq}/entry_id={quote(poll.entry_id, safe='')}/fetched.json"
        if system.get_file_info(path).type != fs.FileType.File:
            lines = [{"poll_ts": poll.poll_ts, **line} for line in fetch(poll.options)]
            system.create_dir(path.rsplit("/", 1)[0])
            part = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4()}"
            with system.open_output_stream(part) as f:
                f.write("".join(json.dumps(line) + "\n" for line in lines).encode("utf-8"))
            system.move(part, path)
        return path

    @staticmethod
    def _row(poll_seq: int, entry_id: str, line: bytes) -> tuple:
        x = json.loads(line)
        return (entry_id, poll_seq, datetime.fromisoformat(x["poll_ts"]), x.get("status"), x.get("detail"), x.get("request"), x.get("page_no"), x.get("body"))


class PollStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warning_polls"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PollReader:
        return PollReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(PollStream)
