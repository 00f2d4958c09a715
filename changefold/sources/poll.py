"""Polled JSON addresses as a stream of responses.

Register with ``spark.dataSource.register(PollSource)`` and read with ``spark.readStream.format("poll")`` and the
options ``urls`` (one or more, by white space) and ``keep``, a folder that driver and executors share; the
query's trigger interval is the poll interval (5 seconds by default in ``poll_trigger``), and the
first batch polls at once. Responses go through ``decode.poll_rows_to_events``.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from hashlib import sha256

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

POLL_MS = 5000


def poll_trigger(ms: int = POLL_MS) -> dict:
    return {"processingTime": f"{ms} milliseconds"}


def fetch(url: str, timeout: float) -> tuple[int, str | None]:
    """(status, body); an address that doesn't answer has status 0."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, None
    except OSError:
        return 0, None


class PollSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "poll"

    def schema(self) -> str:
        return "poll_ts long, status int, body string, address string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        urls = (self.options.get("urls") or self.options["url"]).split()
        return PollReader(urls, float(self.options.get("timeout", 10)), Kept(self.options["keep"]))


class Poll(InputPartition):
    """One poll of one address."""

    def __init__(self, number: int, url: str):
        self.number, self.url = number, url


class Kept:
    """Responses that are kept until their batch is done: a file for each poll of an address, made
    once, so that a task which runs again gives what the first run kept."""

    def __init__(self, folder: str):
        self.folder = folder

    def _open(self) -> tuple[fs.FileSystem, str]:
        where = self.folder if "://" in self.folder or self.folder.startswith("file:") else "file://" + os.path.abspath(self.folder)
        return fs.FileSystem.from_uri(where.replace("file:/", "file:///", 1) if where.startswith("file:/") and not where.startswith("file://") else where)

    def _path(self, root: str, number: int, url: str) -> str:
        return f"{root}/poll={number:012d}/{sha256(url.encode()).hexdigest()[:32]}.json"

    def get(self, number: int, url: str) -> list | None:
        files, root = self._open()
        path = self._path(root, number, url)
        if files.get_file_info(path).type != fs.FileType.File:
            return None
        with files.open_input_stream(path) as f:
            return json.loads(f.read())

    def put(self, number: int, url: str, row: list) -> list:
        """Keep a response, unless one is kept already; what is kept."""
        files, root = self._open()
        path = self._path(root, number, url)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        made = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(made) as f:
            f.write(json.dumps(row).encode())
        if isinstance(files, fs.LocalFileSystem):
            try:
                os.link(made, path)  # fails where another attempt was first
            except FileExistsError:
                pass
            files.delete_file(made)
        elif files.get_file_info(path).type != fs.FileType.File:
            files.move(made, path)
        return self.get(number, url)

    def last(self) -> int:
        """The largest number of a poll that is kept or was marked."""
        files, root = self._open()
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return max((int(x.base_name.removeprefix("poll=")) for x in found if x.base_name.startswith("poll=")), default=0)

    def mark(self, number: int) -> None:
        files, root = self._open()
        files.create_dir(f"{root}/poll={number:012d}", recursive=True)

    def drop(self, number: int) -> None:
        """Delete the polls before this one."""
        files, root = self._open()
        for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith("poll=") and int(x.base_name.removeprefix("poll=")) < number:
                files.delete_dir(x.path)


class PollReader(DataSourceStreamReader):
    """One poll of each address per micro-batch, by the tasks: each keeps its response before it
    gives it, and a batch that is done again reads what was kept. Polls are numbered on, over restarts."""

    def __init__(self, urls: list[str], timeout: float, kept: Kept):
        self.urls, self.timeout, self.kept = urls, timeout, kept
        self.number = None

    def initialOffset(self) -> dict:
        return {"polls": 0}

    def latestOffset(self) -> dict:
        self.number = (self.kept.last() if self.number is None else self.number) + 1
        return {"polls": self.number}

    def partitions(self, start: dict, end: dict) -> list[Poll]:
        self.number = max(self.number or 0, end["polls"])
        self.kept.mark(end["polls"])
        return [Poll(end["polls"], url) for url in self.urls]

    def read(self, partition: Poll) -> Iterator[tuple]:
        row = self.kept.get(partition.number, partition.url)
        if row is None:
            status, body = fetch(partition.url, self.timeout)
            row = self.kept.put(partition.number, partition.url, [int(time.time() * 1000), status, body])
        yield (*row, partition.url)

    def commit(self, end: dict) -> None:
        self.kept.drop(end["polls"])
