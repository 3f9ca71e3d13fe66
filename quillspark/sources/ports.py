"""Where the outside world is plugged in: protocols, and the local or standard-library side of each.

Nothing here runs unless it is called: Spark reads recorded bodies, answers come from recordings, and
delivery is a dry run.
"""

from __future__ import annotations

import http.client
import socket
import ssl
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable
from urllib.parse import urljoin, urlsplit

import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from quillspark.functions import urls
from quillspark.sources import guards


@dataclass(frozen=True)
class Response:
    status: int
    url: str
    headers: Mapping[str, str] = field(default_factory=dict)
    body: bytes = b""


@runtime_checkable
class Transport(Protocol):
    """Fetches one URL."""

    def get(self, url: str, headers: Mapping[str, str] | None = None) -> Response: ...

    def close(self) -> None: ...


@runtime_checkable
class Connector(Protocol):
    """Makes items of responses, as the readers do."""

    def __call__(self, responses: DataFrame, **options: object) -> DataFrame: ...


@runtime_checkable
class ModelClient(Protocol):
    """Answers one prompt with text."""

    def complete(self, prompt: str) -> str: ...


@runtime_checkable
class MessageSender(Protocol):
    """Sends one message and gives its id; a dry run sends nothing."""

    def send(self, message: str, dry_run: bool = True) -> str: ...


@runtime_checkable
class ObjectStore(Protocol):
    """Bytes by key."""

    def put(self, key: str, content: bytes) -> None: ...

    def get(self, key: str) -> bytes: ...

    def delete(self, key: str) -> None: ...


class FetchError(ValueError):
    """A fetch that was refused or broken off; the message says why."""


def addresses(host: str) -> list[str]:
    """All addresses that a host has now."""
    return sorted({x[4][0] for x in socket.getaddrinfo(host, None)})


def refusal(url: str, hosts: Iterable[str], resolve: Callable[[str], list[str]] = addresses) -> str | None:
    """Why a URL may not be fetched, or None: the scheme, credentials, the host, and every address of it are judged."""
    at = urlsplit(url)
    host = (at.hostname or "").rstrip(".")
    if at.scheme not in ("http", "https"):
        return "unsupported_scheme"
    if "@" in at.netloc:
        return "credentials_in_url"
    if host not in set(hosts):
        return "host_not_allowed"
    found = resolve(host)
    return "forbidden_address" if not found or any(map(urls.forbidden, found)) else None


class HttpTransport:
    """GET by the standard library.  Redirects are followed by hand, each target judged like a first URL."""

    def __init__(self, judge: Callable[[str], str | None], timeout: float = 20.0, most: int = guards.MAX_BYTES, hops: int = guards.MAX_REDIRECTS) -> None:
        self.judge, self.timeout, self.most, self.hops, self.closed = judge, timeout, most, hops, False

    def _once(self, url: str, headers: Mapping[str, str]) -> tuple[http.client.HTTPConnection, http.client.HTTPResponse]:
        at = urlsplit(url)
        if at.scheme == "https":
            line: http.client.HTTPConnection = http.client.HTTPSConnection(at.hostname, at.port, timeout=self.timeout, context=ssl.create_default_context())
        else:
            line = http.client.HTTPConnection(at.hostname, at.port, timeout=self.timeout)
        line.request("GET", (at.path or "/") + (f"?{at.query}" if at.query else ""), headers=dict(headers))
        return line, line.getresponse()

    def get(self, url: str, headers: Mapping[str, str] | None = None) -> Response:
        if self.closed:
            raise FetchError("closed")
        for _ in range(self.hops + 1):
            if why := self.judge(url):
                raise FetchError(why)
            line, answer = self._once(url, headers or {})
            try:
                given = {k.lower(): v for k, v in answer.getheaders()}
                if 300 <= answer.status < 400 and "location" in given:
                    url = urljoin(url, given["location"])
                    continue
                if answer.status == 200 and given.get("content-type", "").partition(";")[0].strip().lower() not in guards.MEDIA_TYPES:
                    raise FetchError("media_type")
                length = given.get("content-length", "0")
                if not length.isdigit() or int(length) > self.most:
                    raise FetchError("content_length")
                return Response(answer.status, url, given, guards.consume_limited(iter(lambda: answer.read(1 << 16), b""), self.most))
            finally:
                line.close()
        raise FetchError("too_many_redirects")

    def close(self) -> None:
        self.closed = True


class FolderStore:
    """An ObjectStore in a folder of any file system that pyarrow opens; keys are single, safe names."""

    def __init__(self, folder: str) -> None:
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.base, recursive=True)

    def _path(self, key: str) -> str:
        if not key or not key[0].isalnum() or not all(c.isalnum() or c in "._-" for c in key) or not key.isascii():
            raise ValueError(f"not a safe key: {key!r}")
        return f"{self.base}/{key}"

    def put(self, key: str, content: bytes) -> None:
        # written beside and moved, so a reader never sees half of it
        part = f"{self._path(key)}.part"
        with self.fs.open_output_stream(part) as out:
            out.write(content)
        self.fs.move(part, self._path(key))

    def get(self, key: str) -> bytes:
        with self.fs.open_input_stream(self._path(key)) as f:
            return f.read()

    def delete(self, key: str) -> None:
        if self.fs.get_file_info(self._path(key)).type != pafs.FileType.NotFound:
            self.fs.delete_file(self._path(key))
