"""Rasters over HTTP by byte ranges: one version of the file, few requests, and the next chunks on their way while one is decoded.

The first answer's ETag is the version; any later answer of another version is an error, in the same task or, as the version goes with a
partition, in another. Single reads go through a small cache of blocks. For a run of chunks the reader says beforehand which ranges it
will read: neighbouring ones become one request, and as many requests run ahead as fit into a budget of bytes.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections import OrderedDict, deque
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from types import SimpleNamespace

#: Bytes of a cached block, blocks that are kept, bytes between ranges that one request bridges, most bytes of a request, and bytes held and on their way.
BLOCK, BLOCKS, GAP, MOST, BUDGET = 64 << 10, 64, 16 << 10, 8 << 20, 32 << 20
#: Tries of a request, seconds before the second (each next waits twice as long), and seconds that one may take.
TRIES, PAUSE, TIMEOUT = 5, 0.05, 60


class ChangedFile(ValueError):
    """The file is no longer the one that was opened."""


@dataclass
class _Ahead:
    """A request that runs ahead, and how many bytes of it are still to be read."""

    start: int
    end: int
    left: int
    data: Future | None = None
    parts: list = field(default_factory=list)


class HttpFile:
    def __init__(self, url: str, budget: int = BUDGET):
        self.url, self.budget, self.version, self.requests = url, budget, None, 0
        self.blocks: OrderedDict[int, bytes] = OrderedDict()
        self.waiting: deque[_Ahead] = deque()
        self.running: list[_Ahead] = []
        self.pool: ThreadPoolExecutor | None = None
        first = self._fetch(0, BLOCK)
        self.blocks[0] = first

    def __enter__(self) -> HttpFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self.pool:
            self.pool.shutdown(wait=False, cancel_futures=True)

    def _fetch(self, start: int, end: int) -> bytes:
        """Bytes from start to before end, or to the end of the file; tried again after what may pass."""
        why = None
        for attempt in range(TRIES):
            if attempt:
                time.sleep(PAUSE * 2 ** (attempt - 1))
            headers = {"Range": f"bytes={start}-{end - 1}", "Accept-Encoding": "identity"} | ({"If-Match": self.version} if self.version and not self.version.startswith(("W/", "t:")) else {})
            self.requests += 1
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, headers=headers), timeout=TIMEOUT) as answer:
                    if answer.status != 206:
                        raise ValueError(f"{self.url}: the server doesn't answer ranges")
                    self._check(answer.headers)
                    data = answer.read()
                whole = answer.headers["Content-Range"].rpartition("/")[2]
                self.length = int(whole)
                if len(data) == min(end, self.length) - start:
                    return data
                why = f"{len(data)} bytes in place of {min(end, self.length) - start}"
            except urllib.error.HTTPError as e:
                if e.code == 412:
                    raise ChangedFile(f"{self.url} has changed since it was opened") from e
                if e.code == 416 and start:
                    return b""
                if e.code < 500 and e.code not in (408, 429):
                    raise FileNotFoundError(self.url) if e.code in (404, 410) else ValueError(f"{self.url}: {e}") from e
                why = e
            except (urllib.error.URLError, TimeoutError, ConnectionError, EOFError) as e:
                why = e
        raise OSError(f"{self.url}: no answer after {TRIES} tries: {why}")

    def _check(self, headers) -> None:
        version = headers["ETag"] or (f"t:{headers['Last-Modified']}" if headers["Last-Modified"] else None)
        if self.version is None:
            self.version = version
        elif version != self.version:
            raise ChangedFile(f"{self.url} has changed since it was opened")

    def size(self) -> int:
        return self.length

    def read_at(self, n: int, at: int) -> bytes:
        n = max(0, min(n, self.length - at))
        for a in self.running:
            if a.start <= at and at + n <= a.end:
                data = a.data.result()[at - a.start : at - a.start + n]
                a.left -= n
                if a.left <= 0:  # all of it that was asked for has been read
                    self.running.remove(a)
                    self._go_on()
                return data
        first, last = at // BLOCK, (at + n - 1) // BLOCK if n else at // BLOCK - 1
        if last - first >= BLOCKS // 2:
            return self._fetch(at, at + n)
        for k in range(first, last + 1):
            if k in self.blocks:
                self.blocks.move_to_end(k)
                continue
            until = k + 1  # blocks that are missing side by side are one request
            while until <= last and until not in self.blocks:
                until += 1
            data = self._fetch(k * BLOCK, until * BLOCK)
            for j in range(k, until):
                self.blocks[j] = data[(j - k) * BLOCK : (j - k + 1) * BLOCK]
        out = b"".join(self.blocks[k] for k in range(first, last + 1))[at - first * BLOCK :][:n]
        while len(self.blocks) > BLOCKS:
            self.blocks.popitem(last=False)
        return out

    def read(self) -> bytes:
        return self.read_at(self.length, 0)

    def prefetch(self, ranges: list[tuple[int, int]]) -> None:
        """Ranges (offset, size) that will be read, each once."""
        for at, n in sorted(r for r in ranges if r[1]):
            last = self.waiting[-1] if self.waiting else None
            if last and last.start <= at <= last.end + GAP and at + n - last.start <= MOST:
                last.end, last.left = max(last.end, at + n), last.left + n
            else:
                self.waiting.append(_Ahead(at, at + n, n))
        self._go_on()

    def _go_on(self) -> None:
        held = sum(a.end - a.start for a in self.running)
        while self.waiting and (not self.running or held + self.waiting[0].end - self.waiting[0].start <= self.budget):
            a = self.waiting.popleft()
            self.pool = self.pool or ThreadPoolExecutor(4)
            a.data = self.pool.submit(self._fetch, a.start, a.end)
            held += a.end - a.start
            self.running.append(a)


class HttpStore:
    """What the readers ask of a file system, of single files by URL."""

    def open_input_file(self, url: str) -> HttpFile:
        return HttpFile(url)

    open_input_stream = open_input_file

    def get_file_info(self, url: str) -> SimpleNamespace:
        with HttpFile(url) as f:
            return SimpleNamespace(size=f.size(), type=SimpleNamespace(name="File"))
