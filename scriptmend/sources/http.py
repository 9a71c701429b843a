"""Guarded fetches of small documents, for landing them as files before Spark reads them.

Only paths below one fixed base are fetched; a path that climbs out, a redirect to another host, and a body
over the limit are errors. Failures are tried again with growing pauses. A pinned fetch checks digest and
row count.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable
from typing import Any

MOST_BYTES, RETRIES = 10_000_000, 4

Opener = Callable[[str], Any]


def _open(url: str) -> Any:
    return urllib.request.urlopen(url, timeout=30)


def safe_url(base: str, path: str, params: dict[str, str] | None = None) -> str:
    """``base`` with ``path`` below it."""
    parts = urllib.parse.unquote(path).split("/")
    if ".." in parts or "://" in path or path.startswith("//"):
        raise ValueError(f"unsafe path: {path}")
    query = "?" + urllib.parse.urlencode(params) if params else ""
    return base.rstrip("/") + "/" + urllib.parse.quote(path.lstrip("/")) + query


def fetch(base: str, path: str, params: dict[str, str] | None = None, retries: int = RETRIES, most: int = MOST_BYTES, opener: Opener = _open, pause: Callable[[float], None] = time.sleep) -> bytes:
    url = safe_url(base, path, params)
    host = urllib.parse.urlsplit(base).netloc
    for k in range(retries):
        try:
            with opener(url) as answer:
                if urllib.parse.urlsplit(answer.geturl()).netloc != host:
                    raise ValueError("redirected to another host")
                body = answer.read(most + 1)
        except OSError:
            if k + 1 == retries:
                raise
            pause(2.0**k)
            continue
        if len(body) > most:
            raise ValueError(f"over {most} bytes")
        return body
    raise AssertionError("no attempt was made")


def fetch_json(base: str, path: str, **options: Any) -> Any:
    return json.loads(fetch(base, path, **options))


def fetch_pinned(base: str, path: str, sha256: str, rows: int | None = None, **options: Any) -> bytes:
    """The body, whose digest, and number of lines if given, must be as expected."""
    body = fetch(base, path, **options)
    if hashlib.sha256(body).hexdigest() != sha256:
        raise ValueError("digest differs")
    if rows is not None and len(body.splitlines()) != rows:
        raise ValueError("row count differs")
    return body
