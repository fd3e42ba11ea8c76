"""Fetching JSON: over HTTP with retries, or from recordings. Connectors only see fetch(url) -> dict | None."""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import BinaryIO

Fetch = Callable[[str], dict | None]


def _asked(use, url: str, method: str = "GET", token: str | None = None, timeout: float = 30, retries: int = 3, delay: float = 1.0, pause: float = 0.0, data: bytes | None = None, opener: urllib.request.OpenerDirector | None = None):
    """What use(reply) gives, or None. Up to retries + 1 tries, waiting longer each time; 4xx and addresses that can't be asked for aren't tried again. pause: seconds before each request."""
    headers = {"Accept": "*/*"} | ({"Authorization": f"Bearer {token}"} if token else {})
    ask = opener.open if opener else urllib.request.urlopen
    for attempt in range(retries + 1):
        try:
            time.sleep(pause)
            with ask(urllib.request.Request(url, data, headers, method=method), timeout=timeout) as reply:
                return use(reply)
        except urllib.error.HTTPError as error:
            if error.code < 500 and error.code != 429:
                return None
        except (http.client.InvalidURL, ValueError):
            return None
        except (OSError, http.client.HTTPException):  # no connection, or one that broke off
            pass
        if attempt < retries:
            time.sleep(delay * (attempt + 1))
    return None


def http_reply(url: str, method: str = "GET", **how) -> tuple[dict[str, str], bytes] | None:
    """(headers, body), or None."""
    return _asked(lambda reply: ({k.lower(): v for k, v in reply.headers.items()}, reply.read()), url, method, **how)


def http_copy(url: str, keep: Callable[[BinaryIO], int | None], **how) -> int | None:
    """What keep(body) gives; it is called with the open reply of each try, must begin anew, and raises OSError for a body that broke off."""
    return _asked(keep, url, **how)


def http_post(url: str, values: dict, **how) -> dict | None:
    """The JSON reply to a form."""
    reply = http_reply(url, "POST", data=urllib.parse.urlencode(values).encode(), **how)
    try:
        return json.loads(reply[1]) if reply else None
    except ValueError:
        return None


def logged_in(url: str, form: dict[str, str], **how) -> urllib.request.OpenerDirector | None:
    """A session, by its cookies, for which a form was accepted; None where it wasn't."""
    opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor())
    return opener if http_reply(url, "POST", data=urllib.parse.urlencode(form).encode(), opener=opener, **how) else None


def http_fetch(**how) -> Fetch:
    """JSON replies; one that isn't JSON is none, and isn't asked for again."""
    def fetch(url: str) -> dict | None:
        reply = http_reply(url, **how)
        try:
            return json.loads(reply[1]) if reply else None
        except ValueError:
            return None
    return fetch


def recorded_fetch(recordings: dict[str, dict]) -> Fetch:
    return recordings.get


def with_query(url: str, **parameters) -> str:
    return f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(parameters)}" if parameters else url


def numbered_pages(fetch: Fetch, url: str, items: Callable[[dict], list], size: int = 100, max_pages: int | None = None) -> Iterator[dict]:
    """Items of pages 1, 2, … until an empty page, a failure, or max_pages."""
    page = 1
    while max_pages is None or page <= max_pages:
        reply = fetch(with_query(url, page=page, size=size))
        found = items(reply) if reply else []
        if not found:
            return
        yield from found
        page += 1


def linked_pages(fetch: Fetch, url: str | None) -> Iterator[dict]:
    """Items of JSON:API pages, following links.next."""
    while url:
        reply = fetch(url)
        if not reply:
            return
        yield from reply.get("data") or []
        url = (reply.get("links") or {}).get("next")
