"""Repository services as Python data sources: one partition for each seed, pages read inside the task.

spark.dataSource.register(Service); spark.read.format("repository_service").options(kind=…, seeds="a,b", recordings=path).load()
gives (seed, item): item is JSON, to be parsed by citemill.sources.listings. option filter ("public=true&…") goes to the service. kind box probes an archive's head and fetches its page; box_ids gives a range of seeds.
With recordings, a JSON file of url -> reply, nothing goes over the network. A seed that fails gives no rows.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from citemill.sources import http

#: Addresses by kind; the seed takes the braces' place.
ENDPOINTS = {
    "dataverse": "https://dataverse.harvard.edu/api/dataverses/{}/contents",
    "dataset": "https://dataverse.harvard.edu/api/datasets/:persistentId/?persistentId={}",
    "community": "https://zenodo.org/api/records?communities={}",
    "nodes": "https://api.osf.io/v2/nodes/?filter[title]={}",
    "institution": "https://api.osf.io/v2/institutions/{}/nodes/",
    "children": "https://api.osf.io/v2/nodes/{}/children/",
    "files": "https://api.osf.io/v2/nodes/{}/files/",
    "search": "https://api.osf.io/v2/search/?q={}",
    "collections": "https://api.osf.io/v2/collections/?filter[title]={}",
    "collected": "https://api.osf.io/v2/collections/{}/linked_nodes/",
    "doi": "https://api.crossref.org/works/{}",
}
#: Where a box's archive and its page are.
BOX_ARCHIVE, BOX_PAGE = "https://s3.wasabisys.com/zipballs.researchbox.org/ResearchBox_{}.zip", "https://researchbox.org/{}"


def address(kind: str, seed: str, wanted: dict[str, str] | None = None) -> str:
    """Where a seed's first page is, with the filters that the service applies."""
    url = ENDPOINTS[kind].format(urllib.parse.quote(seed, safe=":/" if kind in ("dataset", "doi") else ""))
    return http.with_query(url, **{f"filter[{k}]": v for k, v in (wanted or {}).items()})


def box_ids(first: int, last: int) -> str:
    """The seeds of a probe over a range of boxes."""
    return ",".join(map(str, range(first, last + 1)))


def box(ask, seed: str):
    """What is known of one box: size and date of its archive, by its head alone, and its page as HTML, to be parsed by functions.text; nothing for a box without an archive. ask(url, method) gives (headers, body) or None."""
    zip_url = BOX_ARCHIVE.format(seed)
    head = ask(zip_url, "HEAD")
    if head is not None:
        page = ask(BOX_PAGE.format(seed), "GET")
        size = head[0].get("content-length", "")
        yield {"box_id": seed, "zip_url": zip_url, "zip_size": int(size) if size.isdigit() else 0, "last_modified": head[0].get("last-modified"), "html": page[1].decode("utf-8", "replace") if page else None}


def recorded_reply(recordings: dict):
    """ask() over recordings: "HEAD url" -> headers, and url -> HTML."""
    def ask(url: str, method: str):
        if method == "HEAD":
            return ({k.lower(): str(v) for k, v in recordings[f"HEAD {url}"].items()}, b"") if f"HEAD {url}" in recordings else None
        return ({}, recordings[url].encode()) if isinstance(recordings.get(url), str) else None
    return ask


def items(fetch: http.Fetch, kind: str, seed: str, max_pages: int | None = None, wanted: dict[str, str] | None = None):
    url = address(kind, seed, wanted)
    if kind == "community":
        yield from http.numbered_pages(fetch, url, lambda r: (r.get("hits") or {}).get("hits") or [], max_pages=max_pages)
    elif kind == "files":
        for provider in http.linked_pages(fetch, url):
            below = ((((provider.get("relationships") or {}).get("files") or {}).get("links") or {}).get("related") or {}).get("href")
            yield from http.linked_pages(fetch, below)
    elif kind in ("nodes", "institution", "children", "collections", "collected"):
        yield from http.linked_pages(fetch, url)
    elif reply := fetch(url):
        found = reply.get("data", reply) if kind in ("search", "dataverse") else reply
        yield from found if isinstance(found, list) else [found]


def descendants(fetch: http.Fetch, seed: str):
    """Nodes below a node: its children, then each child's."""
    children = list(items(fetch, "children", seed))
    yield from children
    for child in children:
        yield from descendants(fetch, child["id"])


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(s) for s in self.options.get("seeds", "").split(",") if s]

    def read(self, partition):
        o = self.options
        recordings = None
        if "recordings" in o:
            with urllib.request.urlopen(o["recordings"] if "://" in o["recordings"] else "file://" + o["recordings"]) as f:
                recordings = json.load(f)
        how = {"token": o.get("token"), "pause": float(o.get("pause", 0))}
        pages = int(o["maxpages"]) if "maxpages" in o else int(o["maxPages"]) if "maxPages" in o else None
        wanted = dict(x.split("=", 1) for x in o.get("filter", "").split("&") if "=" in x)
        if o["kind"] == "box":
            found = box(recorded_reply(recordings) if recordings is not None else lambda url, method: http.http_reply(url, method, **how), partition.value)
        else:
            found = items(http.recorded_fetch(recordings) if recordings is not None else http.http_fetch(**how), o["kind"], partition.value, pages, wanted)
        for item in found:
            yield partition.value, json.dumps(item)


class Service(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository_service"

    def schema(self) -> str:
        return "seed string, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
