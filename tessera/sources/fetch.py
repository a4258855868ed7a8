"""Fetching an archive of documentation from pinned places: resolve, probe, download, extract, record. Runs on the driver, beside any Spark work."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime

from tessera.sources.archive import members
from tessera.sources.files import check_cached, check_marker

MARKER = "fetched.json"
_VERSION = re.compile(r"\d+\.\d+")
_BLOCK = 1 << 20


@dataclass(frozen=True)
class Site:
    """Where versions of a documentation are. ``page`` names the archive of a ``{version}``; ``archives`` are known places of it, tried in order where the page
    doesn't; ``prefixes`` are all that an archive's url may begin with; ``sections`` are the folders that are wanted."""

    page: str
    archives: tuple[str, ...]
    prefixes: tuple[str, ...]
    sections: tuple[str, ...]
    timeout: float = 60.0

    @property
    def hosts(self) -> set[str]:
        return {urllib.parse.urlsplit(p).netloc for p in (*self.prefixes, self.page)}

    def pinned(self, url: str) -> bool:
        return any(url.startswith(p) for p in self.prefixes) and ".." not in url


class _Pinned(urllib.request.HTTPRedirectHandler):
    """Follows redirects to the site's own hosts only, and to no lesser scheme."""

    def __init__(self, site: Site):
        self.site = site

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        old, new = urllib.parse.urlsplit(req.full_url), urllib.parse.urlsplit(newurl)
        if new.netloc not in self.site.hosts or (old.scheme == "https" and new.scheme != "https"):
            raise urllib.error.URLError(f"redirect to {newurl} leaves the pinned hosts")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def _open(site: Site, url: str, method: str = "GET"):
    return urllib.request.build_opener(_Pinned(site)).open(urllib.request.Request(url, method=method), timeout=site.timeout)


def probe(site: Site, urls: list[str]) -> str:
    """The first url that answers; the first of all where none does, so that the download fails by its name."""
    for url in urls:
        try:
            with _open(site, url, "HEAD") as r:
                if r.status == 200:
                    return url
        except (urllib.error.URLError, OSError):
            continue
    return urls[0]


def resolve(site: Site, version: str) -> str:
    """The archive's url: the first pinned one that the page names for this version, else a known place."""
    if not _VERSION.fullmatch(version):
        raise ValueError(f"version {version!r} is not of the form N.N")
    known = [a.format(version=version) for a in site.archives]
    try:
        with _open(site, site.page.format(version=version)) as r:
            body = r.read().decode("utf-8", "replace")
    except (urllib.error.URLError, OSError):
        return probe(site, known)
    for url in re.findall(r"""https?://[^\s"'<>]+?\.zip""", body):
        if site.pinned(url) and f"/{version}/" in url:
            return url
    return probe(site, known)


def download(site: Site, url: str, path: str) -> str:
    """SHA-256 of what ``url`` gives. ``path`` only ever holds a whole file."""
    if not site.pinned(url):
        raise ValueError(f"{url} is not at a pinned place")
    part, h = path + ".part", hashlib.sha256()
    try:
        with _open(site, url) as r, open(part, "wb") as out:
            while block := r.read(_BLOCK):
                out.write(block)
                h.update(block)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return h.hexdigest()


def _save(path: str, data: dict) -> None:
    with open(path, "w") as f:
        json.dump(data, f, indent=2)
        f.write("\n")


def write_provenance(path: str, url: str, sha256: str) -> None:
    _save(path + ".provenance.json", {"zip_url": url, "zip_sha256": sha256})


def read_provenance(path: str) -> dict | None:
    try:
        with open(path + ".provenance.json") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def read_marker(root: str, site: Site) -> dict | None:
    """The marker of a fetched folder; None where there is none or it isn't whole."""
    try:
        with open(os.path.join(root, MARKER)) as f:
            marker = json.load(f)
        check_marker(marker, site.prefixes)
    except (OSError, ValueError, KeyError):
        return None
    return marker


def move(old: str, new: str) -> None:
    """A rename, or across file systems a copy of which ``new`` only ever holds the whole."""
    try:
        os.replace(old, new)
    except OSError:
        shutil.copyfile(old, new + ".part")
        os.replace(new + ".part", new)
        os.remove(old)


def extract(path: str, root: str, sections: tuple[str, ...], workers: int) -> int:
    """Writes the members of the sections under ``root``; their number. Paths are checked before anything is written."""
    found = members(path, sections)

    def write(part: list[tuple[str, str]]) -> None:
        with zipfile.ZipFile(path) as z:
            for name, rel in part:
                target = os.path.join(root, *rel.split("/"))
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with z.open(name) as src, open(target, "wb") as out:
                    shutil.copyfileobj(src, out, _BLOCK)

    with ThreadPoolExecutor(max(1, workers)) as pool:
        list(pool.map(write, [found[k::workers] for k in range(max(1, workers))]))
    return len(found)


def prune(root: str, sections: tuple[str, ...], site: Site) -> bool:
    """Removes the extracted sections where the retained archive can bring them back: its hash must be the marker's."""
    marker = read_marker(root, site)
    path = os.path.join(root, marker["zip_name"]) if marker and marker.get("zip_name") else None
    if path is None or not os.path.isfile(path) or _sha256(path) != marker["zip_sha256"]:
        return False
    for s in sections:
        shutil.rmtree(os.path.join(root, s), ignore_errors=True)
    return True


def restore(root: str, site: Site, workers: int = 4) -> bool:
    """Extracts the retained archive anew where a section's folder is gone; whether it did."""
    if all(os.path.isdir(os.path.join(root, s)) for s in site.sections):
        return False
    marker = read_marker(root, site)
    path = os.path.join(root, (marker or {}).get("zip_name") or "")
    if marker is None or not os.path.isfile(path) or _sha256(path) != marker["zip_sha256"]:
        raise FileNotFoundError(f"{root} lacks sections and has no archive that its marker vouches for")
    extract(path, root, site.sections, workers)
    return True


def _sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(_BLOCK):
            h.update(block)
    return h.hexdigest()


def fetch(site: Site, version: str, root: str, cache: str, workers: int = 4, force: bool = False, delete_zip: bool = False) -> dict:
    """Fetches a version into ``root`` and returns its marker. A folder with other content is refused; one that was fetched before is replaced with ``force``, its
    archive used again if it is the same. A cached archive counts only with a fitting record and hash."""
    url = resolve(site, version)
    name = f"{version}.zip"
    os.makedirs(cache, exist_ok=True)
    path = os.path.join(cache, name)
    old = read_marker(root, site)
    if os.path.isdir(root) and os.listdir(root):
        if old is None:
            raise ValueError(f"{root} is not empty and was not fetched")
        if not force:
            raise ValueError(f"{root} was fetched already")
        kept = os.path.join(root, old.get("zip_name") or "")
        if old["zip_url"] == url and os.path.isfile(kept) and not os.path.exists(path) and _sha256(kept) == old["zip_sha256"]:
            move(kept, path)
            write_provenance(path, url, old["zip_sha256"])
        shutil.rmtree(root)
    if os.path.isfile(path):
        sha = check_cached(path, read_provenance(path), url)
    else:
        sha = download(site, url, path)
        write_provenance(path, url, sha)
    os.makedirs(root, exist_ok=True)
    extract(path, root, site.sections, workers)
    if delete_zip:
        os.remove(path)
    else:
        move(path, os.path.join(root, name))
    marker = {"version": version, "zip_url": url, "zip_sha256": sha, "fetched_at_utc": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "zip_name": "" if delete_zip else name}
    _save(os.path.join(root, MARKER), marker)
    return marker
