"""Plain Python versions of the numbered queries, for small inputs."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from bisect import bisect_left, insort
from html.parser import HTMLParser

import numpy as np

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def judge(url: str | None) -> tuple[str, str, str | None]:
    """(host, path, contract rule)"""
    m = re.search(r"(?s)://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    rules = [("com", "/en/"), ("example.com", "/en/7"), ("net", "/de/"), ("example.net", "/de/8"), ("org", "/es/")]
    fits = [h + p for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def contamination(docs: dict, items: dict, size: int = 13) -> dict:
    windows: dict[tuple, set] = {}
    for item, text in items.items():
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = {}
    for doc, text in docs.items():
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    return out


ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def secrets(text: str | None) -> tuple[int, int, int, str, list[str]]:
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    listed = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)]
    count = [sum(k == n for _, n, _ in spans) for k in range(3)]
    return *count, hashlib.sha256(",".join(listed).encode()).hexdigest(), listed


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def embedding_links(rows: list[tuple], least: float = 0.98) -> dict:
    """vec_id -> (n_links, component_id, kept)"""
    good = [(i, lab, np.asarray(v, float)) for i, v, lab in rows if lab is not None and v is not None and None not in list(v) and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float))]
    links = {i: set() for i, _, _ in rows}
    for n, (i, a, x) in enumerate(good):
        for j, b, y in good[n + 1 :]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i].add(j)
                links[j].add(i)
    component = connected(links)
    return {i: (len(links[i]), component[i], component[i] == i) for i in links}


def connected(links: dict) -> dict:
    out: dict = {}
    for i in sorted(links):
        stack = [i] if i not in out else []
        while stack:
            x = stack.pop()
            if x not in out:
                out[x] = i
                stack += links[x]
    return out


def shingle_set(text: str | None, size: int = 5) -> set[tuple]:
    w = words(text)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def near_duplicates(docs: dict, least: float = 0.8) -> dict:
    sets = {i: shingle_set(t) for i, t in docs.items()}
    where: dict[tuple, list] = {}
    links = {i: set() for i in docs}
    for i, s in sets.items():
        common: dict = {}
        for x in s:
            for j in where.setdefault(x, []):
                common[j] = common.get(j, 0) + 1
            where[x].append(i)
        for j, n in common.items():
            if n >= least * (len(s) + len(sets[j]) - n):
                links[i].add(j)
                links[j].add(i)
    return connected(links)


def html_text(source: str) -> str:
    return " ".join(html.unescape(source).split())


class _Article(HTMLParser):
    """Texts of the blocks inside ``article``, for pages whose articles hold paragraphs and headings only."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside > 0:
            self.blocks[-1] += data


def article(source: str | None) -> str:
    parser = _Article()
    parser.feed(source or "")
    parser.close()
    return " ".join(x for b in parser.blocks if (x := " ".join(b.split())))


def best_fit(lengths: list[int], size: int) -> int:
    """Sequences of best fit, longest first."""
    gaps: list[int] = []
    for x in sorted(lengths, reverse=True):
        at = bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else size
        n_gap = gap - x
        insort(gaps, n_gap)
    return len(gaps)
