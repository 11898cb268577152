"""URL filters: a sorted array of 64-bit digests, probed by binary search.

A filter list is compiled to two memory-mapped files: the sorted xxhash64
keys of its rules and the rules' full strings, in the same order. A url is
judged by probing all the rule keys that could fit it (each suffix of its
host that starts at a label, with each rule path length that occurs) with one
vectorised binary search per batch; every hit is confirmed against the stored
string, so a collision of digests never decides. The longest fitting rule
wins, counted over host and path; of equally long ones that with the longer host.

The compiled list travels to the executors as one broadcast of proven size
(``MAX_RULE_BYTES``; a longer list is refused and must be split by host
suffix first); each Python worker maps it from an unlinked temporary file, so
nothing stays on its disk and a lost executor only maps it again.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and gets the default verdict; empty lists of rules allow
everything; repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import mmap
import re
import tempfile
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import UPPER, add_columns, pick, table

MAX_RULE_BYTES = 256 << 20
_LOWER = str.maketrans(UPPER, UPPER.lower())
_END_HOST = re.compile(r"[/?#]")
_END_PATH = re.compile(r"[?#]")


@dataclass(frozen=True)
class Rule:
    """``host`` and ``path`` as they are split from a rule like ``example.net/en/``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return split_url(f"://{self.text}")[0]

    @property
    def path(self) -> str:
        return split_url(f"://{self.text}")[1]


#: The rules of query op2.
RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = m.start() if (m := _END_HOST.search(rest)) else len(rest)
    tail = rest[end:]
    path_end = m.start() if (m := _END_PATH.search(tail)) else len(tail)
    return rest[:end].translate(_LOWER), tail[:path_end]


def digest(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\x00{path}".encode("utf-8", "surrogatepass"))


def _mapped(data: bytes) -> memoryview:
    """data in a memory-mapped file that has no name any more."""
    if not data:
        return memoryview(b"")
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        return memoryview(mmap.mmap(f.fileno(), len(data), access=mmap.ACCESS_READ))


class DigestArray:
    """A compiled filter list; of equal rules the first counts."""

    def __init__(self, rules):
        own: dict[tuple[str, str], Rule] = {}
        for r in rules:
            own.setdefault((r.host, r.path), r)
        rows = sorted((digest(h, p), h, p, r) for (h, p), r in own.items())
        self._keys = np.array([r[0] for r in rows], np.uint64).tobytes()
        texts = [f"{h}\x00{p}\x00{r.text}\x00{r.verdict}".encode("utf-8", "surrogatepass") for _, h, p, r in rows]
        self._text = b"".join(texts)
        self._ends = np.cumsum([0, *map(len, texts)]).astype(np.int64).tobytes()
        self._lengths = tuple(sorted({len(p) for _, p in own}, reverse=True))
        if len(self._keys) + len(self._text) + len(self._ends) > MAX_RULE_BYTES:
            raise ValueError(f"the filter list is larger than {MAX_RULE_BYTES} bytes; split it by host suffix")
        self._maps = None

    def __getstate__(self):
        return self.__dict__ | {"_maps": None}

    def _open(self):
        if self._maps is None:
            keys, ends = _mapped(self._keys), _mapped(self._ends)
            self._maps = np.frombuffer(keys, np.uint64), np.frombuffer(ends, np.int64), _mapped(self._text)
        return self._maps

    def rule_at(self, i: int) -> list[str]:
        """host, path, text and verdict of the i-th rule in the order of digests."""
        _, ends, text = self._open()
        return bytes(text[ends[i] : ends[i + 1]]).decode("utf-8", "surrogatepass").split("\x00")

    def judge(self, urls: list[str | None], default: str) -> dict:
        """host, path, rule and verdict of each url."""
        keys, _, _ = self._open()
        parts = [split_url(u) for u in urls]
        owner, probe, said = [], [], []
        for i, (host, path) in enumerate(parts):
            at = 0
            while host:
                suffix = host[at:]
                for n in self._lengths:
                    if n <= len(path):
                        owner.append(i)
                        probe.append(digest(suffix, path[:n]))
                        said.append((suffix, path[:n]))
                dot = host.find(".", at)
                if dot < 0:
                    break
                at = dot + 1
        rule: list[str | None] = [None] * len(urls)
        verdict = [default] * len(urls)
        if probe and len(keys):
            wanted = np.array(probe, np.uint64)
            at = np.searchsorted(keys, wanted)
            hits = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == wanted)
            best = [(0, 0)] * len(urls)
            for k in hits:
                j, (suffix, prefix) = at[k], said[k]
                size = (len(suffix) + len(prefix), len(suffix))
                while size > best[owner[k]] and j < len(keys) and keys[j] == wanted[k]:
                    host, path, text, said_verdict = self.rule_at(j)
                    if (host, path) == (suffix, prefix):
                        rule[owner[k]], verdict[owner[k]], best[owner[k]] = text, said_verdict, size
                    j += 1
        return {"host": [p[0] for p in parts], "path": [p[1] for p in parts], "rule": rule, "verdict": verdict}


def judge_urls(pages: DataFrame, rules, *, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """Host, path, deciding rule and verdict of every url."""
    compiled = pages.sparkSession.sparkContext.broadcast(DigestArray(rules))
    own = pick(pages, **{id_column: id_column, "url": url_column})
    return add_columns(own, lambda urls: compiled.value.judge(urls, default), "host string, path string, rule string, verdict string", source="url")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url; nulls, repeats and empty tables as the module states."""
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


_WHERE = "(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
ORACLE = f"""
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') as host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from cut
), ruled as (
  select page_id, host, path, case
{chr(10).join(f"    when {_WHERE.format(h=r.host, p=r.path)} then '{r.text}'" for r in sorted(RULES, key=lambda r: (-len(r.host) - len(r.path), -len(r.host))))}
  end as rule from split
)
select page_id, host, path, rule, case {" ".join(f"when rule = '{r.text}' then '{r.verdict}'" for r in RULES)} else 'allow' end as verdict
from ruled
"""
