"""URL filters by a Bloom filter cascade that is exact over all keys of the corpus.

Level 0 holds the listed keys. Level 1 holds the corpus's keys that level 0 takes for listed ones though they aren't, level
2 the listed keys that level 1 takes for those, and so on until a level errs no more. A key of the corpus is listed if the
first level that doesn't have it is an odd one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a level has at least.
LEAST_BITS = 64


@dataclass(frozen=True)
class Rule:
    """A verdict on a host and its subdomains, for urls whose path starts with `path`. The path begins with a slash."""

    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Bloom:
    """A Bloom filter of 64-bit hashes."""

    bits: np.ndarray
    probes: int
    salt: int

    @classmethod
    def of(cls, hashes: np.ndarray, error: float, salt: int) -> Bloom:
        size = max(LEAST_BITS, int(np.ceil(-len(hashes) * np.log(error) / np.log(2) ** 2)))
        out = cls(np.zeros(size, bool), max(1, round(-np.log2(error))), salt)
        for at in out._places(hashes):
            out.bits[at] = True
        return out

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        a, b = _mix(hashes, 2 * self.salt + 1), _mix(hashes, 2 * self.salt + 2) | np.uint64(1)
        for k in range(self.probes):
            yield (a + np.uint64(k) * b) % np.uint64(len(self.bits))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self._places(hashes):
            found &= self.bits[at]
        return found


def levels(listed: np.ndarray, mistaken: np.ndarray, first: Bloom) -> list[Bloom]:
    """The cascade of listed keys whose first level takes the keys `mistaken` for listed ones, and no others."""
    out, held, other = [first], mistaken, listed
    while len(held):
        level = Bloom.of(held, 0.5, len(out))
        out.append(level)
        held, other = other[level.has(other)], held
    return out


def is_listed(cascade: list[Bloom], hashes: np.ndarray) -> np.ndarray:
    """The first level without a key decides; past the last one the key is among those that the last level holds."""
    out = np.full(len(hashes), len(cascade) % 2 == 1)
    open_ = np.arange(len(hashes))
    for k, level in enumerate(cascade):
        has = level.has(hashes[open_])
        out[open_[~has]] = k % 2 == 1
        open_ = open_[has]
    return out


def host_of(url: Column) -> Column:
    """What follows the first ://, up to /, ?, # or the end, A-Z in lower case; empty without one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Every key under which a rule may fit: the host's last labels, as many as some rule's host has, with the path's first characters."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    ends = [F.when(dots >= n - 1, F.substring_index(host, ".", -n)) for n in labels]
    starts = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    return F.filter(F.array(*[F.concat(d, s) for d in ends for s in starts]), lambda k: k.isNotNull())


def _hashes(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def build_cascades(keys: DataFrame, rules: Sequence[Rule]) -> dict[str, list[Bloom]]:
    """A cascade for each verdict, exact over all hashes `h` of the keys.

    The first level's error is such that about as many of the corpus's keys pass it by mistake as there are rules; only
    these, and the rules, reach the driver.
    """
    spark = keys.sparkSession
    universe = keys.agg(F.approx_count_distinct("h")).first()[0]
    listed = {}
    for verdict in sorted({r.verdict for r in rules}):
        names = [(r.key,) for r in rules if r.verdict == verdict]
        rows = spark.createDataFrame(names, "key string").select(F.xxhash64("key")).collect()
        listed[verdict] = np.unique(np.array([r[0] for r in rows], np.int64).view(np.uint64))
    first = {v: Bloom.of(h, min(0.5, len(h) / (2**0.5 * max(1, universe))), 0) for v, h in listed.items()}
    shared = spark.sparkContext.broadcast((listed, first))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, filters = shared.value
        for b in batches:
            h = np.unique(_hashes(b.column(0)))
            for v, bloom in filters.items():
                by_mistake = h[bloom.has(h)]
                by_mistake = by_mistake[~np.isin(by_mistake, known[v])]
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(by_mistake), pa.string()), pa.array(by_mistake.view(np.int64))], ["verdict", "h"])

    mistaken = {v: [] for v in listed}
    for r in keys.select("h").mapInArrow(passing, "verdict string, h long").distinct().collect():
        mistaken[r["verdict"]].append(r["h"])
    return {v: levels(h, np.array(sorted(mistaken[v]), np.int64).view(np.uint64), first[v]) for v, h in listed.items()}


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of (page_id, url).

    The longest fitting rule decides, block before allow where both are listed; a url that no rule fits is on no list and
    gets `default`. Null urls and those without :// have an empty host and path, which no rule fits. The list of rules is
    a parameter of the job and goes to every executor as filters alone: rows are neither joined nor shuffled.
    """
    if any(not r.path.startswith("/") or "/" in r.host for r in rules):
        raise ValueError("a rule has a host without slashes and a path that begins with one")
    spark = pages.sparkSession
    lengths, labels = sorted({len(r.path) for r in rules}), sorted({r.host.count(".") + 1 for r in rules})
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = parts.withColumn("keys", keys_of(F.col("host"), F.col("path"), labels, lengths) if lengths else F.array().cast("array<string>"))
    cascades = build_cascades(keyed.select(F.explode("keys").alias("key")).select(F.xxhash64("key").alias("h")), rules)
    shared = spark.sparkContext.broadcast(cascades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for b in batches:
            keys, hashes = b.column(3), b.column(4)
            owner = pc.list_parent_indices(keys).to_numpy(zero_copy_only=False)
            flat, h = pc.list_flatten(keys), _hashes(pc.list_flatten(hashes))
            rule: list[str | None] = [None] * b.num_rows
            verdict = [default] * b.num_rows
            for v in sorted(filters, reverse=True):  # the last one wins a tie: block over allow
                for k in np.flatnonzero(is_listed(filters[v], h)).tolist():
                    key, row = flat[k].as_py(), int(owner[k])
                    if rule[row] is None or (len(key), v == "block") > (len(rule[row]), verdict[row] == "block"):
                        rule[row], verdict[row] = key, v
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = dict(pages.dtypes)["page_id"]
    hashed = keyed.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    return hashed.select("page_id", "host", "path", "keys", "hashes").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


URL_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, verdict DESC) AS k
  FROM (SELECT DISTINCT * FROM parts) p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.k = 1
"""
