"""URL filters: path rules, and a Bloom filter cascade that gives exact membership of listed keys without a join.

DataFrame functions only. A cascade over the complete universe of keys: level 1 holds the listed keys, level 2 the other keys
that level 1 wrongly accepts, level 3 the listed keys that level 2 wrongly accepts, and so on until nothing is wrong.
A key is listed if the first level that rejects it is an even one (or if it passes an odd number of levels in all).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somatica.llm.common import bloom_passes, bloom_words, materialise

#: (host, path, verdict)
Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """What stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.substr(url, F.instr(url, "://") + 3), r"^[^/?#]*", 0)
    return F.when(F.instr(url, "://") > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def url_path(url: Column) -> Column:
    """What stands between the host and ``?``, ``#`` or the end; empty if there is no ``://``."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def best_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's; of equally long ones the first wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def marked_keys(listed: DataFrame, universe: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """Each key of the universe and of the list once, with ``listed``, as a written table, and how many are listed and are not."""
    both = universe.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
    keys = materialise(both.where("key is not null").groupBy("key").agg(F.max("listed").alias("listed")), "keys")
    return keys, tuple(keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first())


class Cascade:
    """Levels of Bloom filters, each a written row ``words``, and how to look a key up in them.

    The filters hold about three bytes for each listed key in all, whatever the universe's size. Every look-up reads them as
    a scalar subquery, so they reach the tasks once and no table is joined. ``most_keys`` bounds them (24 MB by
    default); for longer lists ``build`` raises ValueError: ``Cascades`` deals such a list to several cascades.
    """

    def __init__(self, levels: list[DataFrame], shape: list[tuple[int, int]]):
        self.levels, self.shape = levels, shape

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, most_keys: int = 8_000_000) -> Cascade:
        """``listed``, ``universe``: column ``key``. Nulls and repeats do not count; listed keys join the universe."""
        keys, (n_yes, n_no) = marked_keys(listed, universe)
        if n_yes > most_keys:
            raise ValueError(f"{n_yes} keys are listed, over the bound of {most_keys}")
        return cls.of(keys, n_yes, n_no)

    @classmethod
    def of(cls, keys: DataFrame, n_yes: int, n_no: int, most_levels: int = 40) -> Cascade:
        """``keys``: a written table of the universe, each key once, with ``listed``; ``n_yes`` and ``n_no``: how many are and are not."""
        inside, outside = (keys.where("listed").select("key"), keys.where("not listed").select("key"))
        shape: list[tuple[int, int]] = []
        levels: list[DataFrame] = []
        n, m = n_yes, n_no
        while n and len(shape) < most_levels:
            # enough bits that few of the other side pass: at first as many as there are listed keys, then one in 1,024, so that few levels follow
            rate = min(0.5, max(n / max(m, 1), 1e-3)) if not shape else 1 / 1024
            probes = max(1, round(-math.log2(rate)))
            bits = max(64, 64 * math.ceil(n * probes / math.log(2) / 64))
            level = materialise(bloom_words(inside, len(shape), probes, bits), "filter")
            levels.append(level)
            shape.append((probes, bits))
            if not m:
                n = 0
                break
            wrong = materialise(outside.where(bloom_passes(F.col("key"), level.scalar(), len(shape) - 1, probes, bits)), "wrong")
            inside, outside = wrong, inside
            n, m = wrong.count(), n
        if n:
            raise RuntimeError(f"{n} keys are still mistaken after {most_levels} levels")
        return cls(levels, shape)

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed; for a null key false."""
        out = F.lit(len(self.shape) % 2 == 1)
        for level in reversed(range(len(self.shape))):
            words = self.levels[level].scalar()
            out = F.when(bloom_passes(key, words, level, *self.shape[level]), out).otherwise(F.lit(level % 2 == 1))
        return F.coalesce(out & key.isNotNull(), F.lit(False))


class Cascades:
    """Exact membership for lists of any length: keys are dealt by hash to as many cascades as keep each under ``most_keys``."""

    def __init__(self, parts: list[Cascade]):
        self.parts = parts

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, most_keys: int = 8_000_000) -> Cascades:
        """``listed``, ``universe``: column ``key``. Nulls and repeats do not count; listed keys join the universe."""
        keys, total = marked_keys(listed, universe)
        counts, parts = {0: total}, 1
        while max(c[0] for c in counts.values()) > most_keys:
            parts = max(parts + 1, -(-sum(c[0] for c in counts.values()) * 11 // (10 * most_keys)))
            dealt = keys.groupBy(part_of(F.col("key"), parts).alias("part")).agg(F.count_if("listed"), F.count_if(~F.col("listed")))
            counts = {r["part"]: r[1:] for r in dealt.collect()}
        of = part_of(F.col("key"), parts)
        return cls([Cascade.of(keys.where(of == i) if parts > 1 else keys, *counts.get(i, (0, 0))) for i in range(parts)])

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed; for a null key false."""
        out, of = F.lit(False), part_of(key, len(self.parts))
        for i, cascade in enumerate(self.parts):
            out = F.when(of == i, cascade.holds(key)).otherwise(out)
        return out


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts)) if parts > 1 else F.lit(0)


def host_shares(pages: DataFrame) -> DataFrame:
    """host, pages: number of pages of each host, from the column url."""
    return pages.select(url_host(F.col("url")).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))


def flooding_hosts(pages: DataFrame, share: float = 0.05) -> DataFrame:
    """Hosts (column ``key``) with at least ``share`` of all pages that have a host: sites that flood the crawl."""
    hosts = materialise(host_shares(pages).where("host <> ''"), "hosts")
    total = hosts.agg(F.sum("pages")).first()[0] or 0
    return hosts.where(F.col("pages") >= max(1.0, share * total)).select(F.col("host").alias("key"))


def address(host: Column, path: Column) -> Column:
    """Key of a page whatever its scheme, query and fragment: host and path; null where both are empty."""
    return F.nullif(F.concat(host, path), F.lit(""))


def queried_addresses(pages: DataFrame) -> DataFrame:
    """Addresses (column ``key``, each once) that some page was fetched under with a query: pages made on demand, whose
    variants a crawl repeats. The list grows with the crawl."""
    asked = F.coalesce((F.instr("url", "://") > 0) & F.substr(F.col("url"), F.instr("url", "://") + 3).rlike(r"^[^#]*\?"), F.lit(False))
    return pages.where(asked).select(address(url_host(F.col("url")), url_path(F.col("url"))).alias("key")).where("key is not null").distinct()


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, by: str = "host", most_keys: int = 8_000_000) -> DataFrame:
    """Verdict on each url: the longest fitting rule's, else ``block`` if its key is listed and ``allow`` if not.

    ``listed``: column ``key``, hosts or (``by`` address) addresses, however many (over ``most_keys`` they go to several
    cascades). Returns page_id, host, path, rule (null if none fits) and verdict. A null url, or one without ``://``, has an empty
    host and path and is allowed. Repeated rows and null ids come back as they came; an empty table gives no rows; other
    columns are ignored.
    """
    p = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    p = p.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    key = F.col("host") if by == "host" else address(F.col("host"), F.col("path"))
    cascade = Cascades.build(listed, p.select(key.alias("key")), most_keys)
    name, verdict = best_rule(F.col("host"), F.col("path"), rules)
    own = F.when(cascade.holds(key), "block").otherwise("allow")
    return p.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
