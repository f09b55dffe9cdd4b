"""URL filters: host and path rules first, else logistic regression on hashed character n-grams.

The regression is trained on the small labelled table below (or one that is given). Its weights, a few
thousand numbers whatever the input, go to the tasks with the function that scores; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import grams, mix

#: (verdict, rule); a rule is a host and the start of a path.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

BLOCKED_URLS = (
    "http://free-casino-bonus.example/spin/win-now", "http://best-poker-slots.example/jackpot", "https://cheap-pills-online.example/viagra", "http://adult-cams.example/xxx/live",
    "http://hot-singles.example/xxx/chat", "https://crack-serial-keygen.example/download.exe", "http://warez-torrent.example/full-movie-free", "http://login-verify-account.example/secure/update.php",
    "http://win-free-phone.example/claim?prize=1", "https://payday-loans-fast.example/apply-now", "http://replica-watches.example/buy-cheap", "http://seo-backlinks.example/buy/links",
    "http://bet365-bonus.example/casino/free-spins", "http://xxx-porn-tube.example/video/1", "http://clickbait-ads.example/track?aff=99&ref=ad", "http://malware-host.example/setup.exe",
    "http://cheap-viagra-cialis.example/order", "https://crypto-double-btc.example/airdrop/claim", "http://escort-girls.example/adult/city", "http://spam-mailer.example/unsubscribe?id=7",
)
ALLOWED_URLS = (
    "https://www.university.example/department/physics", "https://docs.library.example/guide/install.html", "https://news.daily.example/2021/05/world/article-12", "https://en.encyclopedia.example/wiki/History",
    "https://blog.engineer.example/posts/17", "https://www.museum.example/en/collection/42", "https://forum.gardening.example/topic/roses", "https://www.city.example/services/parks",
    "https://recipes.kitchen.example/soup/tomato", "https://journal.science.example/volume/3/paper/9", "https://www.school.example/de/unterricht/1", "https://m.magazine.example/fr/culture/325",
    "https://support.software.example/es/articulo/81", "https://www.weather.example/forecast/today", "https://books.archive.example/details/novel", "https://www.health.example/en/topics/sleep",
    "https://sport.times.example/football/report.html", "https://travel.guide.example/it/roma", "https://code.project.example/readme.html", "https://www.parliament.example/bills/2019",
)

BITS = 14
N_GRAMS = (3, 4, 5)
_U = np.uint64


def host(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end; A-Z in lower case."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(rule: str, host_: Column, path_: Column) -> Column:
    at = rule.index("/")
    domain, start = rule[:at], rule[at:]
    return ((host_ == domain) | host_.endswith("." + domain)) & path_.startswith(start)


def rule_for(host_: Column, path_: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    longest = sorted(rules, key=lambda r: -len(r[1]))
    out = F.lit(None).cast("struct<rule string, verdict string>")
    for verdict, rule in reversed(longest):
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(_fits(rule, host_, path_), found).otherwise(out)
    return out


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct character n-grams of ``^host$`` and ``^path$``, hashed apart."""
    rows, found = [], []
    for salt, texts in ((_U(1), hosts), (_U(2), paths)):
        coded = [np.frombuffer(f"^{t}$".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        row = np.repeat(np.arange(len(coded)), [len(c) for c in coded])
        flat = np.concatenate(coded).astype(np.uint64) if coded else np.empty(0, np.uint64)
        for n in N_GRAMS:
            if len(flat) >= n:
                inside = row[: len(row) - n + 1] == row[n - 1 :]
                rows.append(row[: len(row) - n + 1][inside])
                found.append(mix(grams(mix(flat + (salt << _U(32))), n)[inside] + salt * _U(n)) >> _U(64 - BITS))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.unique(np.concatenate(rows) * (1 << BITS) + np.concatenate(found).astype(np.int64))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _split(url: str) -> tuple[str, str]:
    rest = url.split("://", 1)[1]
    at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[at:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return rest[:at].lower(), tail[:end]


class UrlModel:
    """Logistic regression by full-batch gradient steps; rows are scaled by their number of n-grams."""

    def __init__(self, blocked: Sequence[str] = BLOCKED_URLS, allowed: Sequence[str] = ALLOWED_URLS, steps: int = 400, rate: float = 8.0, l2: float = 1e-4):
        parts = [_split(u) for u in (*blocked, *allowed)]
        row, col = features([h for h, _ in parts], [p for _, p in parts])
        n = len(parts)
        y = np.arange(n) < len(blocked)
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
        self.weights, self.bias = np.zeros(1 << BITS), 0.0
        for _ in range(steps):
            off = self._squash(np.bincount(row, self.weights[col], n) * scale + self.bias) - y
            self.weights -= rate * (np.bincount(col, (off * scale)[row], 1 << BITS) / n + l2 * self.weights)
            self.bias -= rate * off.mean()

    @staticmethod
    def _squash(x):
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

    def blocks(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The probability that each URL is one to block."""
        row, col = features(hosts, paths)
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(hosts)), 1))
        return self._squash(np.bincount(row, self.weights[col], len(hosts)) * scale + self.bias)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row.

    A null url or one without ``://`` has an empty host and path, fits no rule and is judged by the
    method on empty strings; repeated rows are judged each for themselves; an empty table gives no
    rows; further columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or UrlModel())

    @F.pandas_udf("double")
    def scored(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(shared.value.blocks(hosts.tolist(), paths.tolist()))

    split = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    found = split.select("*", rule_for(F.col("host"), F.col("path"), rules).alias("found"), scored("host", "path").alias("score"))
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", learned).alias("verdict"), "score")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
