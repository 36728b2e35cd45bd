"""URL filtering: rules for hosts and paths, then logistic regression on hashed character n-grams of host and path.

A url's host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; its path follows up to
`?`, `#` or the end. A rule (like `example.com/en/`) fits its host and all subdomains if the path starts with the
rule's; the longest rule wins. Every url that no rule fits is judged by the model, which is trained on the driver from
a small labelled table of urls (`labelled_urls()` by default, a parameter) and broadcast as one vector of `SIZE` weights (32 KB).

Defined cases: a null url, or one without `://`, has an empty host and path, no rule, and the model's verdict for no
n-grams (its intercept); repeated rows and ties each get their verdict; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 1 << 12
#: Names of unwanted and of ordinary sites and folders, and what stands before and after them in urls.
UNWANTED = """
casino-win best-casino online-casino free-bets bets-now free-spins cheap-pills pills-online cheap-viagra adult-x adult-video
xxx-adult spam-farm link-farm seo-spam ads-track track-ads adserver-ads poker-win free-poker win-lottery payday-loan cheap-loans
cash-win free-download warez-keygen torrent-crack replica-watches cheap-bags diet-pills hot-singles adult-dating escort-adult
click-bait popup-ads casino-bets
""".split()
WANTED = """
library news university museum garden software city hospital weather recipes history school journal science music theatre
wiki books forum travel maps therein thstone rivers northern house bridge water mountain field shop bank parliament sports
farmhouse railway townhall-archive open-data free-library cheapside trackfield windmill adsorption pillar spampton better-world
""".split()
BEFORE = ["https://", "https://www.", "http://m.", "https://blog."]
AFTER = [".example.com/en/27", ".example.net/de/503.html", ".example.org/es/245", ".example.com/fr/357/", ".example.org/en/471?page=2"]
INSIDE = [".example.com/{}/27", ".example.net/en/{}.html", ".example.org/de/{}/start", ".example.com/{}", ".example.org/pages/{}/"]


def labelled_urls() -> list[tuple[str, int]]:
    """Three urls with each name as the host and three with it in the path of an ordinary host, and urls without a host.

    Beginnings, ends and the ordinary hosts take turns, so that they tell nothing; two names of one kind share a path. Most
    urls are ordinary: more of them, with numbered pages, are made of two ordinary names run together.
    """
    out = [("", 0), ("mailto:someone", 0), ("/relative/path", 0)]
    for hosts, label in ((UNWANTED, 1), (WANTED, 0)):
        for i, host in enumerate(hosts):
            out += [(BEFORE[(i + j) % len(BEFORE)] + host + AFTER[(i + 2 * j) % len(AFTER)], label) for j in range(3)]
            for j in range(3):
                path = host if j < 2 else f"{host}/{hosts[(i + 7) % len(hosts)]}"
                out.append((BEFORE[(i + j) % len(BEFORE)] + WANTED[(i + 11 * j + 1) % len(WANTED)] + INSIDE[(i + 2 * j) % len(INSIDE)].format(path), label))
    for i, (a, b) in enumerate((a, b) for k in (3,) for a, b in zip(WANTED, WANTED[k:] + WANTED[:k], strict=True)):
        out.append((f"{BEFORE[i % len(BEFORE)]}{a[:4]}{b[-4:]}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'de', 'fr', 'es')[i % 4]}/{1009 * (i + 1) % 9973}{('', '.html', '/')[i // 3 % 3]}", 0))
    return out


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min([i for c in "?#" if (i := rest.find(c)) >= 0], default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def features(host: str, path: str, low: int = 3, high: int = 5) -> dict[int, float]:
    """Hashed character n-grams of host and path, scaled to length one."""
    found: dict[int, float] = {}
    for kind, text in (("h", host), ("p", path)):
        text = f"^{text}$" if text else ""
        for n in range(low, high + 1):
            for i in range(len(text) - n + 1):
                k = crc32(f"{kind}{text[i : i + n]}".encode("utf-8", "replace")) % SIZE
                found[k] = found.get(k, 0.0) + 1.0
    norm = sum(v * v for v in found.values()) ** 0.5
    return {k: v / norm for k, v in found.items()}


def train(labelled: list[tuple[str, int]] | None = None, penalty: float = 1e-4, steps: int = 2000, rate: float = 20.0) -> np.ndarray:
    """Weights and, last, the intercept: gradient descent on the penalised log loss, the same on every run."""
    labelled = labelled_urls() if labelled is None else labelled
    x = np.zeros((len(labelled), SIZE))
    for i, (url, _) in enumerate(labelled):
        for k, v in features(*split_url(url)).items():
            x[i, k] = v
    y = np.array([label for _, label in labelled], float)
    w, b = np.zeros(SIZE), 0.0
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ miss / len(y) + penalty * w)
        b -= rate * miss.mean()
    return np.append(w, b)


def _judged(weights: np.ndarray, rules: list[tuple[str, str]], least: float):
    split = [(r, *r.partition("/")[::2], v) for r, v in sorted(rules, key=lambda r: (-len(r[0]), r[0]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, fits, verdicts, scores = [], [], [], [], []
            for url in batch["url"].to_pylist():
                host, path = split_url(url)
                fit = next(((r, v) for r, h, p, v in split if (host == h or host.endswith("." + h)) and path.startswith("/" + p)), None)
                score = float(1 / (1 + np.exp(-(weights[-1] + sum(weights[k] * v for k, v in features(host, path).items())))))
                hosts.append(host)
                paths.append(path)
                fits.append(fit and fit[0])
                verdicts.append(fit[1] if fit else "block" if score >= least else "allow")
                scores.append(score)
            text = [pa.array(c, pa.string()) for c in (hosts, paths, fits, verdicts)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], *text, pa.array(scores, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return run


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: list[tuple[str, int]] | None = None, least: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (chance of being unwanted) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    return rows.mapInArrow(_judged(train(labelled), rules, least), "page_id long, host string, path string, rule string, verdict string, score double")
