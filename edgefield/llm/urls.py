"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest, in DataFrame functions only.

The trees learn from URLs that a rule labels, save a held-out fifth of them by a hash of the URL. A bounded sample of rows is enough
for trees of two levels; its gradients are summed up by node, feature and bin on Spark, and only those sums, a few hundred
numbers, come to the driver, which picks the splits. A fitted model is one column expression, so scoring stays in generated code.

URLs that no rule fits mostly have suffixes that no label has. So that the trees learn what an unknown suffix is worth, which is the
share of blocks among all labels and no more, the suffix is hidden in a part of the sample.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgefield.llm._common import forget, written


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


class Boost(NamedTuple):
    sample: int = 20_000  # labelled rows to learn from, at most about
    hidden: int = 3  # one in so many of them learns without its suffix
    trees: int = 16
    rate: float = 0.3
    bins: int = 16
    suffixes: int = 64  # with statistics of their own, at most; the most frequent ones of the sample
    smooth: float = 20.0
    ridge: float = 1.0


FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digits", "hyphens", "entropy", "parameters", "query_length", "longest_label", "suffix_rate", "suffix_share")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, F.lit("://"))
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    found = F.coalesce(at > 0, F.lit(False))
    return F.when(found, host).otherwise(""), F.when(found, path).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def is_held_out(url: Column) -> Column:
    """Labelled URLs that the trees do not learn from: crc32 of the URL, by 5, leaves 0."""
    return F.pmod(F.crc32(F.coalesce(url, F.lit("")).cast("binary")), F.lit(5)) == 0


def features(urls: DataFrame, suffix_table: dict[str, tuple[float, float]], default: float, hidden: Column | None = None) -> DataFrame:
    """Adds x: the features of url, host and path, as doubles in the order of FEATURES.

    hidden: the rows whose suffix counts as one that was not seen."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(url)
    share = lambda c: c.cast("double") / F.greatest(n, F.lit(1))
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    symbols = F.split(url, "")
    counts = F.transform(F.array_distinct(symbols), lambda c: (n - F.length(F.replace(url, c, F.lit("")))).cast("double") / n)
    entropy = F.when(n > 0, -F.aggregate(counts, F.lit(0.0), lambda acc, p: acc + F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)
    query = F.when(F.instr(url, F.lit("?")) > 0, F.substring_index(F.substring(url, F.instr(url, F.lit("?")) + 1, n), "#", 1)).otherwise("")
    labels = F.split("host", r"\.")
    if suffix_table:
        rate = F.create_map(*[F.lit(x) for k, v in sorted(suffix_table.items()) for x in (k, v[0])])
        part = F.create_map(*[F.lit(x) for k, v in sorted(suffix_table.items()) for x in (k, v[1])])
        suffix_rate, suffix_share = F.coalesce(F.try_element_at(rate, _suffix(F.col("host"))), F.lit(default)), F.coalesce(F.try_element_at(part, _suffix(F.col("host"))), F.lit(0.0))
    else:
        suffix_rate, suffix_share = F.lit(default), F.lit(0.0)
    if hidden is not None:
        suffix_rate, suffix_share = F.when(hidden, default).otherwise(suffix_rate), F.when(hidden, 0.0).otherwise(suffix_share)
    values = (
        n,
        F.length("host"),
        F.length("path"),
        F.size(labels),
        F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))),
        share(digits),
        F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit(""))),
        entropy,
        F.when(F.length(query) > 0, 1 + F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit("")))).otherwise(0),
        F.length(query),
        F.array_max(F.transform(labels, F.length)),
        suffix_rate,
        suffix_share,
    )
    return urls.withColumn("x", F.array(*[v.cast("double") for v in values]))


class Split(NamedTuple):
    feature: int
    cut: float  # at most this: left


class Tree(NamedTuple):
    top: Split
    sides: tuple[Split | None, Split | None]
    leaves: tuple[float, float, float, float]  # left-left, left-right, right-left, right-right

    def column(self, x: Column) -> Column:
        goes = lambda s: F.get(x, F.lit(s.feature)) <= s.cut
        a, b, c, d = map(F.lit, self.leaves)
        left = F.when(goes(self.sides[0]), a).otherwise(b) if self.sides[0] else a
        right = F.when(goes(self.sides[1]), c).otherwise(d) if self.sides[1] else c
        return F.when(goes(self.top), left).otherwise(right)


class Model(NamedTuple):
    prior: float
    trees: tuple[Tree, ...]
    suffixes: dict[str, tuple[float, float]]
    default: float  # block rate of a suffix that was not seen

    def score(self, urls: DataFrame) -> DataFrame:
        """Adds score, the probability of block, to rows with url, host and path."""
        x = features(urls, self.suffixes, self.default)
        raw = reduce(lambda acc, t: acc + t.column(F.col("x")), self.trees, F.lit(self.prior))
        return x.withColumn("score", 1 / (1 + F.exp(-raw))).drop("x")


def _best(sums: list, edges: list[list[float]], ridge: float) -> tuple[Split | None, float, float, float]:
    """The split with the largest gain from (feature, bin, g, h) sums of a node; and the leaf values without and with it."""
    leaf = lambda g, h: -g / (h + ridge)
    by: dict[int, dict[int, tuple[float, float]]] = {}
    for f, b, g, h in sums:
        by.setdefault(f, {})[b] = (g, h)
    if not by:
        return None, 0.0, 0.0, 0.0
    g_all, h_all = (sum(v[i] for v in next(iter(by.values())).values()) for i in (0, 1))
    best, gain = None, 1e-6
    for f in sorted(by):
        g = h = 0.0
        for b in range(len(edges[f])):
            g, h = g + by[f].get(b, (0, 0))[0], h + by[f].get(b, (0, 0))[1]
            if h < 1 or h_all - h < 1:
                continue
            more = g * g / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            if more > gain:
                best, gain = (Split(f, edges[f][b]), leaf(g, h), leaf(g_all - g, h_all - h)), more
    return (best[0], leaf(g_all, h_all), best[1], best[2]) if best else (None, leaf(g_all, h_all), 0.0, 0.0)


def fit(labelled: DataFrame, p: Boost = Boost()) -> Model:
    """labelled: url, host, path, y (1: block), and page_id if rows are to be told apart. Learns from about p.sample rows at most, drawn
    by a hash of both, so that a URL of very many rows is one of the sample's according to them."""
    labelled = labelled.where(~is_held_out(F.col("url")))
    n = labelled.count()
    take = min(1.0, p.sample / max(n, 1))
    row = ["url", "page_id"] if "page_id" in labelled.columns else ["url"]
    drawn = labelled.where(F.pmod(F.xxhash64(*row, F.lit(5)), F.lit(1 << 20)) < int(take * (1 << 20)))
    sample = written(drawn.select("url", "host", "path", F.col("y").cast("double").alias("y")), "labelled")
    size, blocked = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not size:
        return Model(0.0, (), {}, 0.5)
    default = (blocked + 1) / (size + 2)
    top = sample.groupBy(_suffix(F.col("host")).alias("s")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy(F.desc("n"), "s").limit(p.suffixes).collect()
    suffixes = {r["s"]: ((r["y"] + p.smooth * default) / (r["n"] + p.smooth), r["n"] / size) for r in top}
    hidden = F.pmod(F.xxhash64("url", F.lit(9)), F.lit(p.hidden)) == 0
    wide = written(features(sample, suffixes, default, hidden).select("url", "y", "x"), "features")
    forget(sample)
    quantiles = wide.agg(*[F.percentile(F.get("x", F.lit(i)), [j / p.bins for j in range(1, p.bins)]).alias(f"q{i}") for i in range(len(FEATURES))]).first()
    edges = [sorted(set(q)) for q in quantiles]
    bin_of = lambda i: F.size(F.filter(F.array(*map(F.lit, edges[i])), lambda e: F.get("x", F.lit(i)) > e))
    rows = written(wide.select("y", "x", F.array(*[bin_of(i) for i in range(len(FEATURES))]).alias("bins")), "binned").coalesce(2)
    forget(wide)
    prior = math.log(default / (1 - default))
    trees: list[Tree] = []

    def sums(node: Column, score: Column) -> dict[int, list]:
        q = 1 / (1 + F.exp(-score))
        one = rows.select(node.alias("node"), (q - F.col("y")).alias("g"), (q * (1 - q)).alias("h"), F.posexplode("bins").alias("f", "b"))
        out: dict[int, list] = {}
        for r in one.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out.setdefault(r["node"], []).append((r["f"], r["b"], round(r["g"], 9), round(r["h"], 9)))
        return out

    for _ in range(p.trees):
        score = reduce(lambda acc, t: acc + t.column(F.col("x")), trees, F.lit(prior))
        top_split, _, _, _ = _best(sums(F.lit(0), score).get(0, []), edges, p.ridge)
        if top_split is None:
            break
        by = sums(F.when(F.get("x", F.lit(top_split.feature)) <= top_split.cut, 0).otherwise(1), score)
        (l, l0, l1, l2), (r, r0, r1, r2) = (_best(by.get(i, []), edges, p.ridge) for i in (0, 1))
        leaves = (*((l1, l2) if l else (l0, l0)), *((r1, r2) if r else (r0, r0)))
        trees.append(Tree(top_split, (l, r), tuple(p.rate * v for v in leaves)))
    return Model(prior, tuple(trees), suffixes, default)


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, p: Boost = Boost()) -> DataFrame:
    """pages: page_id, url. One row for each row: page_id, host, path, rule, verdict, score (of block, by the trees; for every row),
    held_out (nothing was learned from the URL).

    A URL that is null or has no :// has an empty host and path; no rule fits it and the trees judge it. Without any labelled
    URL, or with labels of one kind, the trees know only the prior. Repeated rows get equal verdicts. Columns besides
    page_id and url are not looked at. No rows give no rows."""
    rows = pages.select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", text).withColumn("_by_rule", verdict)
    model = fit(rows.where("_by_rule IS NOT NULL").withColumn("y", (F.col("_by_rule") == "block").cast("int")), p)
    out = model.score(rows)
    return out.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score", is_held_out(F.col("url")).alias("held_out"))
