"""Secret scans, by patterns and by a battery of randomness tests, in DataFrame functions only.

Patterns give the base spans. Besides them every run of 20 or more characters of the usual encodings, be it under a base span or
not, is tested over the alphabet of the encoding it is inferred to have (hex, base32, alphanumeric, base64): chi-squared for uniform
symbols, the number of runs above and below the alphabet's middle, and the serial correlation of neighbours. Each statistic
becomes a normal score by its exact moments for random strings of its length: equal pairs of symbols, which are what chi-squared
counts, by mean, variance and skewness; changes between the halves as a fair binomial; products of neighbours by variance and
kurtosis. Counts are made continuous by a fraction that the string's checksum gives. The least of the three p-values, as one of
three, is the battery's p: uniform for random strings, near 0 for words and patterns.

False discoveries are controlled within each encoding and band of lengths, on both sides:

* Benjamini and Hochberg's rule on the battery's p-values says which runs are not random; of those that it throws out at most
  the share `lost` are random strings. Where a band is all random strings, the cut is `lost` by their number.
* What is left is held against the corpus: the likelihood of a run as a random string over that under a bigram model of all texts'
  shorter runs is an e-value, whose mean is at most 1 for runs that are like those, whatever their length or company. The e-value form of the
  rule takes those that pass, with all runs of the band that were thrown out counting as e-values of 0.

Among m runs of a band a lone secret has to reach m / false_rate, a few characters' worth, so a secret does not need others.

Positions come from the pieces between matches: a match starts where the lengths of all before it end. Running sums are taken
in two levels of about the square root of the number of matches, and arrays go into a lambda as its argument, never as a
column named within it, which would be computed again for each element.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgefield.llm._common import set_aside, written


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # whole runs; shorter ones are no matches
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"  # whole runs, tried at their beginnings only

KINDS = ("assign", "access", "hex", "random")  # ties of start go by this order
_SPAN = "array<struct<start:int,kind:int,stop:int>>"

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
BANDS = (24, 32, 40, 48, 64, 96, 128)  # upper ends of the lengths, exclusive; the last band is open
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"  # of candidates
WORD = "[A-Za-z0-9+/_-]+={0,2}"
_BLOCK = 1024  # characters of a text that are cut from at once
MOST_GAIN = 64  # whole units of log e-value that are told apart; no number of runs asks for more
_STEPS, _LEVELS = 4, 400  # levels of p: quarters of a power of two, down to 2 ** -100


class Scan(NamedTuple):
    false_rate: float = 0.05  # of what is found
    lost: float = 0.005  # of what the battery throws out
    prior: float = 20.0  # weight of single characters against pairs


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, join: Callable[[Column, Column], Column] = operator.add) -> Column:
    """For each of values (an int array) all before it, joined from 0 on. No array grows beyond about the square root of their number."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    fold = lambda v: F.aggregate(v, zero, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def in_blocks(v: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / side).cast("int")), lambda k: fold(F.slice(v, k * side + 1, side)))

    whole = lambda blocks: F.flatten(F.zip_with(blocks, fold(F.transform(blocks, lambda b: b["at"]))["out"], lambda b, base: F.transform(b["out"], lambda x: join(base, x))))
    return F.when(F.size(values) > 0, _let(values, lambda v: _let(in_blocks(v), whole))).otherwise(F.array().cast("array<int>"))


def _positions(matches: Column, pieces: Column, kind: int) -> Column:
    """Spans of the matches, given the pieces between them."""
    sizes = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("own")))

    def spans(v: Column) -> Column:
        span = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["own"]).alias("stop"))
        return F.zip_with(_before(F.transform(v, lambda x: x["gap"] + x["own"])), v, span)

    return F.when(F.size(matches) > 0, _let(sizes, spans)).otherwise(F.array().cast(_SPAN))


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for z of 0 or more, to a few parts in a million of itself: a polynomial near 0, a continued fraction beyond 2."""
    t = 1 / (1 + 0.2316419 * z)
    series = reduce(lambda acc, c: (acc + c) * t, (-1.821255978, 1.781477937, -0.356563782, 0.319381530), F.lit(1.330274429) * t)
    ratio = 1 / reduce(lambda acc, i: z + i / acc, range(12, 0, -1), z + 13.0)
    return F.exp(-z * z / 2) / 2.5066282746310002 * F.when(z > 2, ratio).otherwise(series)


def _encoding(s: Column) -> Column:
    return F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(s.rlike("^[A-Z2-7]+=*$"), "base32").when(s.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")


def _band(length: Column) -> Column:
    return reduce(lambda acc, b: acc + F.when(length >= b, 1).otherwise(0), BANDS, F.lit(0))


def learn_runs(docs: DataFrame, scan: Scan = Scan()) -> list[float]:
    """The log probability of each symbol (column) after each other one (row) in runs that are too short for candidates, row by row."""
    n = len(SYMBOLS)
    runs = docs.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    pairs = runs.where("length(s) BETWEEN 2 AND 19").select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))).alias("pair"))
    counts = [[0] * n for _ in range(n)]
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most n * n
        counts[SYMBOLS.index(r["pair"][0])][SYMBOLS.index(r["pair"][1])] += r["n"]
    total = sum(map(sum, counts))
    single = [(sum(row[j] for row in counts) + 1) / (total + n) for j in range(n)]
    return [math.log((counts[i][j] + scan.prior * single[j]) / (sum(counts[i]) + scan.prior)) for i in range(n) for j in range(n)]


def _gain(s: Column, model: list[float]) -> Column:
    """The log e-value of s: its likelihood as a random string of its alphabet over that under the model, given its first symbol."""
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    places = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    size = reduce(lambda acc, kv: F.when(_encoding(s) == kv[0], len(kv[1])).otherwise(acc), ALPHABETS.items(), F.lit(len(ALPHABETS["base64"])))
    steps = F.zip_with(F.slice(places, 1, F.length(s) - 1), F.slice(places, 2, F.length(s) - 1), lambda a, b: F.get(table, a * len(SYMBOLS) + b))
    return -(F.length(s) - 1) * F.log(size.cast("double")) - F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)


def _battery(pairs: Column) -> Column:
    """pairs: array of (s, span). For each: span, key (encoding and band) and p, under the hypothesis that s is random over its
    alphabet. Every step adds to the structs of the one before, so that no expression is written out twice."""
    alphabets = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])

    def named(x: Column, keep: str, **more: Column) -> Column:
        return F.struct(*[x[k].alias(k) for k in keep.split()], *[v.alias(k) for k, v in more.items()])

    def plain(x: Column) -> Column:
        return F.when(x["e"] == "hex", F.lower(x["s"])).when(x["e"] == "base64", F.translate(x["s"], "-_=", "+/")).otherwise(F.translate(x["s"], "=", ""))

    def neighbours(x: Column) -> Column:
        return F.zip_with(F.slice(x["values"], 1, x["count"] - 1), F.slice(x["values"], 2, x["count"] - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    zero = F.lit(0.0)
    out = F.transform(pairs, lambda x: named(x, "span s", e=_encoding(x["s"])))
    out = F.transform(out, lambda x: named(x, "span", key=F.concat_ws("/", x["e"], _band(F.length(x["s"])).cast("string")), plain=plain(x), alphabet=F.element_at(alphabets, x["e"])))
    part = lambda x: (F.crc32(x["plain"].cast("binary")) + 0.5) / 4294967296.0 - 0.5
    out = F.transform(out, lambda x: named(x, "span key plain alphabet", u=part(x), count=F.length(x["plain"]), n=F.length(x["plain"]).cast("double"), k=F.length(x["alphabet"]).cast("double"), symbols=F.split(x["plain"], "")))
    squares = lambda x: F.aggregate(F.array_distinct(x["symbols"]), zero, lambda acc, c: acc + F.pow(x["count"] - F.length(F.replace(x["plain"], c, F.lit(""))), F.lit(2.0)))
    out = F.transform(out, lambda x: named(x, "span key count n k u", squares=squares(x), values=F.transform(x["symbols"], lambda c: F.instr(x["alphabet"], c).cast("double") - (x["k"] + 1) / 2)))
    out = F.transform(out, lambda x: named(x, "span key n k u squares", near=neighbours(x)))
    changes = lambda x: F.size(F.filter(x["near"], lambda y: (y["a"] > 0) != (y["b"] > 0)))
    out = F.transform(out, lambda x: named(x, "span key n k u squares", changes=changes(x), product=F.aggregate(x["near"], zero, lambda acc, y: acc + y["a"] * y["b"])))

    def moments(x: Column) -> Column:
        """The equal pairs' deviation and the shape of the gamma law with their skewness; the other two statistics as deviations."""
        n, k = x["n"], x["k"]
        pairs, q = n * (n - 1) / 2, 1 / k
        var = pairs * q * (1 - q) + 1 / 12
        third = pairs * q * (1 - q) * (1 - 2 * q) + n * (n - 1) * (n - 2) * q * q * (1 - q)
        equal = ((x["squares"] - n) / 2 + x["u"] - pairs * q) / F.sqrt(var)
        m, beta = n - 1, 0.6 * (3 * k * k - 7) / (k * k - 1)
        runs = (x["changes"] + x["u"] - m / 2) / F.sqrt(m / 4 + 1 / 12)
        serial = x["product"] / (F.sqrt(m) * (k * k - 1) / 12)
        return named(x, "span key", equal=equal, shape=4 * var * var * var / (third * third), runs=F.abs(runs), serial=F.abs(serial), flat=-2 / m, peaked=(beta * beta - 3 + 6 * (beta - 1) * (m - 1) / m) / m)

    def scores(x: Column) -> Column:
        """Normal scores: the gamma law's by cube roots, the symmetric ones' by their kurtosis."""
        a = x["shape"]
        above = F.greatest(1 + x["equal"] / F.sqrt(a), F.lit(1e-9))
        even = lambda z, kurtosis: F.greatest(z - kurtosis / 24 * (z * z * z - 3 * z), F.lit(0.0))
        # far out the correction of a law with heavy tails would turn round: it stops where it is largest
        peaked = F.least(x["serial"], F.sqrt(8 / x["peaked"] + 1))
        return named(x, "span key", a=3 * F.sqrt(a) * (F.cbrt(above) - 1 + 1 / (9 * a)), b=even(x["runs"], x["flat"]), c=even(peaked, x["peaked"]))

    def p_value(x: Column) -> Column:
        tail = lambda z: F.when(z >= 0, _normal_tail(F.abs(z))).otherwise(1 - _normal_tail(F.abs(z)))
        least = F.least(tail(x["a"]), 2 * tail(x["b"]), 2 * tail(x["c"]))
        return least * (3 - 3 * least + least * least)  # 1 - (1 - least) ** 3, without the loss

    for step in (moments, scores, lambda x: named(x, "span key", p=p_value(x))):
        out = F.transform(out, step)
    return out


def scanned(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """Adds base (spans of the patterns) and tested (candidates with key and p, and gain where a model is given) to docs; its text column stays as it is."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs
    # most texts hold no match at all: what a match has to hold is looked for before the pattern is, and long hex runs only within candidates
    says = reduce(operator.or_, [F.lower(text).contains(word) for word in ("password", "passwd", "secret", "token", "api")])
    for name, pattern, may in (("_long", CANDIDATE, F.lit(True)), ("_assign", ASSIGN, says), ("_access", ACCESS, text.contains("AKIA")), ("_hex", HEX, F.size("_long") > 0)):
        d = d.withColumn(name, F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    some = lambda name: F.size(name) > 0
    d = d.withColumn("_values", F.when(some("_assign"), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))))
    at = lambda name, pattern, kind: F.when(some(name), _positions(F.col(name), F.split(text, pattern, -1), kind)).otherwise(F.array().cast(_SPAN))
    d = d.withColumn("_assign", at("_assign", ASSIGN, 0)).withColumn("_access_at", at("_access", ACCESS, 1)).withColumn("_hex", at("_hex", HEX, 2)).withColumn("_long_at", at("_long", CANDIDATE, 3))
    long_enough = F.filter(F.zip_with("_assign", "_values", lambda x, v: F.struct(x.alias("x"), F.length(v).alias("n"))), lambda y: y["n"] >= 6)
    assign = F.when(some("_assign"), F.transform(long_enough, lambda y: y["x"])).otherwise(F.array().cast(_SPAN))
    access = F.filter("_access_at", lambda x: x["stop"] - x["start"] >= 20)
    spans = d.withColumn("base", F.array_sort(F.concat(assign, access, "_hex")))
    pairs = F.filter(F.zip_with("_long", "_long_at", lambda s, span: F.struct(s.alias("s"), span.alias("span"))), lambda x: x["s"].rlike("[A-Za-z0-9]"))
    spans = spans.withColumn("_pairs", pairs)
    tested = _battery(F.col("_pairs"))
    if model is not None:
        gains = F.transform("_pairs", lambda x: _gain(x["s"], model))
        tested = F.zip_with(tested, gains, lambda x, g: F.struct(*[x[k].alias(k) for k in ("span", "key", "p")], g.alias("gain")))
    return spans.select(*docs.columns, "base", F.when(F.size("_pairs") > 0, tested).alias("tested"))


class Control(NamedTuple):
    """What a band asks of a run: a level of p (see _level) below this one, and at least this whole gain; None: no run passes."""

    level: int
    gain: int | None


def _level(p: Column) -> Column:
    """p as its place below 1 in steps of a quarter of a power of two; larger for smaller p."""
    return F.least(F.floor(-F.log2(F.greatest(p, F.lit(1e-300))) * _STEPS), F.lit(_LEVELS)).cast("int")


def controls(tested: DataFrame, scan: Scan = Scan()) -> dict[str, Control]:
    """For each encoding and band (32 at most) what its runs have to meet, from the counts of all runs by level and gain."""
    one = tested.where("tested IS NOT NULL").select(F.explode("tested").alias("x")).select("x.key", _level(F.col("x.p")).alias("level"), F.greatest(F.lit(-1), F.least(F.lit(MOST_GAIN), F.floor("x.gain"))).cast("int").alias("g"))
    bands: dict[str, dict[tuple[int, int], int]] = {}
    for r in one.groupBy("key", "level", "g").agg(F.count("*").alias("n")).collect():  # levels and gains are bounded
        bands.setdefault(r["key"], {})[r["level"], r["g"]] = r["n"]
    out = {}
    for key, counts in bands.items():
        m = sum(counts.values())
        below = lambda level: sum(n for (k, _), n in counts.items() if k >= level)
        level = next((k for k in range(_LEVELS + 1) if 2 ** (-k / _STEPS) * m <= scan.lost * below(k)), _LEVELS + 1)
        passing = lambda g: sum(n for (k, h), n in counts.items() if k < level and h >= g)
        gain = next((g for g in range(MOST_GAIN + 1) if passing(g) and g >= math.log(m / (scan.false_rate * passing(g)))), None)
        out[key] = Control(level, gain)
    return out


def find_secrets(docs: DataFrame, scan: Scan = Scan(), keep: list[str] | None = None) -> DataFrame:
    """docs with a text column. Returns docs' columns, or those of keep, with base and random: arrays of (start, kind, stop) in code points, by start, then kind.

    A null text is empty and has no spans. Repeated rows and ties of ids change nothing, since rows are looked at one by one
    and the bands' counts take in all of them. Columns of docs named base, tested or random are replaced. No rows give no rows."""
    docs = docs.drop("base", "tested", "random")
    model = learn_runs(docs, scan)
    rows = written(scanned(docs, model).select(*(docs.columns if keep is None else keep), "base", "tested"), "scanned")
    asked = {key: c for key, c in controls(rows, scan).items() if c.gain is not None}
    bands = F.create_map(*[x for key, c in asked.items() for x in (F.lit(key), F.struct(F.lit(c.level).alias("level"), F.lit(c.gain).alias("gain")))]) if asked else F.lit(None).cast("map<string,struct<level:int,gain:int>>")
    met = lambda x: _let(F.try_element_at(bands, x["key"]), lambda c: F.coalesce((_level(x["p"]) < c["level"]) & (x["gain"] >= c["gain"]), F.lit(False)))
    found = F.transform(F.filter("tested", met), lambda x: x["span"])
    return rows.withColumn("random", F.coalesce(found, F.array().cast(_SPAN))).drop("tested")


def spans_text(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.encode(spans_text(F.col("base")), "UTF-8"), 256).alias("base_sha256"), spans_text(F.array_sort(F.concat("base", "random"))).alias("spans")
    )


def masked(docs: DataFrame, scan: Scan = Scan(), mark: str = "[secret]") -> DataFrame:
    """docs with every secret in text replaced by mark; overlapping spans are one. n_chars, where there is such a column, follows.

    docs' columns come back as they are, whatever their names; a null text stays null."""
    slim, back = set_aside(docs, "text", "n_chars")
    found = find_secrets(slim, scan)
    text = F.coalesce(F.col("text"), F.lit(""))

    def cut(blocks: Column, lo: Column, hi: Column) -> Column:
        """Characters lo to hi, from the blocks that hold them."""
        first = F.floor(lo / _BLOCK).cast("int")
        here = F.array_join(F.slice(blocks, first + 1, F.floor((hi - 1) / _BLOCK).cast("int") - first + 1), "")
        return F.when(lo < hi, F.substring(here, lo - first * _BLOCK + 1, hi - lo)).otherwise("")

    def replaced(x: Column) -> Column:
        """x: blocks of the text and its spans. What stands before a span that begins a run of overlapping ones, and the mark; then the rest."""
        before = _before(F.transform(x["spans"], lambda s: s["stop"]), F.greatest)
        gaps = F.filter(F.zip_with(before, x["spans"], lambda lo, s: F.struct(lo.alias("lo"), s["start"].alias("hi"))), lambda g: g["lo"] <= g["hi"])
        last = F.array_max(F.transform(x["spans"], lambda s: s["stop"]))
        return F.concat(F.array_join(F.transform(gaps, lambda g: F.concat(cut(x["blocks"], g["lo"], g["hi"]), F.lit(mark))), ""), cut(x["blocks"], last, x["size"]))

    found = found.withColumn("_spans", F.array_sort(F.concat("base", "random")))
    whole = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)).alias("blocks"), F.col("_spans").alias("spans"), F.length(text).alias("size"))
    out = found.withColumn("_new", F.when(F.size("_spans") > 0, _let(whole, replaced)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("_new").cast(kind)).otherwise(F.col("n_chars")))
    return back(out.withColumn("text", F.col("_new")))
