"""Figures cited in text, reproduction commands, ids and units, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgefield.functions.axes import UNIT_SUFFIXES

NUMBER = r"\b[0-9]+\.[0-9]+\b"


def unit_of(field: Column) -> Column:
    out = F.lit("1")
    for suffix, unit in reversed(UNIT_SUFFIXES):
        out = F.when(field.endswith(suffix), unit).otherwise(out)
    return out


def degradation_of(axis: Column) -> Column:
    """What stands before the first dot, and after it."""
    return F.struct(F.substring_index(axis, ".", 1).alias("degradation"), F.regexp_extract(axis, r"^[^.]*\.(.*)$", 1).alias("field"))


def probe_id(axis: Column, value: Column) -> Column:
    return F.concat(axis, F.lit("@"), value)


def store_key(dataset: Column, pipeline: Column, frames: Column, seed: Column, condition: Column) -> Column:
    """A key for a probe's memory; condition is a map, written in the order of its keys."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(condition)))
    return F.concat_ws("|", dataset, pipeline, frames.cast("string"), seed.cast("string"), F.to_json(ordered))


def command(axis: Column, value: Column, seed: Column) -> Column:
    return F.concat_ws(" ", F.lit("edgefield probe --axis"), axis, F.lit("--value"), value, F.lit("--seed"), seed.cast("string"))


def set_command(condition: Column, seed: Column) -> Column:
    """condition: a map of axis to value as text; its entries in the order of their names."""
    entries = F.transform(F.array_sort(F.map_entries(condition)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws(" ", F.lit("edgefield probe --set"), F.array_join(entries, " "), F.lit("--seed"), seed.cast("string"))


def worker_command(condition: Column, fixed: Column, dataset: Column, pipeline: Column, frames: Column, seed: Column) -> Column:
    """The same with what is pinned besides the axes, and what it runs over; nothing is said of pins where there are none."""
    pins = F.transform(F.array_sort(F.map_entries(fixed)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    fix = F.when(F.size(pins) > 0, F.concat(F.lit("--fix "), F.array_join(pins, " ")))
    return F.concat_ws(" ", set_command(condition, seed), fix, F.lit("--dataset"), dataset, F.lit("--pipeline"), pipeline, F.lit("--frames"), frames.cast("string"))


#: Fixed values, the syntax of the documents: a figure's source stands in a comment after it; code spans and comments are not prose.
SOURCE_MARK = r"<!--[ \t]*bench:([^\s>]+)[ \t]*-->"
CODE_SPAN = r"`[^`]*`"
COMMENT = r"(?s:<!--.*?-->)"

# A citation is a number, a unit of at most twelve letters or signs if there is one, and the source's comment, on one line.
_COUNT = r"-?\d[\d,]*(?:\.\d+)?"
_UNIT = r"[\p{L}%°×/]{1,12}"
CITATION = rf"({_COUNT})[ \t]*({_UNIT})?[ \t]*{SOURCE_MARK}"
_NOT_PROSE = "|".join((CITATION, CODE_SPAN, COMMENT))
#: Words and numbers with what dots hold together: a decimal is one that begins with digits, a dot and digits, and goes on with neither.
_TOKEN = r"[\w.]*\w"
_DECIMAL = r"^(\d+\.\d+)(?:[^\d.]|\.\D|$)"


def cited_figures(text: Column) -> Column:
    """Figures with a source beside them: an array of (value, unit or null, path); thousands are told by commas."""
    part = lambda i: F.regexp_extract_all(text, F.lit(CITATION), F.lit(i))
    rows = F.arrays_zip(part(1).alias("v"), part(2).alias("u"), part(3).alias("p"))
    return F.transform(rows, lambda r: F.struct(F.replace(r["v"], F.lit(","), F.lit("")).try_cast("double").alias("value"), F.nullif(r["u"], F.lit("")).alias("unit"), r["p"].alias("path")))


def uncited_figures(text: Column) -> Column:
    """Decimals that no citation covers and that stand in no code span or comment: an array of (line, figure), lines from 1."""
    prose, covered = F.split(text, _NOT_PROSE, -1), F.regexp_extract_all(text, F.lit(_NOT_PROSE), F.lit(0))
    blanks = F.transform(covered, lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"[^\n]+", "")))  # line ends stay, to count by
    joined = F.array_join(F.zip_with(prose, blanks, lambda p, b: F.concat(p, F.coalesce(b, F.lit("")))), "")
    figures = lambda line: F.filter(F.transform(F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(0)), lambda t: F.regexp_extract(t, _DECIMAL, 1)), lambda f: f != "")
    return F.flatten(F.transform(F.split(joined, "\n"), lambda line, i: F.transform(figures(line), lambda f: F.struct((i + 1).alias("line"), f.alias("figure")))))


def limitations(markdown: Column) -> Column:
    """What each numbered item under the heading of known limitations opens with in bold, as plain text; none without the heading.

    An item begins where a line begins with a number, a dot and a bold text; it may run over several lines."""
    under = F.get(F.split(markdown, "## Known limitations", 2), F.lit(1))
    items = F.slice(F.split(under, r"(?m)^\d+\.\s+(?=\*\*)", -1), 2, 1 << 20)
    bold = F.transform(items, lambda item: F.split(item, r"\*\*", 3))
    plain = F.transform(F.filter(bold, lambda b: (F.size(b) == 3) & (b[1] != "")), lambda b: F.trim(F.regexp_replace(F.translate(b[1], "`", ""), r"\s+", " ")))
    return F.coalesce(plain, F.array().cast("array<string>"))


def trace_line(decision_id: Column, tool: Column, accepted: Column, detail: Column) -> Column:
    """One line of a run's decisions: id and tool in columns of fixed width, what became of it, and what it was about."""
    head = F.concat_ws(" ", F.rpad(decision_id, 16, " "), F.rpad(tool, 24, " "), F.when(accepted, "accepted").otherwise("REFUSED "))
    return F.concat_ws(" ", head, detail)


def trace_detail(tool: Column, call: Column, usd: Column, left: Column, probes: Column, order: Column, reason: Column, axis: Column) -> Column:
    """What a decision was about, by its tool; null for tools that say nothing more."""
    money = lambda c: F.concat(F.lit("$"), F.format_string("%.4f", c))
    return (
        F.when(tool == "explain_failure", F.concat(F.lit("facts for "), axis))
        .when(tool == "agent.model_call", F.concat(F.lit("call "), call.cast("string"), F.lit(": charged "), money(usd), F.lit(", contract left "), money(left)))
        .when(tool == "reallocate_budget", F.concat(probes.cast("string"), F.lit(" probes split -> "), reason))
        .when(tool == "prioritize_axes", F.concat(F.lit("order "), F.array_join(order, ","), F.lit(" -> "), reason))
    )


def cited_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def masked_code(text: Column) -> Column:
    """Code spans and comments blanked, so that numbers in them do not count as figures of the text."""
    return F.regexp_replace(F.regexp_replace(text, r"`[^`\n]*`", ""), r"(?s)<!--.*?-->", "")


def placeholders(text: Column) -> Column:
    """How many notes in brackets say that something is to come: [TBD] or [TBD with a note], [update after something], in any case."""
    notes = F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\]\[]*)\]"), F.lit(1)), F.lower)
    return F.size(F.filter(notes, lambda n: n.rlike(r"^tbd\b") | n.startswith("update after ")))


def close_enough(a: Column, b: Column, share: float = 0.005) -> Column:
    return F.abs(a - b) <= share * F.greatest(F.abs(a), F.abs(b))


def tolerance_bucket(x: Column, share: float = 0.005) -> Column:
    """The logarithmic bucket of a positive number: numbers that are close enough are in the same bucket or in neighbouring ones."""
    return F.floor(F.log(x) / (2 * share)).cast("long")


def near_buckets(x: Column, share: float = 0.005) -> Column:
    b = tolerance_bucket(x, share)
    return F.array(b - 1, b, b + 1)


#: Nine stops of a colour-blind-safe sequential map, from low to high.
STOPS = ("440154", "472d7b", "3b528b", "2c728e", "21918c", "28ae80", "5ec962", "addc30", "fde725")


def colour(t: Column) -> Column:
    """A colour between the stops for a share of 0 to 1; nothing and what is no number count 0."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(t, F.lit(0.0)), F.lit(0.0)))) * (len(STOPS) - 1)
    k = F.least(F.floor(x), F.lit(len(STOPS) - 2)).cast("int")
    table = F.array(*[F.array(*[F.lit(int(s[i : i + 2], 16)) for i in (0, 2, 4)]) for s in STOPS])
    mix = lambda i: F.floor(F.get(F.get(table, k), F.lit(i)) * (1 - (x - k)) + F.get(F.get(table, k + 1), F.lit(i)) * (x - k) + 0.5)
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(mix(i))), 2, "0") for i in range(3)])


def with_unit(value: Column, unit: Column, digits: int = 4) -> Column:
    """A number is only ever shown with its unit."""
    return F.when(F.coalesce(unit, F.lit("")) == "", F.raise_error(F.lit("a number without a unit is not shown"))).otherwise(F.concat_ws(" ", F.format_number(value, digits), unit))


BUILD_KEYS = ("cv2_module", "build_info_sha256", "kleidicv")


def public_fingerprint(fingerprint: Column, licensed: Column) -> Column:
    """A machine's fingerprint without what is read from a licensed build."""
    return F.when(licensed, F.map_filter(fingerprint, lambda k, _: ~k.isin(*BUILD_KEYS))).otherwise(fingerprint)
