"""Sharding: a hierarchical weighted hash tree; a row descends region, rack and shard levels by weighted hash draws.

At each level every child draws -ln(u) / weight, where u in (0, 1] comes from a digest of the row's key and the child's path, and
the least draw wins. A child that wins does so with the share that its weight has of its siblings'. A draw depends on the child's own
path and weight only. So where weights change below one child of a node, rows move between that child and its siblings or stay where
they are: whatever lies in a subtree whose own weight and siblings' weights are as before stays in place, at every level.

A shard that is added inside a rack draws rows into the rack, and they are drawn anew among the rack's shards. `grown` adds a shard as a
rack and region of its own, and then the rows that move go to the new shard alone.

Placing is one expression for a row. Slots count the rows of a shard in the order of the key: rows are sorted in ranges of (shard,
key), each range is numbered by itself, and what stands before it comes from one count for each range and shard.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgefield.llm._common import forget, parts, written

_DIGITS = 13  # hexadecimal digits of the digest that make u: 52 bits, which a double holds


class Shard(NamedTuple):
    """A shard's place and weight; the weight of a rack or region is the sum of its shards'."""

    region: str
    rack: str
    number: int
    weight: float = 1.0


def even(regions: int = 3, racks: int = 2, shards: int = 4) -> tuple[Shard, ...]:
    """Shards 0, 1, ... of equal weight in a tree that has as many children everywhere in a level."""
    return tuple(Shard(f"region{i // (racks * shards)}", f"rack{i // shards % racks}", i) for i in range(regions * racks * shards))


def grown(tree: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """tree with one more shard, numbered next, in a region of its own, so that rows move into that shard only."""
    number = max((s.number for s in tree), default=-1) + 1
    return (*tree, Shard(f"region+{number}", "rack0", number, weight))


class _Level(NamedTuple):
    """For each node of a level above: (index of the child in its own level, path, weight) of the children that have weight."""

    children: tuple[tuple[tuple[int, str, float], ...], ...]


def _levels(tree: tuple[Shard, ...]) -> tuple[_Level, _Level, _Level]:
    if len({s.number for s in tree}) != len(tree):
        raise ValueError("shards have numbers of their own")
    if any(not 0 <= s.weight < float("inf") for s in tree) or not any(s.weight for s in tree):
        raise ValueError("weights are finite and 0 or more, and one is above 0")
    paths = [lambda s: "", lambda s: s.region, lambda s: f"{s.region}/{s.rack}", lambda s: f"{s.region}/{s.rack}/{s.number}"]
    out = []
    nodes = [""]
    for upper, lower in zip(paths, paths[1:]):
        below: dict[str, dict[str, float]] = {n: {} for n in nodes}
        for s in sorted(tree, key=lambda s: s.number):
            if s.weight:
                kids = below[upper(s)]
                kids[lower(s)] = kids.get(lower(s), 0.0) + s.weight
        then = [path for n in nodes for path in below[n]]
        index = {path: i for i, path in enumerate(then)}
        out.append(_Level(tuple(tuple((index[path], path, w) for path, w in below[n].items()) for n in nodes)))
        nodes = then
    return tuple(out)


def _numbers(levels: tuple[_Level, ...]) -> list[int]:
    """Shard numbers by index in the last level."""
    return [number for _, number in sorted((i, int(path.rpartition("/")[2])) for kids in levels[-1].children for i, path, _ in kids)]


def shard_of(key: Column, tree: tuple[Shard, ...]) -> Column:
    """The shard number for a key; keys are compared as text, and a null key is the empty text."""
    levels = _levels(tree)
    text = F.coalesce(key.cast("string"), F.lit(""))
    at: Column = F.lit(0)
    for level in levels:
        kids = F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.lit(path).alias("path"), F.lit(float(w)).alias("w")) for i, path, w in kids]) for kids in level.children])

        def draw(kid: Column) -> Column:
            u = (F.conv(F.substring(F.md5(F.concat_ws("|", text, kid["path"])), 1, _DIGITS), 16, 10).cast("long") + 1) / F.lit(float(16**_DIGITS))
            return F.struct((-F.ln(u) / kid["w"]).alias("draw"), kid["i"].alias("i"))

        at = F.array_min(F.transform(F.get(kids, at), draw))["i"]
    return F.get(F.array(*[F.lit(n) for n in _numbers(levels)]), at)


def placed(docs: DataFrame, tree: tuple[Shard, ...] = even(), key: str = "doc_id") -> DataFrame:
    """Adds region, rack and shard to every row; columns of these names are replaced, others come through as they are.

    Only the key decides: rows that repeat a key go together, whatever else they hold, and so do all rows without one (as the
    empty text). Equal texts under different keys are placed apart. No rows give no rows. No shuffle; a text is not looked at."""
    ordered = sorted(tree, key=lambda s: s.number)
    where = F.create_map(*[x for s in ordered for x in (F.lit(s.number), F.struct(F.lit(s.region).alias("region"), F.lit(s.rack).alias("rack")))])
    out = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("region", "rack", "shard")], shard_of(F.col(f"`{key}`"), tree).alias("shard"))
    return out.withColumn("region", where[F.col("shard")]["region"]).withColumn("rack", where[F.col("shard")]["rack"])


def slotted(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with a shard: adds slot, from 0 without gaps within each shard, in the order of the columns named (nulls first).

    Rows that agree in all those columns may change slots among themselves; they can be any share of the rows, of one shard or of one key.
    A slot column is replaced. Rows are written once, sorted, to the shared folder. No rows give no rows."""
    tie = F.monotonically_increasing_id()
    flat = written(rows.drop("slot").withColumn("_tie", tie), "placed")
    by = ["shard", *order, "_tie"]
    sorted_ = flat.repartitionByRange(parts(flat.sparkSession), *by).sortWithinPartitions(*by).drop("_tie")
    numbered = written(sorted_.withColumn("_at", F.monotonically_increasing_id()), "sorted")  # a partition's rows are numbered in their order
    forget(flat)
    part = F.shiftright("_at", 33)
    counts = numbered.groupBy("shard", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # a range holds the end of one shard and the start of the next: at most as many rows as ranges and shards together
    at = {}
    starts = []
    for r in sorted(counts.collect(), key=lambda r: (r["shard"], r["_part"])):
        starts.append((r["shard"], r["_part"], r["_first"] - at.get(r["shard"], 0)))
        at[r["shard"]] = at.get(r["shard"], 0) + r["_n"]
    shift = flat.sparkSession.createDataFrame(starts, "shard int, _part long, _shift long")
    return numbered.withColumn("_part", part).join(F.broadcast(shift), ["shard", "_part"]).withColumn("slot", F.col("_at") - F.col("_shift")).select(*[f"`{c}`" for c in rows.columns if c != "slot"], "slot")


def placement(docs: DataFrame, tree: tuple[Shard, ...] = even()) -> DataFrame:
    """docs: doc_id, text and any others, which are not looked at. For each row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: doc_id and the tree decide, and with one more shard (`grown`) a row stays or goes to the new shard. A null text has no
    bytes (size 8, checksum 0), like an empty one; long texts are read once, for size and checksum, and not shuffled. Repeated rows
    each have a slot. No rows give no rows."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree).alias("shard"), shard_of(F.col("doc_id"), grown(tree)).alias("grown_shard"),
    )
    return slotted(slim, ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def moves(docs: DataFrame, before: tuple[Shard, ...], after: tuple[Shard, ...], key: str = "doc_id") -> DataFrame:
    """What a change of the tree moves: from_shard, to_shard, rows; one row for each pair of shards that rows go between."""
    both = docs.select(shard_of(F.col(f"`{key}`"), before).alias("from_shard"), shard_of(F.col(f"`{key}`"), after).alias("to_shard"))
    return both.where("from_shard != to_shard").groupBy("from_shard", "to_shard").agg(F.count("*").alias("rows"))


def write_shards(docs: DataFrame, path: str, tree: tuple[Shard, ...] = even(), rows_per_file: int = 100_000) -> None:
    """Writes docs as Parquet under path/region=/rack=/shard=; files hold about rows_per_file rows, so a large shard is many files.

    One task writes one file's share of one shard; which file a row goes to is a hash of the row, of all columns but maps. A table at
    path is replaced."""
    there = placed(docs, tree)
    hashed = F.xxhash64(*[f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind], F.monotonically_increasing_id())
    n = docs.count()
    files = max(1, -(-n // (rows_per_file * len(tree))))
    spread = there.withColumn("_file", F.pmod(hashed, F.lit(files)))
    width = max(1, min(files * len(tree), 100 * parts(docs.sparkSession)))
    spread.repartition(width, "shard", "_file").drop("_file").write.mode("overwrite").partitionBy("region", "rack", "shard").option("maxRecordsPerFile", rows_per_file).parquet(path)


def oracle(tree: tuple[Shard, ...] = even()) -> str:
    """The placement of `documents` as DuckDB SQL, with the checksum by nibbles."""

    def descend(tree: tuple[Shard, ...], name: str) -> str:
        levels = _levels(tree)
        ctes, source, at = [], "documents_keys", "0"
        for depth, level in enumerate(levels):
            cases = []
            for node, kids in enumerate(level.children):
                draws = ", ".join(f"-ln((('0x' || substr(md5(k || '|{path}'), 1, {_DIGITS}))::BIGINT + 1) / {float(16**_DIGITS)!r}) / {float(w)!r}" for _, path, w in kids)
                cases.append(f"WHEN {node} THEN (SELECT [{', '.join(str(i) for i, _, _ in kids)}][list_position(d, list_min(d))] FROM (SELECT [{draws}] AS d))")
            ctes.append(f"{name}{depth} AS (SELECT k, CASE {at} {' '.join(cases)} END AS node FROM {source})")
            source, at = f"{name}{depth}", "node"
        return ",\n".join(ctes) + f",\n{name} AS (SELECT k, {_numbers(levels)}[node + 1]::INTEGER AS shard FROM {source})"

    table = []
    for i in range(16):
        for _ in range(4):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    half = lambda c: f"xor({c} >> 4, {table}[1 + ({c} & 15)])"
    return f"""
WITH documents_keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS k FROM documents),
{descend(tree, "s")},
{descend(grown(tree), "g")},
b AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, strlen(coalesce(text, '')) + 8 AS size,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT) AS b FROM documents),
c AS (SELECT doc_id, k, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: {half(half("xor(c, x)"))}), 4294967295) AS text_crc32 FROM b)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, s.shard,
       row_number() OVER (PARTITION BY s.shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, g.shard AS grown_shard
FROM c JOIN s USING (k) JOIN g USING (k)
"""
