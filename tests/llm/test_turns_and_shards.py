import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from edgefield.llm import queries, sharding, turns

GRAMMAR = re.compile(turns.GRAMMAR)
WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows):
    """The cheapest edits of one conversation by listing them all: (cost, audit, lines). Insertions: up to two between turns."""
    seen, faults = set(), []
    for role, text in rows:
        marks = WORD.findall(text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    gaps = [()] + [x for k in (1, 2) for x in itertools.product(("user", "assistant"), repeat=k)]
    best = None

    def walk(i, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for extra in gaps:
            c, a, o = cost + 5 * len(extra), audit + "I" * len(extra), out + [(r, "") for r in extra]
            if i == len(rows):
                if GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in o)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, o)
                continue
            role, text = rows[i]
            walk(i + 1, c + 2, a + "D", o)
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                walk(i + 1, c + more, a + "K", o + [(role, text)])
                for new in ("user", "assistant"):
                    walk(i + 1, c + 1 + more, a + "R", o + [(new, text)])

    walk(0, 0, "", [])
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    return Counter(faults), sum(p not in ("su", "ua", "au") for p in pairs), best


def digest(lines):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def repaired(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r.conv_id: r for r in turns.digests(df, turns.repaired(df)).collect()}


def test_short_conversations_against_all_edits(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No!", "and so", "", " \t", "Why?", "x"]
    convs = {c: [(rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]), rng.choice(texts)) for _ in range(rng.randrange(1, 5))] for c in range(120)}
    got = repaired(spark, [(c, i, *t) for c, ts in convs.items() for i, t in enumerate(ts)])
    assert got.keys() == convs.keys()
    for c, rows in convs.items():
        faults, illegal, (cost, audit, lines) = brute(rows)
        r = got[c]
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, digest(lines)), rows
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.gaps) == (faults["blank"], faults["duplicate"], faults["truncated"], illegal, 0)


def plain(rows):
    """Least (cost, audit) by state, turn by turn, for a conversation of any length."""
    now = {0: (0, "")}
    relax = lambda m: [m.update({y: k}) for _ in range(3) for x, y in ((0, 2), (1, 2), (3, 2), (2, 3)) if x in m and (k := (m[x][0] + 5, m[x][1] + "I")) < m.get(y, (9**9,))]
    for initial, fault in rows:
        relax(now)
        then = {}
        for s, (c, a) in now.items():
            options = [(s, c + 2, "D")]
            if fault not in (1, 2):
                t, more = (3 if s == 2 else 2), 5 * (fault == 3)
                options.append((t, c + 1 + more, "R"))
                options += [(k, c + more, "K") for k, want in ((1, "s" if s == 0 else ""), (t, "ua"[t - 2])) if want == initial]
            for t, cost, letter in options:
                then[t] = min(then.get(t, (9**9,)), (cost, a + letter))
        now = then
    relax(now)
    return min(now[s] for s in (0, 3) if s in now)


def test_a_conversation_over_many_chunks(spark):
    rng = random.Random(9)
    hot = [(7, i if i % 11 else None, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["A.", f"t{i}.", f"n{i}", "", f"q{i}?"])) for i in range(2300)]
    rows = hot + [(c, i, ("user", "assistant")[i % 2], f"c{i}.") for c in (6, 8) for i in range(4)] + [(None, i, "user", "hm") for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    fix = turns.repaired(df)
    got = {r.conv_id: r for r in turns.digests(df, fix).collect()}
    for conv in (7, None):
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in mine:
            faults.append(1 if not text.strip() else 2 if (role, text) in seen else 0 if text[-1] in ".!?" else 3)
            seen.add((role, text))
        cost, audit = plain([(r[1][:1], f) for r, f in zip(mine, faults)])
        assert (got[conv].cost, got[conv].audit) == (cost, audit)
        edits = [r for r in fix.turns.where(F.col("conv_id").eqNullSafe(F.lit(conv))).collect()]
        kept = sorted((r for r in edits if r.edit != "D"), key=lambda r: r.position)
        assert [r.position for r in kept] == list(range(len(kept))) and GRAMMAR.fullmatch("".join(r.role[:1] for r in kept))
        assert Counter(r.edit for r in edits) == Counter(audit) and got[conv].repaired_sha256 == digest([(r.role, r.text) for r in kept])
    assert got[7].gaps == 2300 - 2 + 1 - 1 - len({r[1] for r in hot if r[1] is not None}) + 0 and got[6].audit == got[8].audit == "KKKK"


def test_odd_turns(spark):
    rows = [
        (1, None, "user", "No turn."), (1, 5, "user", "late."), (1, 9, "assistant", "end."), (2, 0, None, "role is gone."), (2, 1, "assistant", None), (3, 0, "user", "x" * 300_000 + "."),
        (3, 1, "assistant", "ok."), (4, 0, "", ""), (5, 0, "user", "Hi."), (5, 0, "user", "Hi."), (5, 0, "user", "Hi."), (5, 1, "assistant", "𝔘é."), (6, None, "system", "s."), (7, 3, "user", "a\n"),
    ]
    clash = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS at", "'x' AS chunk", "'x' AS edit", "'x' AS _same", "'x' AS cost")
    got = {r.conv_id: r for r in turns.digests(clash, turns.repaired(clash)).collect()}
    by = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        by[c].append((" " if role is None else role, " " if text is None else text))
    for c, conv in by.items():
        faults, illegal, (cost, audit, lines) = brute(conv)
        assert (got[c].cost, got[c].audit, got[c].repaired_sha256, got[c].illegal, got[c].duplicate) == (cost, audit, digest(lines), illegal, faults["duplicate"])
    assert [got[c].gaps for c in (1, 5, 6)] == [3, 0, 0]
    none = clash.where("false")
    assert turns.digests(none, turns.repaired(none)).count() == 0


def test_a_conversation_that_loses_all_turns(spark):
    lost = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(c, 0, "user", "Hi.") for c in range(400)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in turns.digests(df, turns.repaired(turns.damaged(df))).collect()}
    assert len(got) == 400 and lost
    assert all(got[c].audit == "" and got[c].cost == 0 and got[c].repaired_sha256 == hashlib.sha256(b"").hexdigest() for c in lost)


def same_as_sql(spark, sf, name, table):
    got = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{Path(sf) / table}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name, table", [("op12_conversation_repair", "conversations"), ("op13_sharding", "documents")])
def test_query_is_its_sql(spark, sf, name, table):
    same_as_sql(spark, sf, name, table)


def test_placement_of_odd_rows(spark, odd, none):
    got = sharding.placement(odd).collect()
    assert len(got) == odd.count() and sharding.placement(none).count() == 0
    texts = defaultdict(list)
    for r in odd.select("doc_id", "text").collect():
        texts[r.doc_id].append((len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())))
    mine = defaultdict(list)
    for r in got:
        mine[r.doc_id].append((r.size, r.text_crc32))
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in texts.items()}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    clash = odd.selectExpr("*", "1 AS shard", "'x' AS region", "'x' AS rack", "5 AS slot")
    assert sorted(sharding.placed(clash).columns) == sorted(clash.columns)


def test_one_id_on_a_third_of_all_rows(spark):
    df = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 42 ELSE id END AS doc_id", "'same' AS text").repartition(4)
    got = sharding.placement(df).toPandas()
    assert got[got.doc_id == 42].shard.nunique() == 1
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))


def shards(spark, n, tree):
    return [r.s for r in spark.range(n).select(sharding.shard_of(F.col("id"), tree).alias("s"), "id").orderBy("id").collect()]


def test_weights_and_movement(spark):
    n = 60_000
    tree = sharding.even()
    before = shards(spark, n, tree)
    assert all(abs(c - n / 24) < 5 * (n / 24) ** 0.5 for c in Counter(before).values())
    after = shards(spark, n, sharding.grown(tree))
    moved = [(b, a) for b, a in zip(before, after) if a != b]
    assert {a for _, a in moved} == {24} and abs(len(moved) - n / 25) < 5 * (n / 25) ** 0.5
    # a heavier shard draws rows into its region; within it they only move to its rack, and within that only to it
    place = {s.number: (s.region, s.rack) for s in tree}
    heavy = tuple(s._replace(weight=3.0) if s.number == 9 else s for s in tree)
    then = shards(spark, n, heavy)
    for b, a in zip(before, then):
        if a != b:
            assert place[a][0] == place[9][0]
            if place[b][0] == place[9][0]:
                assert place[a] == place[9]
            if place[b] == place[9]:
                assert a == 9
    assert abs(Counter(then)[9] - 3 * n / 26) < 5 * (3 * n / 26) ** 0.5
    # without weight a shard gets nothing, and the others' rows of untouched racks stay in their racks
    gone = shards(spark, n, tuple(s._replace(weight=0.0) if s.number == 0 else s for s in tree))
    assert 0 not in gone
    with pytest.raises(ValueError):
        sharding.placed(spark.range(1).withColumnRenamed("id", "doc_id"), tuple(s._replace(weight=0.0) for s in tree))


def test_moves_and_written_shards(spark, tmp_path):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    tree = sharding.even(2, 2, 2)
    moved = {(r.from_shard, r.to_shard): r.rows for r in sharding.moves(df, tree, sharding.grown(tree)).collect()}
    assert moved and {k[1] for k in moved} == {8}
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(df, path, tree, rows_per_file=100)
    back = spark.read.parquet(path)
    want = {r.doc_id: (r.region, r.rack, r.shard) for r in sharding.placed(df, tree).collect()}
    assert {r.doc_id: (r.region, r.rack, r.shard) for r in back.collect()} == want
    assert back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 100
