import zlib

import pytest
from pyspark.sql import functions as F

from edgefield.llm import langid, minhash, toxicity
from edgefield.llm._common import written
from edgefield.llm.queries import ORACLE_SQL, QUERIES


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def toxic_set(spark, n=1500):
    import random

    rng = random.Random(1)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        sentences = [" ".join(rng.choice(plain) for _ in range(rng.randrange(3, 12))) for _ in range(rng.randrange(1, 15))]
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(["Nastyword,", "vileword", "FOULWORD!"])
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels), dict(docs)


def test_toxicity_on_held_out_documents(spark):
    docs, labels, truth, texts = toxic_set(spark)
    model = toxicity.learn(docs, labels)
    rows = toxicity.scored(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == is_held_out(r.doc_id) for r in rows) and len(held) > 200
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    for r in rows:
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
        if truth[r.doc_id] and r.predicted:
            said = " ".join(texts[r.doc_id][s.start : s.stop] for s in r.sentences).lower()
            assert "nastyword" in said or "vileword" in said or "foulword" in said


def test_held_out_labels_teach_nothing(spark):
    docs, labels, _, _ = toxic_set(spark, 600)
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, turned)
    assert a.words.tolist() == b.words.tolist() and a.weights == pytest.approx(b.weights) and a.leak == b.leak


def test_toxicity_of_odd_rows(spark, odd, none):
    docs, labels, _, _ = toxic_set(spark, 400)
    model = toxicity.learn(docs, labels)
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[3].score == by[4].score == by[5].score == pytest.approx(model.leak)
    assert by[7].score == by[8].score
    assert toxicity.scored(none, model).count() == 0
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert len(toxicity.learn(docs, some).words) == 0
    assert toxicity.learn(none, labels).leak < 0.5
    doubled = labels.union(labels).union(spark.createDataFrame([(None, 1), (5, None)], labels.schema))
    assert toxicity.learn(docs, doubled).words.tolist() == model.words.tolist()


def test_language_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.predicted(docs, langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learn(docs)
    rows = langid.predicted(odd, model).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    for i in (3, 4, 5, 14):
        assert by[i] == [("und", 0.0)]
    assert by[15][0][0] != "und" and by[7] == by[8] and by[11][0] == by[11][1]
    assert set(x[0] for v in by.values() for x in v) <= {*model.languages, "und"}
    assert langid.predicted(none, model).count() == 0
    assert {r.lang_pred for r in langid.predicted(odd, langid.learn(none)).collect()} == {"und"}
    out = langid.annotated(odd, model)
    assert out.columns == [*[c for c in odd.columns if c not in ("lang_pred", "score")], "lang_pred", "score"]
    alone = langid.learn(docs.where("lang = 'fr'"))
    assert {r.lang_pred for r in langid.predicted(docs, alone).collect()} <= {"fr", "und"}


def test_pipeline_stages(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "secret_scan", "mix", "pack"]
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = written(stage(spark, docs, sf), name)
        if name != "pack":
            assert out.columns == columns
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= set(before) and len(after) > 0.5 * len(before)
        if name == "language_id":
            gone = set(before) - after
            assert all(len(before[i] or "") < 60 for i in gone)
        if name == "near_dedup":
            kept = minhash.near_duplicates(docs).where("kept").select("doc_id").collect()
            assert after == {r.doc_id for r in kept}
        if name == "secret_scan":
            assert after == set(before) and out.where("text RLIKE '[0-9a-f]{24,}'").count() == 0
        docs = out
    last = pipeline.run(spark, sf)
    assert sorted(map(tuple, last.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_language_stage_sends_unlearned_languages_away(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    strange = [
        "Это совсем другой язык, которого никто не учил, и он должен уйти.", "Αυτή είναι μια πρόταση σε μια γλώσσα που δεν έμαθε κανείς", "漢字漢字日本語の文章がここにあります", "이것은 아무도 배우지 않은 언어로 쓰인 문장입니다", "xqzvk jjwqpf zzkqx vvbnmq wrtplk qqzzx kkwjx pqvvz",
        "To zdanie jest napisane w języku, którego nikt się nie nauczył, więc musi odejść",
    ]
    clean = [r.text for r in docs.where("length(text) BETWEEN 200 AND 2000 AND text NOT RLIKE '[0-9]'").orderBy("doc_id").limit(40).collect()]
    short = [" ".join(t.split()[:k]) for t in clean for k in (5, 9, 20)]
    more = [(10**6 + i, t, None) for i, t in enumerate(strange)] + [(2 * 10**6 + i, t, None) for i, t in enumerate(short)]
    kept = {r.doc_id for r in pipeline.language_id(spark, docs.union(spark.createDataFrame(more, docs.schema)), sf).where("doc_id >= 1000000").collect()}
    assert not kept & {i for i, _, _ in more[: len(strange)]}
    assert len(kept) >= 0.97 * len(short)


def test_pipeline_stages_take_odd_rows(spark, odd, none, sf):
    """odd has columns of the operators' own names; they come through with their values."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    ids = lambda df: sorted((r.doc_id, r.text or "") for r in df.where("doc_id IS NOT NULL").collect())
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
        if name == "pack":
            assert stage(spark, odd, sf).where("start = 0").count() == len(rows)
            continue
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and out.where("component_id = 'x' AND kept = 'x' AND score = 'x' AND base = 'x' AND tested = 'x'").count() == out.count() > 0
        kept = ids(out)
        if name == "language_id":
            assert not {i for i, _ in kept} & {3, 4, 5, 14} and {1, 2, 12, 13} <= {i for i, _ in kept}
        if name == "near_dedup":
            assert {i for i, _ in kept} == {i for i, _ in rows if i is not None} - {2, 8, 10, 11, 13}
            assert stage(spark, odd.union(odd), sf).count() == out.count() == len(rows) - 6
        if name == "secret_scan":
            assert [i for i, _ in kept] == sorted(i for i, _ in rows if i is not None) and out.where("text IS NULL").count() == 2
        if name == "mix":
            assert {3, 4, 5} <= {i for i, _ in kept}


def test_pipeline_is_its_plain_version(spark, sf):
    """Each stage after the learned one against a plain version of it, on what the stage before kept."""
    import hashlib

    import pandas as pd
    from test_dedup import WORD, brute_minhash
    from test_filters import plain_scan
    from tokenizers import Tokenizer

    pipeline = pytest.importorskip("corpus_pipeline")
    docs = written(pipeline.language_id(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), "first")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    stays = brute_minhash([(i, r["text"]) for i, r in rows.items()], 5)
    rows = {i: r for i, r in rows.items() if stays[i][2]}
    for r, spans in zip(rows.values(), plain_scan([r["text"] for r in rows.values()])):
        out, at = "", 0
        for start, stop in (tuple(map(int, x.split(":")[1:])) for x in spans.split(",") if x):
            if start >= at:
                out += r["text"][at:start] + "[secret]"
            at = max(at, stop)
        r["text"] = out + r["text"][at:]
    m = pipeline.MIX
    x = pd.DataFrame(rows.values())
    x["tokens"] = x.text.map(lambda t: len(WORD.findall(t)))
    assert (x.tokens > 0).all()
    form = lambda t, n: "table" if t.count("|") * 4 >= n else "shout" if t.count("!") * 2 >= n else "noise" if sum(map(t.count, "#$%&*")) * 2 >= n else "list" if t.count("\n") * 12 >= n else "prose"
    x["topic"] = [form(t, n) for t, n in zip(x.text, x.tokens)]
    cells = x.groupby(["source", "lang", "topic"]).tokens.sum().astype(float).reset_index(name="t")
    cells["w"], total = cells.t, cells.t.sum()
    want = {}
    for d, temper in zip(("source", "lang", "topic"), m.tempers):
        share = pd.Series(m.targets[d]) if d in m.targets else cells.groupby(d).t.sum() ** temper
        want[d] = share / share.sum() * total
    off = 1.0
    while off > m.tolerance:
        off = 0.0
        for d in want:
            s = cells.groupby(d).w.transform("sum")
            off = max(off, (s - cells[d].map(want[d])).abs().max() / total)
            cells["w"] *= cells[d].map(want[d]) / s
    by, held = m.share, None
    while True:
        now = by * cells.w / cells.t >= 1
        if held is not None and now.sum() == held.sum():
            break
        held = now
        by = max(by, (m.share * total - cells.t[now].sum()) / cells.w[~now].sum())
    x = x.merge(cells, on=["source", "lang", "topic"])
    draw = x.doc_id.map(lambda i: int(hashlib.md5(f"{m.seed}{i}".encode()).hexdigest()[:12], 16) / 2**48)
    kept = x[draw < (by * x.w / x.t).clip(upper=1)]
    import public_tokenizers

    encode = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    n_tokens = {i: len(encode.encode(t, add_special_tokens=False).ids) + 1 for i, t in zip(kept.doc_id, kept.text)}
    got = pipeline.run(spark, sf).toPandas()
    assert got.groupby("doc_id")["length"].sum().to_dict() == n_tokens
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_are_their_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = c.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(found.columns)
    assert sorted(map(str, (tuple(r[k] for k in columns) for r in got.collect()))) == sorted(map(str, found.select(", ".join(columns)).fetchall()))
