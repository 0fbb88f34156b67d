import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edgefield.llm import matroska, packing
from edgefield.llm._common import written


@settings(max_examples=120, deadline=None)
@given(st.binary(max_size=5000), st.sampled_from([1, 2, 3]), st.integers(1, 700), st.integers(1, 9), st.integers(1, 4))
def test_round_trip(data, lacing, frame, laced, blocks):
    payload = matroska._padded(data)
    media = matroska.write(payload, matroska.Layout(frame=frame, laced=laced, blocks=blocks, lacing=lacing))
    found = matroska.packets(media)
    assert b"".join(media[p.start : p.start + p.size] for p in found) == payload
    assert [p.timestamp for p in found] == sorted(p.timestamp for p in found) and {p.track for p in found} == {1}
    assert sum(p.cued for p in found) == -(-len(payload) // (frame * laced * blocks))


def test_unknown_sizes_block_groups_and_broken_files():
    block = b"\x81\x00\x05\x00abcd"
    group = matroska._element(matroska.BLOCK_GROUP, matroska._element(matroska.BLOCK, block))
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska._uint(matroska.TIMESTAMP, 100) + group
    data = matroska._element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster
    (p,) = matroska.packets(data)
    assert (p.track, p.timestamp, data[p.start : p.start + p.size], p.cued) == (1, 105, b"abcd", False)
    with pytest.raises(ValueError):
        matroska.packets(matroska._element(matroska.SEGMENT, matroska.CLUSTER.to_bytes(4, "big") + b"\x90abc"))
    with pytest.raises(ValueError):
        matroska.packets(b"\x00\x01")


def test_media_of_odd_rows(odd, none):
    texts = defaultdict(set)
    for r in odd.select("doc_id", "text").collect():
        texts[r.doc_id].add((r.text or "").encode())
    rows = matroska.digests(matroska.stored(odd)).collect()
    assert len(rows) == odd.count()
    expected = set()
    for doc_id, ts in texts.items():
        for t in ts:
            payload = t + bytes(-len(t) % 64 if t else 64)
            media = matroska.write(payload)
            expected.add((doc_id, len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    assert {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows} == expected
    sizes = matroska.packet_table(matroska.stored(odd)).groupBy("doc_id").sum("size").count()
    assert sizes == len(texts)
    assert matroska.stored(none).count() == 0


def checked_packing(rows, ids, size=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    for (doc_id, n), pieces in by_doc.items():
        want = ids[doc_id]
        copies = sum(r.start == 0 for r in pieces)
        assert sorted((r.start, r.length, r.ids_crc32) for r in pieces) == sorted([(s, len(c := want[s : s + size]), zlib.crc32(np.array(c, "<u4").tobytes())) for s in range(0, len(want), size)] * copies)
    return by_sequence


def test_pieces_are_the_tokenizers_ids(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    source = odd.select("doc_id", "text").where("doc_id IS NOT NULL")
    source = source.union(spark.createDataFrame([(900, " " * 300_000 + "x"), (901, "\n \u3000" * 30_000)], source.schema))
    ids = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in source.collect()}
    out = packing.packed(packing.with_digest(packing.tokenized_pieces(source)), group_rows=4).collect()
    assert {r.doc_id for r in out} == set(ids)
    assert all(r.doc_tokens == len(ids[r.doc_id]) for r in out)
    checked_packing(out, ids)
    assert packing.packed(packing.with_digest(packing.tokenized_pieces(none))).count() == 0
    assert packing.packed(packing.with_digest(packing.tokenized_pieces(odd))).where("doc_id IS NULL").count() == 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_patterns_place_every_piece(histogram):
    found = packing.patterns(histogram, 64)
    placed = defaultdict(int)
    for p in found:
        assert 0 < sum(p.lengths) <= 64 and p.count > 0
        for x in p.lengths:
            placed[x] += p.count
    assert placed == histogram
    full = sum(k * v for k, v in histogram.items()) / 64
    assert sum(p.count for p in found) < 2 * full + 1


def test_packing_wastes_little(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = written(packing.packed(packing.with_digest(packing.tokenized_pieces(docs))), "t")
    tokens, sequences = out.selectExpr("sum(length)", "count(DISTINCT sequence_id)").first()
    assert tokens / (2048 * sequences) > 0.97
    assert set(out.columns) == {"doc_id", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset"}


def test_packing_keeps_other_columns_and_replaces_its_own(spark):
    rows = [(i, 0, 5 + i % 3, "note", 9, 9) for i in range(50)]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, start long, length long, note string, offset int, sequence_id int"), 16, 4)
    assert out.columns == ["doc_id", "start", "length", "note", "sequence_id", "offset"] and out.count() == 50
    places = [(r.sequence_id, r.offset) for r in out.collect()]
    assert len(set(places)) == 50
