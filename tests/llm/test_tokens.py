"""Token codes and packing: exact round trips, and what any packing has to satisfy."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecspark.llm import packing, tokens
from vecspark.llm._tokenize import WordTokenizer, vocabulary

pytest.importorskip("public_tokenizers")
WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
PARTS = ["a", "B", " ", "  ", "\n", "\t", "'s", "é", "<|endoftext|>", "1", "\xa0", "!", "ß", "Σ", "x", "\x1c", "\r\n", ".", ",", "a.b", "_", "?.", "the", " The", "İ", "\x01", "क़.", "etwas", "3.14"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_the_tokenizers(path):
    own, rng = WordTokenizer(path), random.Random(1)
    assert own.drops or own.keeps
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert own.encode(None) == own.encode("") == b""


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_codes(ids):
    code = tokens.Dac.encode(np.array(ids, np.uint64))
    assert code.decode().tolist() == ids and [code[i] for i in range(0, len(ids), 7)] == ids[::7]
    with pytest.raises(IndexError):
        code[len(ids)]


def texts(rng, n):
    return [(i, " ".join(rng.choice(["alpha", "beta!", "gamma.", "Delta,", "ε"]) for _ in range(rng.choice([0, 1, 5, 40, 400])))) for i in range(n)]


def test_files(spark, tmp_path, monkeypatch):
    rows = texts(random.Random(2), 40) + [(100, None), (7, "again"), (None, "first"), (99, "")]
    path = str(tmp_path / "t")
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(5)
    tokens.write_tokens(docs, path, WORD, shard_ids=300)
    own, at, expected = WordTokenizer(WORD), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = own.encode(text) + (1).to_bytes(4, "little")
        expected.append((doc, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    got = [tuple(r) for r in tokens.read_documents(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected
    doc, start, n, _ = max(expected, key=lambda r: r[2])
    ids = np.frombuffer(own.encode(dict(rows)[doc]) + (1).to_bytes(4, "little"), "<u4")
    assert [tokens.read_token(spark, path, doc, i) for i in (0, n // 2, n - 1)] == [int(ids[i]) for i in (0, n // 2, n - 1)]
    with pytest.raises(KeyError):
        tokens.read_token(spark, path, 55_555, 0)
    monkeypatch.setattr(tokens, "FEW_PARTS", 0)
    monkeypatch.setattr(tokens, "_GROUP", 2)
    assert sorted((tuple(r) for r in tokens.read_documents(spark, path).collect()), key=lambda r: r[1]) == expected
    empty = str(tmp_path / "e")
    tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), empty, WORD)
    assert tokens.read_documents(spark, empty).count() == 0


def test_shards_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "t")
    tokens.write_tokens(spark.createDataFrame(texts(random.Random(3), 30), "doc_id long, text string"), path, WORD, shard_ids=300)
    plan = tokens.read_documents(spark, path)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[1]  # what feeds the decoding comes first beneath it
    assert "BroadcastHashJoin" in plan and "Exchange" not in above.split("FileScan")[0]
    assert all("levels" not in line for line in plan.split("\n") if "Exchange" in line)


def test_a_very_long_text_is_encoded_whole(spark, tmp_path):
    text, path = "alpha beta, " * 100_000 + "x" * 50_000, str(tmp_path / "t")
    tokens.write_tokens(spark.createDataFrame([(2, text), (1, "a")], "doc_id long, text string"), path, WORD)
    ids = WordTokenizer(WORD).tokenizer.encode(text, add_special_tokens=False).ids + [1]
    got = {r["doc_id"]: tuple(r)[1:] for r in tokens.read_documents(spark, path).collect()}
    assert got[2] == (got[1][1], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_bounds_hold(lengths):
    sizes = np.array(lengths, np.int64)
    bins, offsets, count = packing.best_fit_decreasing(sizes, 64)
    assert packing.lower_bound(sizes, 64) <= count
    for b in range(count):
        own = sorted(zip(offsets[bins == b].tolist(), sizes[bins == b].tolist(), strict=True))
        assert [o for o, _ in own] == [sum(s for _, s in own[:k]) for k in range(len(own))] and sum(s for _, s in own) <= 64


def test_bound_sees_what_cannot_pair():
    assert packing.lower_bound(np.full(10, 33), 64) == 10
    assert packing.lower_bound(np.array([22] * 9), 64) == 5


def best_fit(lengths, room):
    """Brute force: the fullest bin that fits, longest first."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if sum(b) + n <= room]
        if fit:
            max(fit, key=sum).append(n)
        else:
            bins.append([n])
    return len(bins)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 40), max_size=50))
def test_best_fit(lengths):
    assert packing.best_fit_decreasing(np.array(lengths, np.int64), 40)[2] == best_fit(lengths, 40)


def check_packed(rows, packed, capacity):
    own = WordTokenizer(BYTE)
    by_doc, by_sequence = {}, {}
    for p in packed:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc, text in rows:
        ids = own.encode(text) + bytes(4)
        parts, n = sorted(by_doc[doc], key=lambda p: p["piece"]), len(ids) // 4
        assert [p["piece"] for p in parts] == list(range(len(parts))) and sum(p["length"] for p in parts) == n
        assert [p["start"] for p in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))]
        assert all(p["ids_crc32"] == zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])]) for p in parts)
        assert all(p["length"] == capacity for p in parts[1:]) and (n > capacity or len(parts) == 1)
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))]
        assert sum(p["length"] for p in parts) <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("part_pieces", [50_000, 25])
def test_packing(spark, part_pieces):
    rows = texts(random.Random(4), 150) + [(200, None), (201, "")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, length int")
    packed = packing.pack_documents(docs, BYTE, capacity=64, part_pieces=part_pieces).collect()
    n = check_packed(rows, packed, 64)
    assert n <= 1.03 * packing.lower_bound(np.array([p["length"] for p in packed]), 64) + 2
    if part_pieces == 25:
        assert n <= len({p["sequence_id"] for p in packing.pack_documents(docs, BYTE, capacity=64, part_pieces=25, rounds=0).collect()})


def test_rounds_go_on_while_they_help(spark):
    """Many small partitions, each with a bin that is hardly filled: together they need about the bound."""
    rng = random.Random(9)
    rows = [(i, 0, 0, rng.randint(1, 60), 0, i) for i in range(3000)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    bins = lambda **o: packing.pack(pieces, 64, part_pieces=200, **o).select("sequence_id").distinct().count()
    least = packing.lower_bound(np.array([r[3] for r in rows]), 64)
    once, three, many = bins(rounds=0), bins(rounds=3), bins()
    assert least <= many <= three <= once and many < once and many <= 1.04 * least + 2, (least, many, three, once)


def test_materialised_sequences(spark):
    rows = texts(random.Random(5), 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack_documents(docs, BYTE, capacity=64)
    packed = spark.createDataFrame(packed.collect(), packed.schema)
    got = {r["sequence_id"]: r["ids"] for r in packing.materialise(docs, packed, BYTE).collect()}
    own = WordTokenizer(BYTE)
    for p in packed.collect():
        ids = np.frombuffer(own.encode(dict(rows)[p["doc_id"]]) + bytes(4), "<u4").tolist()
        assert got[p["sequence_id"]][p["offset"] : p["offset"] + p["length"]] == ids[p["start"] : p["start"] + p["length"]]


def test_packing_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, BYTE).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert packing.pack_documents(twice, BYTE).count() == 3
