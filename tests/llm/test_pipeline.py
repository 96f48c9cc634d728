"""The corpus pipeline against a brute-force version of its stages, and every query over the small tables."""

import os
import random

import pytest
from test_jaccard import brute as brute_near
from test_texts import brute_hits, brute_lines, brute_quality, words_of
from test_tokens import check_packed

import corpus_pipeline
from vecspark.llm import decontaminate, jaccard, quality
from vecspark.llm._tokenize import load, vocabulary
from vecspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs, items):
    """doc_id to text after the four stages that filter."""
    kept = []
    for d, t in docs:
        (n, chars, symbols, repeats, inside), shares = brute_quality(t)
        lines = t.split("\n") if t else []
        again = sum(sum(map(len, words_of(x))) for i, x in enumerate(lines) if x in lines[:i])
        bad = n < 50 or 100 * inside > 50 * n or symbols > 0.1 * n or again / max(1, chars) > quality.REPEATED_LINES
        if not bad and all(s <= m for s, m in zip(shares, quality.REPEATED.values(), strict=True)):
            kept.append((d, t))
    kept = [(d, t) for d, t, _, gone, _ in brute_lines(kept) if not gone or words_of(t)]
    part = brute_near(kept)
    kept = [(d, t) for d, t in kept if part[d] == d]
    hits = brute_hits(items, [t for _, t in kept])
    return {d: t for (d, t), h in zip(kept, hits, strict=True) if not h[-1]}


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "sa", "ti") for b in ("bar", "den", "fil", "gor", "hum", "jet")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(14)) for i in range(4)]
    shared = [prose(12) for _ in range(4)]
    docs = []
    for _ in range(40):
        body = [prose(rng.randint(9, 30)) for _ in range(rng.randint(2, 5))]
        if rng.random() < 0.3:
            body.insert(1, rng.choice(shared))
        if rng.random() < 0.2:
            body.append(rng.choice(items)[1].upper())
        docs.append("\n".join(body))
    docs += [docs[3], docs[4] + " tail", docs[5].replace("bar", "BAR", 1), "short", "", None, prose(5) + " # $ %" * 60, "\n".join([shared[0]] * 20)]
    rows = list(enumerate(docs))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], FIELDS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert now.columns == [f.split()[0] for f in FIELDS.split(", ")]
    got = {r["doc_id"]: r["text"] for r in now.collect()}
    assert got == brute(rows, items) and all(r["n_chars"] == len(r["text"]) for r in now.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packed(sorted(got.items()), packed, 2048)


def test_stages_take_clashing_names_nulls_and_repeated_rows(spark, tmp_path):
    """Columns that are named like an operator's own, null and shared doc_ids, repeated rows and a very long text."""
    prose = lambda k, n=80: " ".join(f"{k}word{i}" for i in range(n))
    odd = ["_n_removed", "_n_lines", "_n_near", "DOC_ID", "node", "chunk", "_hit", "_items", "_n_words", "kept", "n_words"]
    docs = [(1, prose("a")), (1, prose("a")), (2, prose("b")), (2, prose("c")), (None, prose("d")), (None, None), (3, None), (4, ""), (5, prose("e", 40_000)), (6, prose("a"))]
    schema = FIELDS + "".join(f", `{n}` string" for n in odd)
    rows = [(d, t, "en", "s", len(t or ""), *odd) for d, t in docs]
    spark.createDataFrame([(None, prose("z")), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stored = stage(spark, now, str(tmp_path))
        assert stored.columns == now.columns, name
        now = spark.createDataFrame(stored.collect(), schema)
    left = sorted(((r["doc_id"], r["text"]) for r in (dict(zip(FIELDS_, tuple(x), strict=False)) for x in now.collect())), key=str)
    assert left == sorted([(1, prose("a")), (2, prose("b")), (2, prose("c")), (None, prose("d")), (5, prose("e", 40_000))], key=str)
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()} == {1, 2, 5, None}


FIELDS_ = [f.split()[0] for f in FIELDS.split(", ")]


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], FIELDS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_give_the_memory_of_kept_words_back(spark, monkeypatch):
    """A worker that packing has filled with words is reused by the stages of the next run."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60))), (2, None)], "doc_id long, text string")
    runs, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: (runs.append((run, self.toArrow())), real(self, run, schema))[1])
    quality.keep(docs)
    decontaminate.clean(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    jaccard.frequent(docs, 5)
    tokenizer = load(vocabulary("byte_bpe_50k.json"))
    assert len(runs) == 3
    for run, rows in runs:
        tokenizer.encode("some words that are kept")
        assert tokenizer.ids and tokenizer.after
        list(run(iter(rows.to_batches())))
        assert not tokenizer.ids and not tokenizer.after


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_has_a_row_for_each_row(spark, name):
    df = QUERIES[name](spark, SF)
    table = "pages" if name.startswith(("op6", "op10")) else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert df.count() == (2 * n if name.startswith("op6") else n) or (name.startswith("op7") and df.count() >= n)
