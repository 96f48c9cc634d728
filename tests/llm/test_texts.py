"""Operators on words and lines against brute-force versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecspark.llm import decontaminate, lines, quality, simhash, substring
from vecspark.llm._text import SPACE, Sequences, bounds, even_keys, key_of, sliding_min, spark_hash, word_hashes
from vecspark.llm.components import components

DOCS = "doc_id long, text string"
words_of = re.compile(r"[^\x20\x09-\x0D]+").findall


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def test_hash_helpers():
    x = np.random.default_rng(1).integers(0, 2**63, 40).astype(np.uint64)
    for size in (1, 2, 3, 7, 16, 40):
        assert sliding_min(x, size).tolist() == [min(x[i : i + size]) for i in range(len(x) - size + 1)]
    a = Sequences(np.concatenate([x[:10], x[:10]]))
    w = a.windows(4)
    assert (w[:7] == w[10:]).all() and len(set(w.tolist())) == 10 and len(a.windows(21)) == 0
    assert (a.runs(np.arange(17), np.arange(17) + 4) == w).all()


def test_keys_are_dealt_evenly(spark):
    x = np.array([0, 1, -1, 42, 2**40 + 7, -(2**62)])
    assert spark_hash(x).tolist() == [r[0] for r in spark.createDataFrame([(int(i),) for i in x], "x long").selectExpr("hash(x)").collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for n in (1, parts, 3 * parts - 1):
        keys = even_keys(spark, n)
        assert len(set(keys.tolist())) == len(keys) == (n if n <= parts else 3 * parts)
        got = spark.range(len(keys)).select(key_of(F.col("id"), keys).alias("k"))
        assert [r["k"] for r in got.collect()] == keys.tolist()
        assert Counter(r[0] for r in got.selectExpr(f"pmod(hash(k), {parts})").collect()).most_common(1)[0][1] == -(-n // parts)


# substring dedup


def brute_substring(rows, size):
    docs = [(d, words_of(t or "")) for d, t in rows]
    least = {}
    for d, w in docs:
        for i in range(len(w) - size + 1) if d is not None else ():
            key = tuple(w[i : i + size])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, w in docs:
        gone = {k for i in range(len(w) - size + 1) if d is not None and least[tuple(w[i : i + size])] < d for k in range(i, i + size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,run,chunk_bytes,share,group", [(5, 2, 200, 32, 4096), (7, 7, 1 << 20, 1, 4096), (6, 1, 2000, 32, 3), (6, 3, 300, 1, 5), (5, 2, 200, 32, 1)])
def test_substring_dedup(spark, monkeypatch, size, run, chunk_bytes, share, group):
    monkeypatch.setattr(substring, "SHARE", share)
    monkeypatch.setattr(substring, "LEAST", 2)
    rng = random.Random(size)
    base = ["".join(rng.choice("abü") for _ in range(rng.randint(1, 2))) for _ in range(40)]
    rows = [(None, "a b a b a b a b"), (3, None), (4, ""), (5, "a"), (6, " \n\t "), (7, "x" * 3000)]
    for _ in range(50):
        w = []
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, 30)
            w += base[at : at + rng.randint(3, 12)] if rng.random() < 0.6 else [rng.choice("abcxyz") for _ in range(rng.randint(1, 8))]
        rows.append((rng.randint(10, 60), rng.choice([" ", "\n", "  "]).join(w)))
    rows += rows[-5:] + [(100 + d, t) for d, t in rows[20:40]]
    got = substring.dedup(frame(spark, rows), window=size, run=run, chunk_bytes=chunk_bytes, bucket_bytes=300, group=group).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_substring(rows, size)


def test_a_common_passage_fills_no_bucket():
    """Of strings with a passage in all documents, few different ones go to a bucket."""
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([f"{k}a{i}" for i in range(60)] + passage + [f"{k}b{i}" for i in range(60)]) for k in range(300)]
    table = pa.table({"doc_id": list(range(300)), "text": texts, "chunk": [0] * 300})
    runs = np.unique(Sequences(word_hashes(*_spans(" ".join(passage)))).windows(8))
    most = [max(sum(len(t) for t, _ in own) for own in substring._Chunk(table, 50, 8, np.arange(500), substring.Common(known)).sent.values()) for known in (runs, runs[:0])]
    assert most[0] < 30_000 and most[1] > 100_000 and rng


def test_a_passage_in_every_chunk_meets_in_two_steps(spark):
    """A group sends a string that its chunks share once, and no task gets more messages than a group has chunks."""
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(d, f"{d}a {d}b {passage} {d}c {d}d") for d in range(64)]
    hashes = lambda t: substring._Chunk(t, 6, 2, np.arange(4), substring.Common(np.empty(0, np.uint64)), 8)
    chunks = [hashes(pa.table({"doc_id": [d], "text": [t], "chunk": [d]})) for d, t in rows]
    bucket = max(range(4), key=lambda b: sum(b in c.sent for c in chunks))
    on = [k for k, c in enumerate(chunks) if bucket in c.sent]
    columns = {"bucket": [bucket] * len(on), "group": [0] * len(on), "chunk": on, "data": [chunks[k].message(bucket) for k in on], "parts": [substring._squeeze(np.array(chunks[k].part[bucket], "<i4").tobytes()) for k in on]}
    met = substring._Group(pa.table(columns)).messages()
    strings = [x for m in met["data"].to_pylist() for x in substring._read(m)[1].split(b"\n")]
    assert len(on) == 64 and len(strings) == len(set(strings)) and len(strings) < sum(len(chunks[k].sent[bucket]) for k in on)
    got = substring.dedup(frame(spark, rows), window=6, run=2, chunk_bytes=40, bucket_bytes=300, group=8)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_substring(rows, 6)


def _spans(text):
    buf = np.frombuffer(text.encode(), np.uint8)
    return buf, *bounds(~SPACE[buf])


def test_substring_edges(spark):
    assert substring.dedup(frame(spark, [])).collect() == []
    wide = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, chunk int, bucket int")
    assert substring.dedup(wide).first()["n_words"] == 2
    with pytest.raises(ValueError):
        substring.dedup(wide, window=3, run=4)


def test_equal_hashes_are_told_apart(monkeypatch):
    """With a hash that is always equal, the words alone decide."""
    monkeypatch.setattr(substring.Sequences, "windows", lambda self, size: np.zeros(max(0, self.n - size + 1), np.uint64))
    message = lambda docs, texts: substring._squeeze(len(docs).to_bytes(8, "little") + np.array(docs, "<i8").tobytes() + b"\n".join(texts))
    a, b = substring.count_windows([message([4, 2], [b"a b c d", b"x y z"]), message([1], [b"b c d e"])], 3)
    assert {tuple(r) for r in a.tolist()} == {(0, 0, 4), (0, 1, 1), (1, 0, 2)} and {tuple(r) for r in b.tolist()} == {(0, 0, 1), (0, 1, 1)}


# line dedup


def brute_near(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= 1


def brute_lines(rows, near=True):
    every = [(d, i, words_of(x)) for d, t in rows if d is not None and t for i, x in enumerate(t.split("\n"))]
    out = []
    for d, t in rows:
        keep, gone, close = [], 0, 0
        for i, x in enumerate(t.split("\n") if t is not None else ()):
            w, same, like = words_of(x), False, False
            for e, j, v in every if d is not None and len(w) >= 5 else ():
                if (e, j) < (d, i):
                    same |= v == w
                    like |= near and min(len(w), len(v)) >= 8 and abs(len(w) - len(v)) < 2 and brute_near(v, w)
            gone, close = gone + (same or like), close + (like and not same)
            keep += [] if same or like else [x]
        out.append((d, None if t is None else "\n".join(keep), 0 if t is None else t.count("\n") + 1, gone, close))
    return sorted(out, key=str)


def edited(rng, line):
    line = list(line)
    for _ in range(rng.choice([0, 0, 1, 1, 1, 2])):
        k, how = rng.randrange(len(line)), rng.random()
        if how < 0.34:
            line[k] = rng.choice("abcdefgh")
        elif how < 0.67:
            line.insert(k, rng.choice("abcdefgh"))
        elif len(line) > 1:
            del line[k]
    return line


@pytest.mark.parametrize("seed,near,chunk_bytes,group", [(4, True, 300, 4096), (5, True, 1 << 20, 4096), (6, False, 300, 3), (7, True, 2000, 4096), (8, True, 300, 4), (9, True, 300, 1)])
def test_line_dedup(spark, seed, near, chunk_bytes, group):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") for _ in range(rng.choice([4, 5, 7, 8, 9, 9, 10, 13]))] for _ in range(20)]
    rows = [(None, "a b c d e f g h i j"), (3, None), (4, ""), (5, "\n\n"), (6, "w " * 2000)]
    rows += [(i + 10, "\n".join(rng.choice([" ", "  "]).join(edited(rng, rng.choice(base))) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    got = lines.dedup_lines(frame(spark, rows), near=near, chunk_bytes=chunk_bytes, bucket_bytes=300, group=group).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_lines(rows, near)


def test_line_dedup_edges(spark):
    assert lines.dedup_lines(frame(spark, [])).collect() == []
    wide = spark.createDataFrame([("k", 2, "a b c d e f g h\nz", 7), ("j", 1, "a b c d e f g h", 8), ("j", 1, "a b c d e f g h", 8)], "kind string, doc_id int, text string, chunk int")
    got = sorted(map(tuple, lines.dedup_lines(wide).collect()))
    assert got == [("j", 1, "a b c d e f g h", 8, 1, 0, 0)] * 2 + [("k", 2, "z", 7, 2, 1, 0)]
    line = "one two three four five six seven eight nine"
    rows = [(1, line), (None, line + "\n"), (None, None), *((k, line.replace("five", f"x{k}") + f"\n{k}") for k in range(2, 60))]
    odd = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, _n_removed int, asked_by string")
    for group in (4096, 3):
        got = {tuple(r)[:2]: tuple(r)[4:] for r in lines.dedup_lines(odd, chunk_bytes=300, bucket_bytes=300, group=group).collect()}
        assert got.pop((None, line + "\n")) == (2, 0, 0) and got.pop((None, None)) == (0, 0, 0) and got.pop((1, line)) == (1, 0, 0)
        assert got == {(k, str(k)): (2, 1, 1) for k in range(2, 60)}
    long_text = "\n".join(f"{line} {i}" for i in range(60_000))
    r = lines.dedup_lines(frame(spark, [(2, long_text), (1, f"{line} 59999")])).where("doc_id = 2").first()
    assert (r["_n_lines"], r["_n_removed"], r["_n_near"]) == (60_000, 60_000, 59_999)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6))
def test_one_edit(a, b):
    assert lines.within_one_edit(a, b) == brute_near(a, b)


# quality rules


def brute_quality(t):
    w, seen, repeats = words_of(t or ""), set(), 0
    for x in (t or "").split("\n"):
        repeats += x in seen and bool(words_of(x))
        seen.add(x)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    shares = []
    for n in quality.REPEATED:
        met, over = set(), set()
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            over |= set(range(i, i + n)) if key in met else set()
            met.add(key)
        shares.append(sum(len(w[i]) for i in over) / max(1, sum(map(len, w))))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), repeats, len(inside)), shares


TEXT = st.lists(st.sampled_from(["a", "bé", "cc", "#", "\n", "  ", " ", "\n\n", "𝔘", "a b c", " ", "\x1f"]), max_size=60).map("".join)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.none() | TEXT, max_size=6))
def test_quality_measures(texts):
    m = quality.measure([None if t is None else t.encode() for t in texts])
    for i, t in enumerate(texts):
        base, shares = brute_quality(t)
        assert tuple(int(m[c][i]) for c in quality.COLUMNS) == base
        assert [m[f"repeated_{n}"][i] for n in quality.REPEATED] == pytest.approx(shares)


def test_quality_rules(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(1, good), (2, "short"), (3, None), (4, ""), (5, "a b c " * 40), (6, good + "\n" + good), (7, good + " # " * 30), (1, good)]
    got = {(r["doc_id"], r["text"]): r for r in quality.assess(frame(spark, rows)).collect()}
    assert {k[0] for k, r in got.items() if r["kept"]} == {1} and {k[0] for k, r in got.items() if r["base_failed"]} == {2, 3, 4, 5, 6}
    clash = spark.createDataFrame([(good, 1, "x", "y")], "text string, doc_id int, `Kept` string, `a.b` string")
    row = quality.assess(clash).first()
    assert row["kept"] is True and row["a.b"] == "y"
    assert quality.keep(clash).columns == clash.columns and quality.keep(clash).count() == 1
    assert quality.assess(frame(spark, [])).count() == 0


# decontamination


def brute_hits(items, docs):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    patterns = {}
    for i, t in items:
        w = find(low(t))
        m = min(10, len(w))
        for k in range(len(w) - m + 1) if m else ():
            patterns.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = []
    for t in docs:
        w, hit, met = find(low(t)), set(), set()
        for m in {len(p) for p in patterns}:
            for k in range(len(w) - m + 1):
                if own := patterns.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    met |= own
        out.append((len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_decontamination(spark, seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice(["a", "B", "ü"]) + rng.choice([" ", "-", "\n", ", "]) for _ in range(n))
    items = [(i, rng.choice([None, "", "!!"]) if rng.random() < 0.15 else make(rng.choice([1, 2, 3, 9, 10, 12, 14] if seed % 2 else [9, 10, 12]))) for i in range(rng.randint(0, 8))]
    docs = [None, "", "?"] + [make(rng.randint(0, 700)) for _ in range(6)]
    found = decontaminate.find(decontaminate.compile_patterns([(i, None if t is None else t.encode()) for i, t in items]), [None if t is None else t.encode() for t in docs])
    assert [(int(c), int(h.sum()), len(m)) for c, h, m in zip(*found, strict=True)] == [b[:3] for b in brute_hits(items, docs)]
    if seed < 2:
        for options in ({}, {"block_bytes": 100}):
            got = decontaminate.report(frame(spark, list(enumerate(docs))), frame(spark, items, "item_id long, text string"), **options).orderBy("doc_id").collect()
            assert [tuple(r)[1:] for r in got] == brute_hits(items, docs)


def test_decontamination_edges(spark):
    bench = frame(spark, [(1, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x One, TWO three!", 3), (2, "one two", 4), (None, None, 5)], "doc_id long, text string, n_hit int")
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [2, None]
    assert decontaminate.clean(docs, frame(spark, [], "item_id long, text string")).count() == 3
    unnamed = frame(spark, [(None, "one two three"), (7, "two three")], "item_id long, text string")
    assert [(r["n_hit"], r["n_items"]) for r in decontaminate.report(docs, unnamed).collect()] == [(3, 1), (0, 0), (0, 0)]
    long_text = "five six " * 200_000 + "one two three " + "four " * 100_000
    assert [(r["n_words"], r["n_hit"]) for r in decontaminate.report(frame(spark, [(1, long_text)]), bench).collect()] == [(500_003, 3)]
    assert decontaminate.report(frame(spark, []), bench).count() == 0


def test_large_benchmark_has_compact_tables():
    """Of arrays alone, and of a size that follows that of the texts."""
    import pickle

    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(200)).encode()) for i in range(2000)]
    size = sum(len(t) for _, t in items)
    patterns = decontaminate.compile_patterns(items + items[:10])
    assert len(pickle.dumps(patterns)) < 16 * size
    _, hits, met = decontaminate.find(patterns, [items[5][1], items[7][1][50:400], b"w1 w2"])
    assert met == [{5}, {7}, set()] and hits[0].all() and hits[1][1:-1].all() and not hits[2].any()


def test_equal_hashes_of_patterns_are_told_apart(monkeypatch):
    real = decontaminate.word_hashes
    monkeypatch.setattr(decontaminate, "word_hashes", lambda *a: real(*a) & np.uint64(1))
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice([2, 11, 14])))) for i in range(30)]
    docs = [" ".join(rng.choice("abcd") for _ in range(300)) + " " + items[3][1] for _ in range(5)]
    found = decontaminate.find(decontaminate.compile_patterns([(i, t.encode()) for i, t in items]), [t.encode() for t in docs])
    assert [(int(c), int(h.sum()), len(m)) for c, h, m in zip(*found, strict=True)] == [b[:3] for b in brute_hits(items, docs)]


# near-duplicates


def brute_fingerprint(t):
    import xxhash

    w = [x for x in words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


@settings(deadline=None, max_examples=60)
@given(TEXT)
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def brute_components(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def clusters(rng, n):
    """Fingerprints in chains and clouds of near ones, and single ones."""
    out = {0}
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            out.add(x)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
    return sorted(out)


@pytest.mark.parametrize("long_list", [512, 3])
def test_links_reach_what_all_pairs_reach(spark, monkeypatch, long_list):
    monkeypatch.setattr(simhash, "LIST", long_list)
    fps = clusters(random.Random(long_list), 400)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    groups = frame(spark, list(enumerate(signed)), "node long, fp long")
    got = [(r["a"], r["b"]) for r in simhash.links(groups).collect()]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert brute_components(got, range(len(fps))) == brute_components(near, range(len(fps)))
    found = {r["node"]: r["component"] for r in components(simhash.links(groups)).collect()}
    assert found == {n: c for n, c in brute_components(near, range(len(fps))).items() if n != c}


def test_long_lists_are_probed():
    rng = random.Random(9)
    fps = np.array(sorted({0x1234567890 << 24 | rng.getrandbits(12) << 6 for _ in range(3000)}), np.uint64)
    least = simhash.linked(np.zeros(len(fps), np.int64), fps)
    near = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    assert least.tolist() == list(brute_components(near, range(len(fps))).values())


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 30)) for _ in range(200)) for _ in range(6)]
    rows = [(i, b) for i, b in enumerate(base)] + [(10 + i, b.upper()) for i, b in enumerate(base)] + [(20 + i, b + " tail") for i, b in enumerate(base)]
    rows += [(40, None), (41, ""), (42, " "), (50, "a"), (51, "a"), (50, "a"), (None, "a"), (None, "quite another text")]
    got = {}
    for r in simhash.near_duplicates(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add((r["fp"] % (1 << 64), r["component_id"]))
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(brute_fingerprint(t))
    assert {d: {f for f, _ in x} for d, x in got.items()} == texts
    nodes = sorted({f for x in texts.values() for f in x})
    near = [(a, b) for a in nodes for b in nodes if b < a and (a ^ b).bit_count() <= 3]
    part = brute_components(near, nodes)
    least = {}
    for d, t in rows:
        p = part[brute_fingerprint(t)]
        least[p] = min([x for x in (d, least.get(p)) if x is not None], default=None)
    assert all(c == least[part[f]] for x in got.values() for f, c in x)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_of_a_hot_fingerprint(spark, monkeypatch):
    rows = [(i, "the same text") for i in range(40)] + [(i, f"text number {i} of them") for i in range(40, 60)] + [(60, None)]
    want = sorted(map(tuple, simhash.near_duplicates(frame(spark, rows)).collect()))
    monkeypatch.setattr(simhash, "HOT_ROWS", 10)
    wide = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, fp int, component_id int, DOC_ID string")
    assert sorted(map(tuple, simhash.near_duplicates(wide).collect())) == want and len(want) == 61
    long_text = "alpha beta gamma delta " * 50_000
    got = simhash.near_duplicates(frame(spark, [(1, long_text), (2, long_text + "epsilon")])).collect()
    assert {r["fp"] % (1 << 64) for r in got} <= {brute_fingerprint(long_text), brute_fingerprint(long_text + "epsilon")}
