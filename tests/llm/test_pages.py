"""Language ID, WARC derivatives and URL filters."""

import base64
import hashlib
import html
import random
import re
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecspark.llm import langid, urls, warc

# language ID

WORDS = {"xx": "lorem dolor amet sit elit magna aliqua".split(), "yy": "koto hana yama kawa sora umi".split(), "zz": "größe über straße schön weiß".split()}


def sentences(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, sentences(rng, lang, 30), lang) for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(200))]
    rows += [(500, None, "xx"), (501, "", "yy"), (502, "12 !?", "zz"), (503, sentences(rng, "zz", 20), None), (None, "koto hana", "yy"), (0, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = langid.evaluate(docs, sample=50).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for d, _, lang in rows[:200]:
        assert by[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= by[d]["score"] <= 1
        assert by[d]["lang_pred"] == lang
    assert [by[d]["lang_pred"] for d in (500, 501, 502, 503, None)] == ["und", "und", "und", "zz", "yy"] and by[500]["score"] == 0
    assert {r["lang_pred"] for r in langid.evaluate(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.evaluate(docs.limit(0)).count() == 0


def brute_rank(text):
    """Most frequent n-grams of one to three letters of padded words."""
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    count = {}
    for w in words:
        padded = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g != " ":
                    count[g] = count.get(g, 0) + 1
    return count


def test_grams_are_those_of_padded_words():
    for text in ("Ab, ab é!", "a", "a b", "x1y"):
        gram, count = langid.grams(langid.letters(text.encode()))
        spell = lambda g: "".join(" " if p == 1 else chr(p) for k in (2, 1, 0) if (p := g >> (21 * k) & (1 << 21) - 1))
        assert {spell(int(g)): int(c) for g, c in zip(gram, count, strict=True)} == brute_rank(text)


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | (1 if c == " " else ord(c))
    return out


def brute_order(count, most):
    return sorted(count, key=lambda g: (-count[g], code(g)))[:most]


def brute_language(text, profiles, most):
    count = brute_rank(text or "")
    own = brute_order(count, most)
    if not own or not profiles:
        return "und", 0.0
    far = {lang: sum(abs(p.index(g) - i) if g in p else most for i, g in enumerate(own)) for lang, p in profiles.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (most * len(own))


def test_prediction_equals_brute_force(spark):
    """Many letters, Han, Kana and Hangul among them, equally near languages, and long, short and empty texts."""
    rng = random.Random(4)
    alphabets = {"han1": range(0x4E00, 0x5200), "han2": range(0x6000, 0x6400), "hangul": range(0xAC00, 0xB000), "kana": range(0x3041, 0x3090), "latin": range(0x61, 0x7B), "same": range(0x61, 0x7B)}
    make = lambda lang, n: " ".join("".join(chr(rng.choice(alphabets[lang])) for _ in range(rng.randint(1, 6))) for _ in range(n))
    rows = [(i, make(lang, rng.choice([1, 3, 20, 200])), lang) for i, lang in enumerate(list(alphabets) * 12)]
    rows = [(d, rows[d - 1][1] if lang == "same" else t, lang) for d, t, lang in rows]  # the same texts as the one before
    rows += [(500, None, "kana"), (501, " 1 ", "latin"), (502, "Ａｂ é ß", None), (503, "a b " * 50_000, None)]
    docs = frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {lang: {} for lang in alphabets}
    for d, t, lang in rows:
        if lang and t and zlib.crc32(str(d).encode()) % 4 != 2:
            for g, n in brute_rank(t).items():
                learned[lang][g] = learned[lang].get(g, 0) + n
    for most in (300, 2000):
        profiles = {lang: brute_order(c, most) for lang, c in learned.items() if c}
        own = langid.learn(frame.where(~langid.held_out()), most=most)
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, own).collect()}
        assert len({g for lang in ("han1", "han2", "hangul") for g in profiles[lang] if len(g) == 1}) > (500 if most == 300 else 1500)
        for d, t, _ in rows:
            lang, score = brute_language(t, profiles, most)
            assert got[d][0] == lang and abs(got[d][1] - score) < 1e-12, d
    assert got[500] == got[501] == ("und", 0.0)


# WARC

PAGE = "<html lang=fr><head><title>A &amp; b</title><style>p{x}</style></head><body><p>Un <b>deux</b>\n trois<br>quatre &lt;5&gt;<!-- no --><script>var a='<p>'</script><a href=x>lien</a></p></body></html>"


def test_plain_text():
    assert warc.plain_text(PAGE) == "Un deux trois\nquatre <5> lien"
    assert warc.plain_text(None) == warc.plain_text("<p></p>") == "" and warc.plain_text("a < b") == "a < b"


def slow_text(page):
    """The same, one character after another."""
    s, out, i = " ".join((page or "").split()), [], 0

    def end_of_tag(i):
        while i < len(s) and s[i] != ">":
            if s[i] == "=":
                i += 1
                while i < len(s) and s[i] == " ":
                    i += 1
                if i < len(s) and s[i] in "\"'":
                    quote = s[i]
                    i += 1
                    while i < len(s) and s[i] != quote:
                        i += 1
                    i += 1
            else:
                i += 1
        return i + 1

    def named(i):
        m = re.match("[a-zA-Z][a-zA-Z0-9]*(?=[ />])", s[i:])
        return m[0].lower() if m else None

    while i < len(s):
        if s.startswith("<!--", i):
            at = s.find("-->", i + 4)
            out.append(" ")
            i = len(s) if at < 0 else at + 3
        elif s[i : i + 2] in ("<!", "<?"):
            at = s.find(">", i)
            i = len(s) if at < 0 else at + 1
        elif re.match("</?[a-zA-Z]", s[i : i + 3]):
            close = s[i + 1] == "/"
            name = named(i + 1 + close)
            to = end_of_tag(i + 1)
            if name == "svg" and not close and s[to - 2 : to] == "/>":
                i = to
            elif name in ("script", "style", "svg", "title") and not close:
                while to < len(s) and not (s.startswith("</", to) and named(to + 2) == name):
                    to += 1
                out.append("\n" if name == "title" else " ")
                i = end_of_tag(to) if to < len(s) else to
            else:
                out.append("\n" if name in ("p", "br", "html", "title", "h1") else "")
                i = to
        else:
            out.append(s[i])
            i += 1
    lines = (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x)


MARKS = ["<p>", "</p>", "<p title=\"a>b\">", "<b x='", "<a href=y>", "</a", "<", ">", "=", "'", '"', " ", "\n", "x", "é", "&lt;", "&#65;", "<!--", "-->", "-", "<!d>", "<?x", "<script>", "</script>", "</SCRIPT x>", "<scripty>", "<svg/>", "<svg a=b>", "</svg>", "<title>", "</title >", "<BR/>", "<h1", "/", "</", "<html lang=en>", "<style>", "</style>"]


@settings(deadline=None, max_examples=600)
@given(st.lists(st.sampled_from(MARKS), max_size=25))
def test_text_is_that_of_a_slow_scanner(parts):
    assert warc.plain_text("".join(parts)) == slow_text("".join(parts))


@pytest.mark.parametrize("part", ["<a ", "<p title=\"", "<!--", "<script>", "</script", "<title>", "<!", "= ", "<svg a=", "&#9", "<a href='x", "&", "<p>x"])
def test_long_pages_take_little_time(part):
    page = part * (5_000_000 // len(part))
    began = time.process_time()
    warc.scan(page)
    assert time.process_time() - began < (6 if part == "<p>x" else 1.5)


def test_facts_of_a_page():
    page = "<!-- <title>no</title> --><html data-lang=xx lang='pt-BR'><title>Um &amp; <b>dois</title><title>2</title><a data-href=1>k</a><a title='>' href = x>l</a><p title='<script>'>m</p>&#99999999999999999999;"
    assert warc.scan(page) == ("kl\nm\n\ufffd", "Um & <b>dois", "pt-BR", 1)


def test_derivatives(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", PAGE, "z"), (2, None, None, "z"), (None, "u\r\nv", "", "z"), (1, "http://a.example/x", PAGE, "z")], "page_id long, url string, html string, block string")
    source = warc.responses(pages).persist()
    got = warc.derive(source).collect()
    assert len(got) == 8
    ids = {r["record_id"] for r in source.collect()}
    for r in got:
        h = {x["name"]: x["value"] for x in r["headers"]}
        block = r["block"].encode()
        assert r["refers_to"] == h["WARC-Refers-To"] and r["refers_to"] in ids and h["WARC-Record-ID"] == r["record_id"]
        assert h["Content-Length"] == str(len(block)) and h["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert "\n" not in h["WARC-Target-URI"] and h["WARC-Date"] == warc.DATE
    by = {(r["source_id"], r["type"]): r for r in got}
    meta, conv = by[1, "metadata"], by[1, "conversion"]
    assert conv["block"] == warc.plain_text(PAGE) and {x["name"]: x["value"] for x in meta["headers"]}["WARC-Concurrent-To"] == conv["record_id"]
    fields = dict(line.split(": ", 1) for line in meta["block"].split("\r\n") if line)
    origin = {x["name"]: x["value"] for x in source.where("source_id = 1").first()["headers"]}
    assert fields["title"] == html.unescape("A &amp; b") and fields["language"] == "fr" and fields["outlinks"] == "1"
    assert all(fields[f"source-{k}"] == v for k, v in origin.items())
    assert warc.derive(warc.derive(source)).count() == 0 and warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_files(spark, tmp_path):
    rng = random.Random(2)
    body = lambda: "".join(rng.choice(["<p>", "é", "\r\n", "\r\n\r\n", "a", "\n", "WARC/1.1"]) for _ in range(rng.randint(0, 30)))
    pages = spark.createDataFrame([(i, f"http://h/{i}", body()) for i in range(40)], "page_id long, url string, html string")
    records = warc.derive(warc.responses(pages), keep=True).persist()
    warc.write_warc(records, str(tmp_path / "w"))
    names = ["source_id", "type", "record_id", "refers_to", "headers", "block"]
    assert sorted(map(str, warc.read_warc(spark, str(tmp_path / "w")).collect())) == sorted(map(str, records.select(names).collect()))
    twice = warc.responses(spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (1, "u", None), (None, None, "x"), (None, None, "x")], "page_id long, url string, html string"))
    warc.write_warc(twice, str(tmp_path / "t"))
    back = warc.read_warc(spark, str(tmp_path / "t")).collect()
    assert len(back) == len({r["record_id"] for r in back}) == 3
    assert warc.distinct_pages(spark.createDataFrame([(1, "u", "x", 2), (1, "u", "x", 3), (None, None, None, 4), (None, None, None, 4)], "page_id long, url string, html string, _by int")).count() == 2
    odd = warc.responses(spark.createDataFrame([(1, "u", "x\r\n\r\nWARC/1.1\r\nWARC-Type: y")], "page_id long, url string, html string"))
    with pytest.raises(Exception, match="beginning of a record"):
        warc.write_warc(odd, str(tmp_path / "odd"))


# URLs

RULES = [urls.Rule(False, "com", "/en/"), urls.Rule(True, "example.com", "/en/7"), urls.Rule(True, "net", "/de/"), urls.Rule(False, "example.net", "/de/8"), urls.Rule(False, "org", "/es/")]


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def brute_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_rules(spark):
    rng = random.Random(3)
    parts = ["http://", "HTTPS://", "", "x://y://"], ["Example.COM", "www.example.com", "notexample.com", "example.net", "a.net", "net", "org", "É.org", ""], ["/en/7", "/en/71?x", "/en/", "/de/8", "/de/9#a?b", "/es/", "?q=/en/", "", "/es\n/"]
    rows = [(i, "".join(rng.choice(p) for p in parts), "c") for i in range(300)] + [(900, None, "c"), (901, "", "c"), (902, "http://a.org/es/x", "c"), (902, "http://a.org/es/x", "c"), (None, "https://" + "a" * 5000 + ".com/en/", "c")]
    model = urls.train(urls.labelled(spark))
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), RULES, model).collect()
    assert len(got) == len(rows)
    texts = {p: u for p, u, _ in rows}
    for r in got:
        host, path = brute_url(texts[r["page_id"]])
        rule = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.text)
        assert r["verdict"] == (("allow" if rule.allow else "block") if rule else "block" if r["probability"] >= 0.5 else "allow")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), RULES, model).count() == 0


def test_trees_learn(spark):
    rows = [(u, 0.0) for u in urls.CLEAN[::2]] + [(u, 1.0) for u in urls.DROP[::2]]
    model = urls.train(spark.createDataFrame(rows, "url string, label double"))
    held = spark.createDataFrame([(k, u) for k, u in enumerate(urls.CLEAN[1::2] + urls.DROP[1::2])], "page_id long, url string")
    right = sum((r["verdict"] == "block") == (r["page_id"] >= len(urls.CLEAN[1::2])) for r in urls.judge(held, [], model).collect())
    assert right >= 0.8 * held.count()
    plan = urls.judge(held, RULES, model)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.fixture(scope="module")
def trees(spark):
    return urls.train(urls.labelled(spark))


def test_expressions_score_as_the_model_does(spark, trees):
    """On features that no URL has to have, thresholds themselves among them."""
    from pyspark.ml.feature import VectorAssembler

    rng, seen = random.Random(3), {}

    def walk(node):
        if isinstance(node, tuple):
            seen.setdefault(node[0], set()).add(node[1])
            walk(node[2]), walk(node[3])

    for tree in trees.trees:
        walk(tree)
    pick = lambda k: rng.choice([*seen.get(k, {0.0}), rng.uniform(-5, 60)]) + rng.choice([0.0, 0.0, 1e-9, -1e-9])
    rows = [tuple(float(pick(k)) for k in range(len(trees.names))) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in trees.names))
    data = VectorAssembler(inputCols=trees.names, outputCol="features").transform(df)
    got = [(r["own"], r["probability"][1]) for r in trees.model.transform(data.withColumn("own", trees.probability())).collect()]
    assert len(seen) > 3 and len({round(a, 6) for a, _ in got}) > 20
    assert all(abs(a - b) < 1e-12 for a, b in got)


def test_features_against_plain_python(spark):
    import math

    samples = [u for u in urls.CLEAN + urls.DROP] + ["http://UPPER.Example.COM:80/a//b/?x=1&&y#z", "x://", "://h", "http://" + "a" * 5000 + ".com/" + "/".join("1" * 3000)]
    df, names = urls.features(spark.createDataFrame([(u,) for u in samples], "url string").select("url", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path")))
    for r in df.collect():
        u, h, p = r["url"], r["host"], r["path"]
        known = [c for c in h if c in "abcdefghijklmnopqrstuvwxyz0123456789-."]
        plain = [c for c in h if not ("!" <= c <= "~") or c in known]
        entropy = math.log2(max(1, len(plain))) - sum(n * math.log2(n) for c in set(known) if (n := known.count(c))) / max(1, len(plain))
        want = {
            "f_length": len(u), "f_host_length": len(h), "f_depth": p.count("/"), "f_labels": h.count(".") + 1, "f_hyphens": h.count("-"), "f_digit_ratio": sum(c.isdigit() for c in u) / max(1, len(u)),
            "f_host_digits": sum(c.isdigit() for c in h) / max(1, len(h)), "f_entropy": entropy, "f_params": u.count("?") + u.count("&"), "f_suffix_length": len(h.rsplit(".", 1)[-1]),
        }
        assert sorted(want) == sorted(names) and all(abs(r[n] - v) < 1e-9 for n, v in want.items()), u


def test_trees_on_urls_they_have_not_seen(spark):
    """Each fifth of the labelled URLs is judged by trees that learned from the others, a table that the caller passes."""
    labelled, right = urls.labelled(spark).collect(), 0
    for fold in range(5):
        own = spark.createDataFrame([r for i, r in enumerate(labelled) if i % 5 != fold], "url string, label double")
        rest = [(i, r["url"]) for i, r in enumerate(labelled) if i % 5 == fold]
        said = urls.judge(spark.createDataFrame(rest, "page_id long, url string"), [], urls.train(own)).collect()
        right += sum((r["verdict"] == "block") == (labelled[r["page_id"]]["label"] == 1) for r in said)
    assert right >= 0.8 * len(labelled)
