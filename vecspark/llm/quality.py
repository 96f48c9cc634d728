"""Quality rules by repetition coverage.

Words are hashed once for a batch of texts; rolling hashes give every window of n words in numpy. A window's hash is
joined with its document, sorted, and those met before mark their words, so that overlapping windows count a
character once. A window of n + 1 words can only repeat where windows of n words do, so longer windows look at what is
left of shorter ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import SPACE, U64, Sequences, appended, bounds, covered, mix, word_hashes

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Largest share of a document's word characters inside windows of so many words that occurred in it before.
REPEATED = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Largest share of a document's word characters inside lines that repeat an earlier one.
REPEATED_LINES = 0.20
#: Most characters of SYMBOLS for each word.
SYMBOLS_A_WORD = 0.10
#: The base rules: at least so many words, and at most this percentage of them in repeated windows of BASE_WINDOW words.
BASE_WORDS, BASE_WINDOW, BASE_PERCENT = 50, 3, 50
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """COLUMNS and the shares repeated_<n> and repeated_lines of each text."""
    n = len(texts)
    data = b"\n".join(t or b"" for t in texts)
    buf = np.frombuffer(data, np.uint8)
    sizes = np.array([len(t or b"") for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if n else np.empty(0, np.int64)
    end = begin + sizes
    starts, ends = bounds(~SPACE[buf])
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)  # of each text's words
    counts = last - first
    doc = np.repeat(np.arange(n), counts)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]  # of each word
    total = np.concatenate([[0], np.cumsum(chars)])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[buf])])
    out = {"n_words": counts, "word_chars": total[last] - total[first], "n_symbols": symbols[end] - symbols[begin]}
    share = lambda mask: (lambda c: (c[last] - c[first]) / np.maximum(out["word_chars"], 1))(np.concatenate([[0], np.cumsum(chars * mask)]))

    hashes = word_hashes(buf, starts, ends)
    windows, salt = Sequences(hashes), mix(np.arange(1, n + 1, dtype=U64))
    at, before = np.arange(len(starts)), 0
    for size in (BASE_WINDOW, *REPEATED):
        if before:  # a repeated window starts where all shorter ones in it are repeated
            is_on = np.zeros(len(starts) + size, bool)
            is_on[at] = True
            at = at[np.logical_and.reduce([is_on[at + k] for k in range(size - before + 1)])]
        at = at[at + size <= len(starts)]
        at = at[doc[at] == doc[at + size - 1]]
        key = windows.windows(size)[at] ^ salt[doc[at]]
        order = np.sort(key)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            place = np.searchsorted(twice, key)
            at = at[twice[np.minimum(place, len(twice) - 1)] == key]
        else:
            at = at[:0]
        later = at
        if size != BASE_WINDOW and len(at):  # what a text says first isn't repetition
            later = np.delete(at, np.unique(windows.windows(size)[at] ^ salt[doc[at]], return_index=True)[1])
        mask = covered(later, size, len(starts))
        if size == BASE_WINDOW:
            words = np.concatenate([[0], np.cumsum(mask)])
            out["n_repeat_words"] = words[last] - words[first]
        else:
            out[f"repeated_{size}"] = share(mask)
        before = size

    repeats, again = np.zeros(n, np.int64), np.zeros(len(starts), bool)
    for i, text in enumerate(texts):
        if text and b"\n" in text:
            seen, place = set(), int(begin[i])
            for line in text.split(b"\n"):
                if line in seen:
                    s, e = np.searchsorted(starts, (place, place + len(line)))
                    if e > s:
                        repeats[i] += 1
                        again[s:e] = True
                seen.add(line)
                place += len(line) + 1
    out["n_dup_lines"], out["repeated_lines"] = repeats, share(again)
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (m["n_words"] < BASE_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
    bad = (m["repeated_lines"] > REPEATED_LINES) | (m["n_symbols"] > SYMBOLS_A_WORD * m["n_words"])
    for size, most in REPEATED.items():
        bad |= m[f"repeated_{size}"] > most
    return failed, ~(failed | bad)


SHARES = (*(f"repeated_{n}" for n in REPEATED), "repeated_lines")


def assess(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with COLUMNS, SHARES, base_failed and kept appended, prefix before their names.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text; a null or empty text has none and fails. A column of docs that
    has the name of a new one (in any case) is replaced by it.
    """
    kinds = ["long"] * len(COLUMNS) + ["double"] * len(SHARES) + ["boolean"] * 2
    fields = dict(zip([f"{prefix}{c}" for c in (*COLUMNS, *SHARES, "base_failed", "kept")], kinds, strict=True))

    def run(texts: list[bytes | None], _) -> list[pa.Array]:
        m = measure(texts)
        failed, kept = verdicts(m)
        return [*(pa.array(m[c], pa.int64()) for c in COLUMNS), *(pa.array(m[c], pa.float64()) for c in SHARES), pa.array(failed), pa.array(kept)]

    out, old = appended(docs, text, run, fields), len(docs.columns)
    stay = [i for i, c in enumerate(docs.columns) if c.lower() not in {f.lower() for f in fields}] + [*range(old, old + len(fields))]
    names = out.columns
    return out.toDF(*[f"_{i}" for i in range(len(names))]).select(*[f"_{i}" for i in stay]).toDF(*[names[i] for i in stay])


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass all rules, with their own columns."""
    names, n = docs.columns, len(docs.columns)
    found = assess(docs.toDF(*[f"c{i}" for i in range(n)]), f"c{names.index(text)}", prefix="_rule_")
    return found.where("_rule_kept").select(*[f"c{i}" for i in range(n)]).toDF(*names)
