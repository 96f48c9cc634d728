"""Language identification by rank-order profiles.

A profile is the RANKS most frequent n-grams of one to three letters in a language's training texts, in order. A
document's most frequent n-grams are ranked in the same way, and the out-of-place distance to a profile sums how far
each stands from its place there, or RANKS where it has none. The nearest profile gives the language.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import appended, as_bytes, pick, pieces

#: Ranks of a profile and of a document.
RANKS = 300
#: The bound of the training sample: documents of a language, about, chosen by a hash of doc_id where there are more.
SAMPLE = 1500
#: The gap between words, and the bits of a letter, a code point, in a gram.
_GAP, _BITS = 1, 21


@functools.cache
def _folded() -> np.ndarray:
    """The lower-case letter of each code point, or _GAP where it is no letter."""
    out = np.full(sys.maxunicode + 1, _GAP, np.int64)
    for c in range(sys.maxunicode + 1):
        if (one := chr(c)).isalpha():
            low = one.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: bytes | None) -> np.ndarray:
    """Lower-case letters as code points, each run of other characters as one _GAP, also at both ends; empty if none."""
    points = np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    own = np.concatenate([[_GAP], _folded()[points], [_GAP]])
    own = own[np.concatenate([[True], (own[1:] != _GAP) | (own[:-1] != _GAP)])]
    return own if len(own) > 1 else own[:0]


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of letters and their counts, in order of gram, that is of length and then of code points. A gap stands
    at a gram's ends at most. No letter is 0, so that grams of different lengths differ."""
    gap = codes == _GAP
    two = codes[:-1] << _BITS | codes[1:]
    three = (two[:-1] << _BITS | codes[2:])[~gap[1:-1]]
    every = np.concatenate([codes[~gap], two, three])
    every.sort()
    head = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
    return every[head], np.diff(np.concatenate([head, [len(every)]]))


@dataclass
class Profiles:
    """langs in order of name; for each gram in any profile its rank in each, or RANKS."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    most: int = RANKS

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]], most: int = RANKS) -> Profiles:
        """rows: lang, gram and its rank from 0."""
        langs = sorted({lang for lang, _, _ in rows})
        every = np.array(sorted({g for _, g, _ in rows}), np.int64)
        ranks = np.full((len(every), len(langs)), most, np.int32)
        for lang, g, r in rows:
            ranks[np.searchsorted(every, g), langs.index(lang)] = r
        return cls(langs, every, ranks, most)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        """The nearest profile's language, the first of equally near ones, and 1 - distance / largest distance; `und`
        and 0 for a text without a letter. Of a text's equally frequent n-grams the first in order ranks first."""
        own = letters(text)
        if not len(own) or not self.langs:
            return "und", 0.0
        gram, count = grams(own)
        gram = gram[np.argsort(-count, kind="stable")[: self.most]]
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[at] == gram
        place, ranks = np.flatnonzero(known), self.ranks[at[known]]
        off = np.where(ranks == self.most, self.most, np.abs(ranks - place[:, None])).sum(axis=0) + self.most * int((~known).sum())
        best = int(np.argmin(off))
        return self.langs[best], 1.0 - float(off[best]) / (self.most * len(gram))


def learn(docs: DataFrame, sample: int = SAMPLE, most: int = RANKS) -> Profiles:
    """Profiles of the langs of docs (doc_id, text, lang); rows with a null lang or doc_id aren't learned from.

    Of a language with more documents than sample, about sample are taken, by a hash of doc_id. What reaches the driver
    is most n-grams of each language.
    """
    rows = pick(docs, doc_id="long", text="string", lang="string").where("lang is not null and doc_id is not null")
    counts = rows.groupBy("lang").count().collect()
    million = 1_000_000
    share = [F.when(F.col("lang") == F.lit(r["lang"]), F.lit(-(-million * sample // r["count"]))) for r in counts if r["count"] > sample]
    if share:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(million)) < F.coalesce(*share, F.lit(million)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            held: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(2).to_pylist(), as_bytes(batch.column(1)), strict=True):
                held.setdefault(lang, []).append(letters(text))
            for lang, parts in held.items():
                gram, n = grams(np.concatenate(parts))
                # where two texts meet, two gaps would be a gram
                on = gram != (_GAP << _BITS | _GAP)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * int(on.sum())), pa.array(gram[on]), pa.array(n[on], pa.int64())], names=["lang", "gram", "n"])

    summed = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    top = summed.withColumn("rank", rank).where(F.col("rank") < most)
    return Profiles.of([(r["lang"], r["gram"], r["rank"]) for r in top.collect()], most)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1) appended; only the text is looked at."""

    def run(texts: list[bytes | None], _) -> list[pa.Array]:
        out = [profiles.predict(t) for t in texts]
        return [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]

    return appended(docs, text, run, {"lang_pred": "string", "score": "double"})


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of doc_id as text leaves 2, modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def evaluate(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs (doc_id, text, lang), learned from those not held out."""
    rows = pick(docs, doc_id="long", text="string", lang="string")
    profiles = learn(rows.where(~held_out()), **options)
    return identify(rows.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
