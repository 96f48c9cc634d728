"""Token ids of whole texts by the tokenizers library, which encodes each different word once for each worker."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import struct

import numpy as np

#: Words whose ids a worker keeps; it encodes later ones each time.
KEPT_WORDS = 350_000
#: A text with these is encoded as a whole: characters that Python and the library may not both count as white space.
_ODD = re.compile("[\\x00-\\x08\\x0e-\\x1f\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff]")
_AHEAD = re.compile(r"(?= \S)")
_RUNS = ("  ", " \n", " \t", " \r", " \x0b", " \x0c")
#: Points that don't stand after one of these letters and digits; after them a point begins a pre-token, and is parted.
_POINT = re.compile("[.,](?<![0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f][.,])")
#: What Python and the library may lower-case in different ways; other texts are lower-cased for an uncased tokenizer.
_CASED = re.compile("[\u0130\u0131\u017f\u0180-\U0010ffff]")
#: Stands for "no blank before this"; a text that has it is encoded as a whole.
_JOINED = "\x01"
#: Beyond this many characters between blanks, a word is encoded without being kept.
_LONG = 64


def _byte_level() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones of Latin-1 for themselves, the
    others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}


_BYTES = _byte_level()


def byte_level(text: str) -> str:
    """text, in which a blank stands at the beginning at most and all else is letters, in those characters."""
    if text.isascii():
        return _BYTES[0x20] + text[1:] if text[0] == " " else text
    return text.encode().decode("latin-1").translate(_BYTES)


#: By number of ids.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(65)]


def _packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.asarray(ids, "<u4").tobytes()


class _Ids(dict):
    """The ids of each word, which stands after before; a word after _JOINED stands alone."""

    def __init__(self, tokenizer, before: str = ""):
        super().__init__()
        self.tokenizer, self.before, self.letters, self.model = tokenizer, before, None, tokenizer.model

    def encode(self, text: str) -> bytes:
        if self.letters and self.letters.fullmatch(text):  # one pre-token, which the model takes as it is
            return _packed([t.id for t in self.model.tokenize(byte_level(text))])
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word[1:] if word[:1] == _JOINED else self.before + word)
        if len(self) < KEPT_WORDS and len(word) <= _LONG:
            self[word] = ids
        return ids


class WordTokenizer:
    """encode(text) gives the ids of Tokenizer.encode(text, add_special_tokens=False), as little-endian 32-bit integers.

    The text is cut only where the tokenizer's own pre-tokenizer always cuts: before a single blank that stands before
    something else than white space, and between a letter or digit and a point. Where that does not hold for a tokenizer, or an added token could reach over a
    blank, whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.ids, self.after = _Ids(self.tokenizer), _Ids(self.tokenizer, " ")
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        plain = not any(re.search(r"\s", t.content) or t.lstrip or t.rstrip or t.single_word for t in added)
        probe = self.tokenizer.encode("a b", add_special_tokens=False).tokens
        self.drops = plain and len(probe) == 2 and not any(t.startswith(("Ġ", " ", "▁")) for t in probe)
        self.folds = all(self.ids.encode(a) == self.ids.encode(b) for a, b in (("A", "a"), ("\u00c9t\u00c9 THE", "\u00e9t\u00e9 the")))
        self.keeps = plain and not self.drops and isinstance(self.tokenizer.pre_tokenizer, ByteLevel) and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space

        # letters that no normalizer here changes, alone or after a blank, if the model's ids for them are the tokenizer's
        letters = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+" if self.drops else " ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
        probes = ["the", "a", "ionization", "qzxw", "\u00e9t\u00e9", "stra\u00dfe", "\u00ff", *([] if self.drops else ["The", " of", " \u00c9t\u00e9", " qzXW", "s", " re"])]
        if (self.drops or self.keeps) and not any(t.content.isalpha() for t in added):
            whole = [self.ids.encode(p) for p in probes]
            self.ids.letters = self.after.letters = letters
            if whole != [self.ids.encode(p) for p in probes]:
                self.ids.letters = self.after.letters = None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not (self.drops or self.keeps) or _ODD.search(text):
            return self.ids.encode(text)
        parted = not _POINT.search(text)
        if self.drops:
            if self.folds and not _CASED.search(text):
                text = text.lower()
            if parted:
                text = text.replace(".", " .").replace(",", " ,")
            return b"".join(map(self.ids.__getitem__, text.split()))
        if text[-1] == " " or any(run in text for run in _RUNS):
            return b"".join(map(self.ids.__getitem__, filter(None, _AHEAD.split(text))))
        if parted:
            text = text.replace(".", f" {_JOINED}.").replace(",", f" {_JOINED},")
        first, *rest = text.split(" ")
        return (self.ids[first] if first else b"") + b"".join(map(self.after.__getitem__, rest))


_loaded: dict[str, WordTokenizer] = {}


def load(path: str) -> WordTokenizer:
    """One for each worker and file."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def forget() -> None:
    """Gives the memory of kept words back, before a worker goes on to work of another kind: to the system too, as the
    words lie between other small objects."""
    if any(own.ids or own.after for own in _loaded.values()):
        for own in _loaded.values():
            own.ids.clear(), own.after.clear()
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
