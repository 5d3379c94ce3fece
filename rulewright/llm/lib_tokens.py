"""Whole texts through the tokenizers library, which sees each distinct piece once per worker.

A vectorised split finds the pieces that the library's own pre-tokenizer would find; unseen pieces go
to the library joined by line breaks, in one call, and its word numbers tell their ids apart. Texts that may hold the
string of an added token, which the library gives that token's id, and texts with characters whose normalisation could
join or split pieces go to the library whole, in batches.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata

import numpy as np

from rulewright.llm.pretok import TextEncoder, chunks, once

#: Below this code point, without the dotted capital I, lower-casing and NFC map one character to one.
SIMPLE_BELOW = 0x250


class LibEncoder:
    def __init__(self, content: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        self.lib = Tokenizer.from_str(content)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.added = [t["content"] for t in json.loads(content).get("added_tokens", [])]
        self.words = json.loads(content)["normalizer"] is not None
        self.coder = TextEncoder(self._pieces, "word" if self.words else "byte")

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if not p[-1].isspace() and len(p) < 200]
        for a in range(0, len(plain), 5000):
            part = plain[a : a + 5000]
            e = self.lib.encode("\n".join(pieces[i] for i in part), add_special_tokens=False)
            step = 1 if self.words else 2  # the line break is a piece of its own, or none
            if not e.ids or e.word_ids[-1] != step * (len(part) - 1):
                continue
            lists: list = [[] for _ in part]
            for w, i in zip(e.word_ids, e.ids):
                if w % step == 0:
                    lists[w // step].append(i)
            for i, ids in zip(part, lists):
                out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.lib.encode_batch([pieces[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        whole = np.fromiter(map(self._goes_whole, texts), bool, len(texts))
        ids, lens = self.coder(["" if w else t.lower() if self.words else t for t, w in zip(texts, whole)])
        if not whole.any():
            return ids, lens
        at = np.flatnonzero(whole)
        some = [texts[i] for i in at]
        found = [e.ids for a, b in chunks(some) for e in self.lib.encode_batch(some[a:b], add_special_tokens=False)]
        lens = np.array(lens, np.int64)
        before = np.cumsum(lens)[at]
        lens[at] = [len(x) for x in found]
        parts = np.split(ids, before)
        return np.concatenate([parts[0], *(x for x, rest in zip(found, parts[1:]) for x in (np.array(x, np.int32), rest))]), lens

    def _goes_whole(self, text: str) -> bool:
        if any(a[0] in text for a in self.added) and any(a.lower() in text.lower() for a in self.added):
            return True
        return self.words and not self._simple(text) and not self._maps_one_to_one(text)

    @staticmethod
    def _simple(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return max(text) < chr(SIMPLE_BELOW) and "İ" not in text
        return True

    @staticmethod
    def _maps_one_to_one(text: str) -> bool:
        """True for texts in which general punctuation is all that lies above the simple range."""
        odd = {c for c in set(text) if c >= chr(SIMPLE_BELOW)}
        return "İ" not in text and all(0x2010 <= ord(c) <= 0x2027 and unicodedata.normalize("NFC", c) == c for c in odd)


def lib_encoder(content: str) -> LibEncoder:
    return once(("lib", hashlib.sha256(content.encode()).digest()), lambda: LibEncoder(content))
