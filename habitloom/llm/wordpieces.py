"""Token ids of whole texts by a public tokenizer file, fast where words repeat."""

import os
import re

import numpy as np

from habitloom.llm.common import kept_in_worker

# The tokenizer drops white space and never joins across it, so a text's ids are
# those of its blank-separated chunks in order. Other white space than the ASCII
# kind is left inside the chunks for the tokenizer to judge.
_ODD_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BLANKS = re.compile("[ \t-\r]+")
# A lower-case word of Latin-1 letters, and ASCII marks behind it: two separate pre-tokens.
# An apostrophe may begin a contraction and is left to the tokenizer.
_PLAIN = re.compile(r"([a-z\xdf-\xf6\xf8-\xff]*)([!-&(-/:-@\[-`{-~]*)")
# Beyond Latin-1, lower-casing a chunk may differ from the tokenizer's own rule.
_LATIN = re.compile("[\x00-\xff]*")


class WordPieces:
    """Ids of texts for a lower-casing word tokenizer with end-of-word pieces.

    Chunks are looked up in two generations of a bounded cache; what is not
    there is encoded by the tokenizer, plain words many at a time. A text that
    may hold a special token is encoded whole. ``cache`` bounds memory only.
    """

    def __init__(self, path: str, cache: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        names = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(names.values()) + 1, dtype=bool)
        self._ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.dtype = np.dtype("<u2" if len(self._ends) <= 1 << 16 else "<u4")
        self._cache, self._young, self._old = cache, {}, {}

    def _encode(self, text):
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _encode_words(self, plain):
        """Ids of lower-case words: one call, cut behind each end-of-word piece."""
        ids = self._encode(" ".join(plain))
        raw, size = ids.tobytes(), ids.itemsize
        ends = (np.flatnonzero(self._ends[ids]) + 1) * size
        if len(ends) != len(plain):
            return [self._encode(w).tobytes() for w in plain]
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, chunks):
        """Put the missing ``chunks`` into the young generation; its ids as bytes."""
        young, known = self._young, self._known
        split = {c: m.groups() for c in chunks if (m := _PLAIN.fullmatch(c))}
        units = {u for pair in split.values() for u in pair if u}
        missing = [u for u in units if known(u) is None]
        plain = [u for u in missing if u.isalpha()]
        if plain:
            for word, ids in zip(plain, self._encode_words(plain), strict=True):
                young[word] = ids
        for unit in missing:
            if not unit.isalpha():
                young[unit] = self._encode(unit).tobytes()
        for chunk in chunks:
            if chunk not in young:
                young[chunk] = b"".join(known(u) for u in split[chunk] if u) if chunk in split else self._encode(chunk).tobytes()

    def _known(self, chunk):
        found = self._young.get(chunk)
        if found is None and (found := self._old.get(chunk)) is not None:
            self._young[chunk] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian integers of ``dtype``; none for null."""
        if not text:
            return b""
        if "<|" in text:
            return self._encode(text).tobytes()
        if _LATIN.fullmatch(text):
            text = text.lower()
        chunks = [c for c in _BLANKS.split(text) if c] if _ODD_BLANKS.search(text) else text.split()
        if len(self._young) > self._cache:
            self._young, self._old = {}, self._young
        young, known = self._young, self._known
        missing = {c for c in set(chunks) if c not in young and known(c) is None}
        if missing:
            self._learn(missing)
        return b"".join([young[c] for c in chunks])


def word_pieces(path: str) -> WordPieces:
    """The tokenizer of this process, which keeps it, and the words it has met, from task to task."""
    return kept_in_worker(("tokenizer", path), lambda: WordPieces(path))
