"""Texts to token ids with a public tokenizer, one lookup for each word.

The tokenizer drops white space and never joins across it, so a text's ids are
the ids of its words in a row.  Words recur; their ids are kept packed in a
bounded cache in each Python worker.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: Words kept by each worker; older ones go when twice as many have been seen.
CACHE_WORDS = 400_000
#: A word of plain letters and the punctuation after it are tokenized apart, so they can be looked up apart.
_TAIL = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]+)")
#: Letters of Latin-1, which the splitter leaves together and the normaliser only makes small.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Bytes of such letters that the byte-level vocabulary writes as other characters; the rest are Latin-1's own.
_WRITTEN = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


class WordIds(dict):
    """UTF-8 word to its ids as packed unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        found = self._old.get(word)
        if found is None:
            tail = None if word.isalpha() else _TAIL.fullmatch(word)
            if tail:
                found = self[tail[1]] + self[tail[2]]
            else:
                text = word.decode("utf-8", "replace")
                if word.isalpha() and word.islower():
                    # small ASCII letters pass the normaliser and the splitter as they are
                    ids = [t.id for t in self._model.tokenize(text)]
                elif _LETTERS.fullmatch(word):
                    ids = [t.id for t in self._model.tokenize(text.lower().encode().decode("latin-1").translate(_WRITTEN))]
                else:
                    ids = self._tokenizer.encode(text, add_special_tokens=False).ids
                found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHE_WORDS:
            self._old = dict(self)
            self.clear()
        self[word] = found
        return found


_loaded: dict[str, WordIds] = {}


def vocabulary(path: str | None) -> str:
    """The path given, or that of the public 49k word vocabulary."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(text: str | None, path: str, end_id: int) -> bytes:
    """Packed ids of a whole text (null: empty) and the end id."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    raw = (text or "").encode("utf-8", "surrogatepass")
    # the tokenizer lower-cases; only its special strings, which hold "<|", are told apart by case
    words = (raw if b"<|" in raw else raw.lower()).split()
    return b"".join(map(_loaded[path].__getitem__, words)) + np.uint32(end_id).tobytes()
