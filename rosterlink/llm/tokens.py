"""Token ids of whole texts by the tokenizers library, with a bounded memory of words.

The tokenizer's rules must not look across white space; ``word_bpe_49k.json`` drops it
before its merges. A text's ids are then those of its words in a row, and only words not
seen before go through the library.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

END_ID = 1
MEMORY_WORDS = 800_000  # words a task remembers; it forgets all and starts anew beyond

_MARKS = ".,!?;:"  # closing marks split off before a word is looked at
_LAST = "\xff"  # lower-casing and NFC treat letters up to here one by one
_MOST = 64  # characters of a word that goes the short way


# White space to str.split(), but not to the tokenizer.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_ASCII_SPACES = re.compile("[\x20\x09-\x0d]+")


def split_words(text: str) -> list[str]:
    if any(c in text for c in _SEPARATORS):
        return _ASCII_SPACES.split(text)
    return text.split()


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = {c.lower() for c in map(chr, range(0x100)) if c.isalpha()}
        self.visible = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}
        self.model = self.tokenizer.model  # each access makes a new one
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        if len(self.words) + len(words) > MEMORY_WORDS:
            self.words.clear()
        if len(self.cores) + len(words) > MEMORY_WORDS:
            self.cores.clear()
        rest, tokenize, cores = [], self.model.tokenize, self.cores
        for word in words:
            core = word.rstrip(_MARKS)
            if not core.isalpha() or len(word) > _MOST or max(core) > _LAST:
                rest.append(word)
                continue
            lower = core.lower()
            ids = cores.get(lower)
            if ids is None:
                tokens = tokenize(lower if lower.isascii() else lower.translate(self.visible))
                ids = cores[lower] = array("I", [t.id for t in tokens]).tobytes()
            if len(core) < len(word):
                marks = word[len(core) :]
                if marks not in self.marks:
                    self.marks[marks] = self._whole([marks])[0]
                ids += self.marks[marks]
            self.words[word] = ids
        self.words.update(zip(rest, self._whole(rest), strict=True))

    def ids(self, text: str | None) -> bytes:
        """All ids of a text and the end id."""
        words = split_words(text or "")
        known = self.words
        try:
            return b"".join([known[w] for w in words]) + _END
        except KeyError:
            parts = []
            for a in range(0, len(words), MEMORY_WORDS // 2):
                some = words[a : a + MEMORY_WORDS // 2]
                new = {w for w in some if w not in known}
                if len(known) + len(new) > MEMORY_WORDS:
                    new = set(some)
                if new:
                    self._learn(new)
                parts.append(b"".join([known[w] for w in some]))
            return b"".join(parts) + _END


_END = np.array([END_ID], "<u4").tobytes()


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark keeps all cores busy
    return WordTokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
