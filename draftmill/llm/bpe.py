"""Token ids and token counts with a cache of words in each Python worker."""

from __future__ import annotations

import os
import re

#: Words of one generation of a worker's cache. Two generations are held: some 170 MB at most.
WORDS = 500_000
#: A word of letters, perhaps with a space before it and marks after it: two pre-tokens. Only letters of which all Unicode versions agree
#: that they are letters, and no apostrophe.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)\Z")


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memo(dict):
    """A dict that makes what it misses. When `size` entries are held they become the old generation, whose entries move
    back at their next use; the old generation before it is dropped."""

    def __init__(self, make, size: int = WORDS, first: dict | None = None):
        super().__init__(first or {})
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, word):
        value = self.old.pop(word, None) if self.old else None
        if value is None:
            value = self.make(word)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


class ByteBpeIds:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers, for a byte-level BPE that cuts before words.

    Where every white space is one space or one line feed between words, the text's cut is: each word with the space
    before it, and each line feed. A pre-token never reaches over a space or a line feed that stands alone, so the ids of the parts, joined, are the
    ids of the text. All other texts, and those that may hold special tokens, are encoded whole."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.after_space = Memo(lambda w: self._word(" " + w))
        self.at_start = Memo(self._word, WORDS // 10)

        # The characters that stand for bytes in the vocabulary: printable ones for themselves, the others from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.model, self.raw = self.tokenizer.model, [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.shown = {b: chr(b if b in shown else 256 + sum(x not in shown for x in range(b))) for b in range(256)}
        self.line_feed = self._encode("\n")

    def _encode(self, text: str) -> bytes:
        return b"".join([self.raw[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _word(self, word: str) -> bytes:
        plain = _PLAIN.match(word)
        if not plain:
            return self._encode(word)
        letters, marks = plain.groups()
        if marks:  # so "word," shares the entry of "word"
            return (self.after_space[letters[1:]] if letters[0] == " " else self.at_start[letters]) + self.at_start[marks]
        # One pre-token: the library's model can have it as it is.
        shown = letters.replace(" ", self.shown[32]) if letters.isascii() else letters.encode().decode("latin-1").translate(self.shown)
        return b"".join([self.raw[p.id] for p in self.model.tokenize(shown)])

    def __call__(self, text: str) -> bytes:
        words = text.split()
        n = len(words)
        if not n or "<|" in text or text.count(" ") + text.count("\n") != n - 1 or sum(map(len, words)) + n - 1 != len(text):
            return self._encode(text)
        parts, find = [], self.after_space.__getitem__
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            parts.append(self.at_start[first])
            parts += map(find, rest)
            parts.append(self.line_feed)
        parts.pop()
        return b"".join(parts)
