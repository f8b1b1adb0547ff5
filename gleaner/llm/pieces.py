"""Token ids of whole texts by a public tokenizer, with each distinct word encoded once.

The pre-tokenizers of the supported vocabularies always begin a new word at a single space that is followed by a
non-space, so a text may be cut there and its parts encoded apart.  Most parts are a word, with punctuation and a line
end and the next line's first word at most; pre-tokenizers divide these too.  What repeats is kept in bounded
dictionaries; new words are encoded together, and their tokens told apart by the marks of the vocabulary.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

CUT = re.compile(r" (?=\S)")
ODD = re.compile(r" (?:\s|$)")
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-^`{-~]*\n?)([A-Za-zÀ-ÖØ-öø-ÿ]*)")
KEEP = 800_000
JOINED = 64


def parts(text: str) -> list[str]:
    """The text cut at each single space before a non-space, that space left out."""
    return CUT.split(text) if ODD.search(text) else text.split(" ")


class PieceEncoder:
    """``encode(texts)`` gives one little-endian byte string of ids per text (``dtype`` wide)."""

    def __init__(self, path: str, keep: int = KEEP):
        self.keep = keep
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a text that holds one of these is left to the library as a whole: it takes them out before it looks at words
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 65536 else "<u4")
        self.inner: dict[str, bytes] = {}  # after a space
        self.bare: dict[str, bytes] = {"": b""}  # at the beginning of a text, a line or after a word
        # tokens that begin with the space before a word, or that end a word
        known = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        self.begin = np.zeros(self.vocabulary, bool)
        self.end = np.zeros(self.vocabulary, bool)
        for token, number in known:
            self.begin[number], self.end[number] = token.startswith("\u0120"), token.endswith("</w>")
        self.spaced = not self.end.any()

    def _pack(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _bare(self, text: str) -> bytes:
        if (known := self.bare.get(text)) is None:
            known = self.bare[text] = self._pack(text)
        return known

    def _learn(self, words: list[str]) -> None:
        """Encode words of letters as they stand after a space, many in one text.

        Each is one piece of the pre-tokenizer, so its first token alone has the space, or its last one alone the end."""
        width = self.dtype.itemsize
        runs = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        joined = ["".join(f" {w}" for w in run) for run in runs]
        for run, encoded in zip(runs, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(encoded.ids, self.dtype)
            cuts = np.append(np.flatnonzero(self.begin[ids]), len(ids)) if self.spaced else np.append(0, np.flatnonzero(self.end[ids]) + 1)
            if len(cuts) != len(run) + 1 or cuts[0] or cuts[-1] != len(ids):
                self.inner.update((w, self._pack(f" {w}")) for w in run)
                continue
            data, cuts = ids.tobytes(), (cuts * width).tolist()
            self.inner.update((w, data[a:b]) for w, a, b in zip(run, cuts, cuts[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = {k for k, t in enumerate(texts) if self.added.search(t)}
        if odd:
            rest = iter(self.encode([t for k, t in enumerate(texts) if k not in odd]))
            return [self._pack(t) if k in odd else next(rest) for k, t in enumerate(texts)]
        split = [parts(t) for t in texts]
        for known in (self.inner, self.bare):
            if len(known) > self.keep:
                known.clear()
        self.bare[""] = b""
        heads = [x.pop(0) for x in split]
        inner = self.inner
        words, whole, simple = set(), [], []
        bare, match = self.bare, SIMPLE.fullmatch
        for p in set().union(*split) - inner.keys():
            if p.isalpha():
                words.add(p)
            elif (m := match(p)) is not None:
                simple.append((p, *m.groups()))
            else:
                whole.append(p)
        self._learn(list(words.union(x[1] for x in simple) - inner.keys()))
        inner.update((p, self._pack(f" {p}")) for p in whole)
        for p, word, middle, after in simple:
            inner[p] = inner[word] + (bare.get(middle) or self._bare(middle)) + (bare.get(after) or self._bare(after))
        out = []
        for head, rest in zip(heads, split):
            m = SIMPLE.fullmatch(head)
            first = b"".join(map(self._bare, m.groups())) if m else self._bare(head)
            out.append(first + b"".join(map(inner.__getitem__, rest)))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, keep: int = KEEP) -> PieceEncoder:
    """One encoder per worker process and vocabulary file, with at most ``keep`` words and one batch's new ones."""
    return PieceEncoder(path, keep)
