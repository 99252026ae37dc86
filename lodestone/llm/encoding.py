"""Token ids of whole texts with a public tokenizer, word by word.

A byte-pair tokenizer that first cuts a text into words gives each word the same ids
wherever it stands, and a run of letters ends at the punctuation behind it. Each Python worker therefore keeps the ids of the words it has met, as
little-endian unsigned 32-bit integers, and joins them; only new words go to the tokenizer.
Words are looked up in portions, so what a worker holds beside a batch is bounded by
KEPT_BYTES and a portion, whatever the texts; the result doesn't depend on either.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping
from itertools import islice
from sys import getsizeof

from lodestone.llm.common import SLICE_BYTES, Recent, slices, worker_cache

#: Characters that ``\s`` matches in the tokenizers' patterns.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters, and what ends a run of them whatever follows: an ASCII character that isn't one.
LETTERS = r"A-Za-zÀ-ÖØ-öø-ʯ"
RUN = rf"[{LETTERS}]+(?=[\x00-@\[-`{{-\x7f]|\Z)"
KEPT_BYTES = 72 << 20
KEPT_CHARS = 64
TOGETHER = 200
#: Words of a long text that are looked up at once.
PORTION = 100_000


class Held(dict):
    """Ids of words that are kept, and in ``rest`` of those that only the last words looked up had."""

    rest: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.rest[word]


class Encoder:
    """ids(text) as bytes, four for each id.

    White space that the tokenizer drops separates words; where it is kept (byte-level),
    one blank belongs to the word behind it, as in the tokenizer's own pattern.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kept = Recent(KEPT_BYTES)
        white = rf" ?{RUN}| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
        keeps = self.keeps_white()
        self.words = re.compile(white if keeps else rf"{RUN}|[^{WHITE}]+")
        self.plain = re.compile(rf" [{LETTERS}]+" if keeps else rf"[{LETTERS}]+").fullmatch
        self.glue, self.edge = ("", self.edges(0, "Ġ")) if keeps else (" ", self.edges(-1, "</w>"))

    def edges(self, place: int, mark: str):
        """For each id whether its token is the first (0) or last (-1) of a word."""
        import numpy as np

        vocab = self.tokenizer.get_vocab()
        out = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            out[i] = token.startswith(mark) if place == 0 else token.endswith(mark)
        self.first = place == 0
        return out

    def encode_plain(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters only: many go through the tokenizer as one text, and their ids are told apart by the tokens that begin or end a word."""
        import numpy as np

        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        out: dict[str, bytes] = {}
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([self.glue.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.edge[ids])
            cuts = [*at.tolist(), len(ids)] if self.first else [0, *(at + 1).tolist()]
            if len(cuts) != len(group) + 1 or cuts[0] or cuts[-1] != len(ids):
                out |= self.encode_each(group)
                continue
            raw = ids.tobytes()
            for w, i, j in zip(group, cuts, cuts[1:], strict=False):
                out[w] = raw[4 * i : 4 * j]
        return out

    def encode_each(self, words: list[str]) -> dict[str, bytes]:
        import numpy as np

        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True)}

    def keeps_white(self) -> bool:
        return bool(self.tokenizer.encode("a \n b", add_special_tokens=False).ids != self.tokenizer.encode("a b", add_special_tokens=False).ids)

    def lookup(self, words: set[str]) -> Mapping[str, bytes]:
        """Ids of each of the words, and of others; the kept words' own dictionary, so that words met before cost one look."""
        kept, new = self.kept, []
        if kept.size >= kept.half or not isinstance(kept.young, Held):
            kept.old, kept.young, kept.size = kept.young, Held(), 0
        young, old, size = kept.young, kept.old, 0
        young.rest = {}  # what is too long to be kept
        for w in [w for w in words if w not in young]:
            ids = old.get(w)
            if ids is None:
                new.append(w)
            else:
                young[w] = ids
                size += 100 + getsizeof(w) + getsizeof(ids)
        for i in range(0, len(new), 20_000):
            plain, rest = [], []
            for w in new[i : i + 20_000]:
                (plain if self.plain(w) else rest).append(w)
            for found in (self.encode_plain(plain), self.encode_each(rest)):
                for w, ids in found.items():
                    if len(w) <= KEPT_CHARS:
                        young[w] = ids
                        size += 100 + getsizeof(w) + getsizeof(ids)
                    else:
                        young.rest[w] = ids
        kept.size += size
        return young

    def encode_long(self, text: str) -> bytes:
        """Portion by portion."""
        found, out = self.words.finditer(text), []
        while words := [m[0] for m in islice(found, PORTION)]:
            out.append(b"".join(map(self.lookup(set(words)).__getitem__, words)))
        return b"".join(out)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for i, j in slices(list(map(len, texts))):
            if len(texts[i]) > SLICE_BYTES:
                yield self.encode_long(texts[i])
                continue
            words = [self.words.findall(t) for t in texts[i:j]]
            ids = self.lookup(set().union(*words)).__getitem__
            for w in words:
                yield b"".join(map(ids, w))


def encoder(path: str) -> Encoder:
    """One encoder for each worker."""
    return worker_cache(("encoder", path), lambda: Encoder(path))
