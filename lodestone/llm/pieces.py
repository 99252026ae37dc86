"""A SentencePiece vocabulary read as a unigram model: pieces with scores, bytes for what no piece covers.

The score of a segmentation is the sum of its pieces' scores. A character that is no piece
costs the least score less PENALTY, and stands for its UTF-8 bytes. Of equal scores the
segmentation wins whose last piece begins earlier, as in the public unigram tokenizers, which
take a better path only if it is strictly better and try starts in ascending order.

Blanks become ``MARK`` and one is put before a text. A text is cut into words: a run of
letters, a digit, or a run of other characters, each with the marks before it; a line break; or
marks alone. No piece goes beyond a word, so the best segmentation of a text is that of its
words. ``read`` checks that against the vocabulary.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

MARK = "▁"
PENALTY = 10.0
SLACK = 1e-3
LETTERS = "A-Za-zÀ-ɏ"
WORDS = f"{MARK}*[{LETTERS}]+|{MARK}*[0-9]|{MARK}*[^{LETTERS}0-9{MARK}\n]+|\n|{MARK}+"


@dataclass(frozen=True)
class Pieces:
    scores: dict[str, tuple[int, float]]
    names: tuple[str, ...]
    unknown: float
    byte_ids: tuple[int, ...]
    longest: int


@cache
def read(path: str) -> Pieces:
    """The vocabulary of a model file. Control and byte pieces never match text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = tuple(sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    plain = [i for i in range(len(names)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = {names[i]: (i, float(sp.get_score(i))) for i in plain}
    if not all(re.fullmatch(WORDS, p) for p in scores):
        raise ValueError("a piece goes beyond a word")
    number = {n: i for i, n in enumerate(names)}
    byte_ids = tuple(number[f"<0x{b:02X}>"] for b in range(256))
    if byte_ids != tuple(range(byte_ids[0], byte_ids[0] + 256)):
        raise ValueError("the bytes' ids aren't in a row")
    return Pieces(scores, names, min(s for _, s in scores.values()) - PENALTY, byte_ids, max(map(len, scores)))


@cache
def needed(path: str) -> dict[str, tuple[int, float]]:
    """The pieces that a best segmentation may use, with their numbers and scores.

    A piece of several characters that shorter ones spell with a better score is in no best
    segmentation, since they could stand in its place. Those that are equal, or better by
    SLACK or less, stay: ties and rounding are left to the search itself.
    """
    pieces, out = read(path), {}
    for piece, (number, score) in pieces.scores.items():
        best = [0.0]
        for end in range(1, len(piece) + 1):
            starts = range(end == len(piece), end)
            found = [best[b] + pieces.scores[piece[b:end]][1] for b in starts if piece[b:end] in pieces.scores]
            if len(piece) > 1 and piece[end - 1] not in pieces.scores:
                found.append(best[end - 1] + pieces.unknown)
            best.append(max(found, default=score))
        if best[-1] <= score + SLACK:
            out[piece] = (number, score)
    return out


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


words = re.compile(WORDS).findall
