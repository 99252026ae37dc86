"""Token counts by a count-only Viterbi.

An Aho-Corasick automaton over the vocabulary names every piece that ends at each character
of a word, longest first. Dynamic programming carries only the best score and its number of
tokens to each place; no path is kept. Workers remember the counts of words met lately, in
KEPT_BYTES at most.

Defined cases: a null or empty text has no tokens. Repeated rows and null ids keep a row each.
A word of any length takes time and memory in proportion to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Recent, arrow_rows, column, worker_cache
from lodestone.llm.pieces import WORDS, Pieces, marked, read

KEPT_BYTES = 96 << 20
KEPT_CHARS = 64
words = re.compile(WORDS).finditer


class Counter:
    def __init__(self, pieces: Pieces) -> None:
        import ahocorasick

        self.pieces, self.kept = pieces, Recent(KEPT_BYTES)
        self.automaton = ahocorasick.Automaton()
        for piece, (_, score) in pieces.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def word(self, w: str) -> tuple[int, float, int]:
        """(tokens, score, characters that are no piece)."""
        n, unknown, single = len(w), self.pieces.unknown, self.pieces.scores
        best: list[float | None] = [None] * (n + 1)
        best[0], count, odd = 0.0, [0] * (n + 1), [0] * (n + 1)
        at = 0

        def close(upto: int) -> None:  # places whose edges all are known
            nonlocal at
            while at < upto:
                at += 1
                c = w[at - 1]
                if c not in single and (best[at] is None or best[at - 1] + unknown > best[at]):
                    best[at] = best[at - 1] + unknown
                    count[at] = count[at - 1] + len(c.encode("utf-8", "surrogatepass"))
                    odd[at] = odd[at - 1] + 1

        for end, (size, score) in self.automaton.iter(w):
            close(end)
            start = end + 1 - size
            found = best[start] + score
            if best[end + 1] is None or found > best[end + 1]:
                best[end + 1], count[end + 1], odd[end + 1] = found, count[start] + 1, odd[start]
        close(n)
        return count[n], best[n], odd[n]

    def text(self, text: str) -> tuple[int, float, int]:
        kept, tokens, score, odd = self.kept, 0, 0.0, 0
        for m in words(marked(text)):
            w = m[0]
            got = kept.get(w)
            if got is None:
                got = self.word(w)
                if len(w) <= KEPT_CHARS:
                    kept.put(w, got)
            tokens += got[0]
            score += got[1]
            odd += got[2]
        return tokens, score, odd


def counter(path: str) -> Counter:
    return worker_cache(("counter", path), lambda: Counter(read(path)))


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, score, n_unknown_chars) of docs(doc_id, text). No shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            got = [counter(model).text(t or "") for t in column(b, "text")]
            cols = list(zip(*got, strict=True)) or [[], [], []]
            kinds = (pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_tokens", "score", "n_unknown_chars"])

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, score double, n_unknown_chars long")


def op6_viterbi_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document under the vocabulary's best segmentation."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
