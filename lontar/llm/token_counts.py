"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a block of documents that a worker hasn't met yet go, sorted, into a trie. The unigram forward score of a
prefix (of its best cut into pieces) depends on the prefix alone, so each trie node is scored once for all pre-tokens that
share it, and terminal nodes keep the number of pieces. A document's count is the sum over its pre-tokens. Nothing is
shuffled: a document is counted where it is read.
"""

from __future__ import annotations

from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.common import read

#: Marks the start of a pre-token in the vocabulary's pieces.
MARK = "▁"
_SPACES = str.maketrans("\t\n\x0b\x0c\r", "     ")
#: Characters of documents that make a block, in which new pre-tokens share a trie.
BLOCK = 4_000_000
#: Pre-tokens whose counts a worker keeps; beyond that it starts anew. It bounds memory and changes no count.
KEPT = 800_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Unigram scores of a vocabulary file's pieces, or those that the caller gives (piece: log probability). By default
    the pieces' order of merit tells: the piece at position n of N scores log(1 / (n + 1)) - log(H_N), as by Zipf's law. A
    character without a piece is cut into its UTF-8 bytes, each with the score of position N, or the least one given."""

    def __init__(self, path: str, scores: dict[str, float] | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        total = log(sum(1 / (n + 1) for n in range(len(kept))))
        self.score = {piece: -log(n + 1) - total for n, piece in reversed(list(enumerate(kept)))}
        self.byte = -log(len(kept) + 1) - total
        if scores is not None:
            self.score, self.byte = dict(scores), min(scores.values(), default=self.byte)
        #: Pieces from their last character backwards: character -> [score of the piece that begins here or None, further]
        self.backwards: dict = {}
        for piece, score in self.score.items():
            here, entry = self.backwards, None
            for c in reversed(piece):
                entry = here.setdefault(c, [None, {}])
                here = entry[1]
            entry[0] = score


class TrieCounts(dict):
    """Pre-token: number of pieces. extend() adds pre-tokens through a trie."""

    def __init__(self, pieces: Pieces):
        super().__init__({"": 0})
        self.pieces, self.nodes = pieces, 0

    def extend(self, words: list[str]) -> None:
        """Sorted pre-tokens share their prefixes with the one before, so the trie's open path is all of it that later
        ones can use: best[k] and pieces[k] hold score and number of pieces of the best cut of the first k characters."""
        root, byte = self.pieces.backwards, self.pieces.byte
        best, pieces, before = [0.0], [0], ""
        for word in sorted(words):
            text = MARK + word
            shared, most = 0, min(len(text), len(before))
            while shared < most and text[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :]
            for last in range(shared, len(text)):
                c = text[last]
                width = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                most_likely, n = best[last] + width * byte, pieces[last] + width
                further, start = root, last
                while start >= 0 and (entry := further.get(text[start])):
                    own, further = entry
                    if own is not None:
                        whole = best[start] + own
                        if whole > most_likely or whole == most_likely and pieces[start] + 1 < n:  # ties: fewer pieces
                            most_likely, n = whole, pieces[start] + 1
                    start -= 1
                best.append(most_likely)
                pieces.append(n)
            self.nodes += len(text) - shared
            before = text
            self[word] = pieces[-1]


@lru_cache(1)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(1)
def _counts(path: str) -> TrieCounts:
    return TrieCounts(_pieces(path))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, scores: dict[str, float] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_pretokens, n_tokens, n_bytes. scores are a unigram model's, in place of the default.

    Pre-tokens are runs between the six ASCII white-space characters. Null text counts as empty: no tokens. Null ids and
    repeated rows are rows like any others; whole texts are counted, however long; of cuts with equal scores the one with
    fewer pieces counts; other columns are left out; an empty table gives no row.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def count(batches):
        path = vocabulary or default_vocabulary()
        known = _counts(path) if scores is None else TrieCounts(Pieces(path, scores))
        for batch in batches:
            texts, rows, at = batch.column(1).to_pylist(), [], 0
            while at < len(texts):
                block, size = [], 0
                while at < len(texts) and (not block or size + len(texts[at] or "") <= BLOCK):
                    block.append((texts[at] or "").translate(_SPACES).split(" "))
                    size += len(texts[at] or "")
                    at += 1
                if new := set().union(*block).difference(known):
                    if len(known) + len(new) > KEPT:
                        known.clear()
                        known[""] = 0
                        new = set().union(*block).difference(known)
                    known.extend(list(new))
                rows += [(len(words) - words.count(""), sum(map(known.__getitem__, words))) for words in block]
            n, counts = zip(*rows, strict=True) if rows else ([], [])
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long, n_bytes long")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
