"""Token counts under a unigram vocabulary, by dynamic programming over a trie.

A text's pre-tokens are its words, each led by the word mark. A batch's distinct
pre-tokens are inserted into a trie. The forward score of a trie node is the best score of a
segmentation of its prefix into vocabulary pieces; it is computed once a node, so pre-tokens
that share a prefix share its scores. The token count of a terminal node is stored, and a
text sums those of its words.

Tasks work on their own rows: nothing is shuffled, and no dictionary of all words exists
anywhere. The trie of a task grows over batches up to ``TRIE_NODES`` nodes and then
starts anew, so its memory is bounded; the results do not depend on it.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import boxed, quoted, unboxed

MARK = "▁"
TRIE_NODES = 1_000_000


class Vocabulary:
    """Pieces with scores (logarithms), and what a character outside all pieces costs: its
    UTF-8 bytes, each one token of a score below that of any piece."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte_score = min(scores.values(), default=0.0) - 10.0


def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a sentencepiece model file on the driver. Its pieces are in the order of
    frequency; a piece's score is the logarithm of its probability under Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (rank + 1) for rank in range(len(pieces))))
    return Vocabulary({piece: -math.log(rank + 1) - total for rank, piece in enumerate(pieces)})


class Trie:
    """Pre-tokens with forward scores. A node has ``best`` (score)
    and ``count`` (tokens of the best segmentation; of equal scores the fewest)."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.children: list[dict[str, int]] = [{}]
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]
        self.terminal: dict[bytes, int] = {}  # counts of the pre-tokens so far, by their word

    def insert(self, word: str) -> int:
        """Insert a pre-token; the token count at its terminal node."""
        scores, longest = self.vocabulary.scores, self.vocabulary.longest
        children, best, count = self.children, self.best, self.count
        path, node = [0], 0
        for depth, c in enumerate(word, 1):
            to = children[node].get(c)
            if to is None:
                width = len(c.encode("utf-8", "surrogatepass"))
                top, tokens = best[node] + width * self.vocabulary.byte_score, count[node] + width
                for start in range(max(0, depth - longest), depth):
                    score = scores.get(word[start:depth])
                    if score is not None:
                        at = path[start]
                        score += best[at]
                        if score > top or score == top and count[at] + 1 < tokens:
                            top, tokens = score, count[at] + 1
                to = children[node][c] = len(children)
                children.append({})
                best.append(top)
                count.append(tokens)
            node = to
            path.append(node)
        return count[node]


def token_counts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """docs with ``n_pretokens`` and ``n_tokens`` of the whole text.

    A null or empty text has none; a text of any length is taken whole, one at a time. Rows stay rows; columns of these names are replaced, all
    others stay, whatever their names. Of splits of equal score the one of fewer pieces counts.
    An empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    held: dict[str, Trie] = {}

    @F.pandas_udf("n_pretokens long, n_tokens long")
    def counts(texts: pd.Series) -> pd.DataFrame:
        out = []
        trie = held.setdefault("trie", Trie(shared.value))
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").split()
            total = 0
            known, insert = trie.terminal.get, trie.insert
            for w in words:
                n = known(w)
                if n is None:
                    n = trie.terminal[w] = insert(MARK + w.decode("utf-8", "surrogatepass"))
                total += n
            out.append((len(words), total))
            if len(trie.children) > TRIE_NODES:
                trie = held["trie"] = Trie(shared.value)
        return pd.DataFrame(out, columns=["n_pretokens", "n_tokens"])

    box = boxed(docs, ("n_pretokens", "n_tokens"), counts=counts(quoted(text_col)))
    return unboxed(box, "counts.n_pretokens", "counts.n_tokens")


def default_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
