"""Token counts by dynamic programming shared over a trie.

The distinct pre-tokens (words of the text, each with the word mark in front)
of a task's rows are inserted in a trie. A node is a prefix; its forward score,
the best sum of piece scores over segmentations of the prefix, depends on the
prefix alone, so it is computed once for all pre-tokens that share it. The node
where a pre-token ends stores its token count, and a document's count is a sum
of stored counts. Characters without a piece cost the byte pieces of their UTF-8
form. Among best segmentations the one of fewest tokens counts.

Scores are the vocabulary file's where it holds log-probabilities; the count is
then that of a unigram model's own encoder. A file made by merges holds ranks in
their place, which are no log-probabilities: rank r gets that of the
Zipf-Mandelbrot law, in proportion to 1 / (r + ``MANDELBROT``). Its own encoder
merges pair by pair and finds nearly as many tokens, not the same ones.

The trie belongs to the worker process and is started anew when it holds
``NODES`` nodes, the stored counts when they are ``COUNTS``; this bounds memory
and changes no count. There is no shuffle.

Defined cases: null and empty texts, and texts of white space, have no tokens;
rows with the same doc_id are counted each; a pre-token over ``LONG`` characters
shares no prefix and is scored on its own, without trie nodes, holding only as
many forward scores as the longest piece has characters; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm import common

MARK = "▁"
NODES = 400_000
COUNTS = 1_000_000
LONG = 200
#: What the law adds to a rank.
MANDELBROT = 100


class Pieces:
    """Scores of a vocabulary's pieces, and of characters by bytes."""

    def __init__(self, scores: dict[str, float], byte_scores: dict[int, float]):
        self.scores, self.byte_scores = scores, byte_scores
        # Lengths of the pieces that end in two given characters, short ones first.
        found: dict[str, set[int]] = {}
        for piece in scores:
            if len(piece) > 1:
                found.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {end: tuple(sorted(n)) for end, n in found.items()}
        self.longest = max(map(len, scores), default=1)
        self.worst = min([*byte_scores.values(), *scores.values(), 0.0]) - 1

    def char(self, c: str) -> tuple[float, int]:
        """Score and number of tokens of one character without a piece."""
        raw = c.encode("utf-8", "surrogatepass")
        return sum(self.byte_scores.get(b, self.worst) for b in raw), len(raw)


def log_probabilities(scores: dict[str, float]) -> dict[str, float]:
    """Scores as they are, or by the law of ranks where all are whole numbers."""
    if any(s != int(s) for s in scores.values()):
        return scores
    share = {piece: 1 / (MANDELBROT - s) for piece, s in scores.items()}
    total = math.fsum(share.values())
    return {piece: math.log(x / total) for piece, x in share.items()}


def read_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece model file."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    scores, byte_scores = {}, {}
    for i in range(p.get_piece_size()):
        piece = p.id_to_piece(i)
        if p.is_byte(i):
            byte_scores[int(piece[3:5], 16)] = p.get_score(i)
        elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
            scores[piece] = p.get_score(i)
    made = log_probabilities(scores)
    if byte_scores and (made is not scores or max(byte_scores.values()) >= 0):  # bytes carry no score of their own in the file
        byte_scores = dict.fromkeys(byte_scores, min(made.values()) - 1)
    return Pieces(made, byte_scores)


class Trie:
    """Pre-tokens seen so far, with forward scores at the nodes."""

    def __init__(self, pieces: Pieces, nodes: int = NODES, counts: int = COUNTS):
        self.pieces, self.nodes, self.counts = pieces, nodes, counts
        self.terminal: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best: list[tuple[float, int]] = [(0.0, 0)]

    def _forward(self, word: str, i: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        """Best (score, -tokens) of ``word[:i]``, from those of shorter prefixes."""
        scores = self.pieces.scores
        own = scores.get(word[i - 1 : i])
        if own is None:
            cost, n = self.pieces.char(word[i - 1])
            best = (path[i - 1][0] + cost, path[i - 1][1] - n)
        else:
            best = (path[i - 1][0] + own, path[i - 1][1] - 1)
        if i > 1:
            for n in self.pieces.lengths.get(word[i - 2 : i], ()):
                if n > i:
                    break
                s = scores.get(word[i - n : i])
                if s is not None:
                    reach = (path[i - n][0] + s, path[i - n][1] - 1)
                    if reach > best:
                        best = reach
        return best

    def insert(self, word: str) -> int:
        """The token count of a pre-token, stored at its terminal node."""
        marked = MARK + word
        path = [(0.0, 0)]
        if len(marked) > LONG:
            return self._alone(marked)
        if len(self.best) >= self.nodes:
            self.clear()
        node = 0
        for i, c in enumerate(marked, 1):
            below = self.child.get((node, c))
            if below is None:
                below = self.child[(node, c)] = len(self.best)
                self.best.append(self._forward(marked, i, path))
            node = below
            path.append(self.best[node])
        if len(self.terminal) >= self.counts:
            self.terminal.clear()
        count = self.terminal[word] = -self.best[node][1]
        return count

    def _alone(self, word: str) -> int:
        """The token count of a long pre-token, from the last forward scores only."""
        keep, done, path, base = self.pieces.longest + 1, 0, [(0.0, 0)], 0
        while done < len(word):  # a run of characters at a time, with what its pieces can reach back to
            part = word[base : done + 4 * keep]
            for i in range(done - base + 1, len(part) + 1):
                path.append(self._forward(part, i, path))
            done = base + len(part)
            cut = max(0, len(path) - keep)
            path, base = path[cut:], base + cut
        return -path[-1][1]

    def count(self, words: list[str]) -> int:
        """Tokens of a text's pre-tokens, repeats included."""
        stored = self.terminal
        total = 0
        for word in words:
            n = stored.get(word)
            if n is None:
                n = self.insert(word)
            total += n
        return total


@lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    """The worker's trie for a vocabulary file."""
    return Trie(read_pieces(path))


def pre_tokens(raw: bytes | None) -> list[str]:
    """Words between ASCII white space."""
    return raw.translate(common.SPLIT_BYTES).decode("utf-8", "replace").split(" ") if raw else []


def _count(batches: Iterator[pa.RecordBatch], path: str):
    t = trie(path)
    for batch in batches:
        words, tokens, sizes = [], [], []
        for raw in batch.column(1):
            raw = raw.as_py()
            own = [w for w in pre_tokens(raw) if w]
            words.append(len(own))
            tokens.append(t.count(own))
            sizes.append(len(raw or b""))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
            names=["doc_id", "n_bytes", "n_pretokens", "n_tokens"],
        )


def counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_pretokens, n_tokens`` of every row."""
    return common.texts(docs).mapInArrow(lambda it: _count(it, path), "doc_id bigint, n_bytes bigint, n_pretokens bigint, n_tokens bigint")
