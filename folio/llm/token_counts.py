"""Token counts under a unigram view of a vocabulary, with prefixes of pre-tokens shared in a trie.

Texts are cut into pre-tokens; each distinct one is cut into pieces of the vocabulary by
the best sum of log probabilities (equal sums go to fewer pieces), and a text has as many
tokens as its pre-tokens have pieces. The distinct pre-tokens of a batch, sorted, form a
trie whose nodes are worked off depth by depth: a node's forward score, the best one of
all cuts of its prefix, is computed once for all pre-tokens that share the prefix. At a
pre-token's last node stands its count, which is kept for the task's later batches.

The vocabulary is a file of byte pieces by rank; as such files have no probabilities, a
piece of rank r has the log probability -log(r + 2), Zipf's law.
"""

from __future__ import annotations

import base64

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Letters with a space before them, digits, other signs, and white space, as byte-level vocabularies expect.
PATTERN = regex.compile(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pre-tokens of more bytes are cut one by one; counts that a task keeps.
TRIE_BYTES, KEPT = 48, 1_000_000
_BASE = np.uint64(0x100000001B3)


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_BASE) + b + 1) & (1 << 64) - 1
    return h


class Vocabulary:
    def __init__(self, lines: list[str]):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.score = {p: -float(np.log(r + 2)) for p, r in ranks.items()}
        self.longest = max(map(len, self.score))
        pieces = [p for p in self.score if len(p) <= TRIE_BYTES]
        keys = np.array([_hash(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([self.score[p] for p in pieces])[order]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[keys >> np.uint64(42)] = True
        self.ends: ahocorasick.Automaton | None = None  # of all pieces, once a long pre-token needs it

    def scores(self, hashes: np.ndarray) -> np.ndarray:
        """Scores of the pieces with these hashes, -inf where there is none."""
        out = np.full(len(hashes), -np.inf)
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(42)])
        if len(at):
            k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[k] == hashes[at], self.values[k], -np.inf)
        return out

    def plain(self, token: bytes) -> int:
        """Pieces of one pre-token of any length, by the same recurrence over the pieces that end at each byte."""
        if self.ends is None:
            self.ends = ahocorasick.Automaton()
            for piece, s in self.score.items():
                self.ends.add_word(piece.decode("latin-1"), (len(piece), s))
            self.ends.make_automaton()
        best = [(0.0, 0)] + [(-np.inf, 0)] * len(token)  # scores, and numbers of pieces below zero
        for last, (size, s) in self.ends.iter(token.decode("latin-1")):
            score, n = best[last + 1 - size]
            if (found := (score + s, n - 1)) > best[last + 1]:
                best[last + 1] = found
        return -best[-1][1]

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Pieces of each of the sorted distinct pre-tokens, none longer than ``TRIE_BYTES``."""
        n = len(tokens)
        chars = np.array(tokens, f"S{TRIE_BYTES}").view(np.uint8).reshape(n, TRIE_BYTES)
        size = np.array([len(t) for t in tokens])
        same = np.zeros(n, np.int64)  # bytes shared with the pre-token before
        if n > 1:
            differs = chars[1:] != chars[:-1]
            same[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), TRIE_BYTES)
            same[1:] = np.minimum(same[1:], np.minimum(size[1:], size[:-1]))
        out = np.zeros(n, np.int64)
        # By depth: the pre-tokens that reach it, the first of each node, and per pre-token its node's score, count and hash.
        score, count, hashes = [np.zeros(n)], [np.zeros(n, np.int64)], [np.zeros(n, np.uint64)]
        powers = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(TRIE_BYTES + 1)]
        for depth in range(1, int(size.max(initial=0)) + 1):
            at = np.flatnonzero(size >= depth)
            short = np.minimum.reduceat(same, np.append(0, at[:-1] + 1)) if len(at) > 1 else same[:1]
            new = short < depth
            new[0] = True
            node, head = np.cumsum(new) - 1, at[new]
            h = hashes[depth - 1][head] * _BASE + chars[head, depth - 1] + np.uint64(1)
            best, least = np.full(len(head), -np.inf), np.zeros(len(head), np.int64)
            for length in range(min(depth, self.longest), 0, -1):  # depth is TRIE_BYTES at most
                s = self.scores(h - hashes[depth - length][head] * powers[length])
                hit = np.flatnonzero(s > -np.inf)
                s, c = s[hit] + score[depth - length][head[hit]], count[depth - length][head[hit]] + 1
                better = (s > best[hit]) | ((s == best[hit]) & (c < least[hit]))
                best[hit[better]], least[hit[better]] = s[better], c[better]
            for arrays, value in ((score, best), (count, least), (hashes, h)):
                full = np.zeros(n, value.dtype)
                full[at] = value[node]
                arrays.append(full)
            done = size[at] == depth
            out[at[done]] = least[node[done]]
        return out


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known = vocabulary, {}

    def __call__(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of each text."""
        cut = [PATTERN.findall(t) if t else [] for t in texts]
        if len(self.known) > KEPT:
            self.known = {}
        new = {t for tokens in cut for t in tokens} - self.known.keys()
        coded = sorted((t.encode(), t) for t in new)
        short = [x for x in coded if len(x[0]) <= TRIE_BYTES and b"\0" not in x[0]]
        for at in range(0, len(short), 50_000):
            part = short[at : at + 50_000]
            self.known.update(zip((t for _, t in part), self.v.counts([b for b, _ in part]).tolist(), strict=True))
        self.known.update((t, self.v.plain(b)) for b, t in coded if len(b) > TRIE_BYTES or b"\0" in b)
        get = self.known.__getitem__
        return [len(c) for c in cut], [sum(map(get, c)) for c in cut]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id, n_pretokens and n_tokens of each row.

    Null and empty texts have none; texts of any length are cut whole. Ids may be null; rows that repeat an id or a text come back
    as often; other columns, whatever their names, are ignored; an empty table gives no rows. Equal scores go to fewer pieces.
    A pre-token without a break may be of any length; the time that it takes is in proportion to it.
    The vocabulary, some hundred thousand lines at most, is broadcast: a path is one of the driver's, a URI is read by Spark.
    """
    spark = docs.sparkSession
    if "://" in vocabulary:
        lines = [r[0] for r in spark.read.text(vocabulary).collect()]
    else:
        with open(vocabulary, encoding="ascii") as f:
            lines = f.read().splitlines()
    shared = spark.sparkContext.broadcast(lines)

    def rows(batches):
        count = Counter(Vocabulary(shared.value))
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                n, tokens = count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(tokens, pa.int64())], names=[id_col, "n_pretokens", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(rows, f"`{id_col}` long, n_pretokens long, n_tokens long")
