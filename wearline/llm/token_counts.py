"""Token counts by rank-synchronous array merging.

A text is cut into pre-tokens that no merge can cross (the vocabulary has no
piece with a word-start mark after another character, which is checked). The
distinct pre-tokens of a slice lie in one ragged numpy array; every round
finds each sequence's lowest-rank pair (leftmost on ties), applies it in all
sequences at once and closes the gaps. A sequence without a mergeable pair
leaves the array and its surviving symbols are counted; a symbol that is no
piece counts one token per UTF-8 byte.

Defined results: null text counts as empty (0 bytes, 0 tokens); any column may
be null; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, pick

MARK = "▁"
#: A pre-token with more symbols is merged with a heap (same order, n log n).
LONG = 2048
#: Distinct pre-tokens whose counts a Python worker keeps between slices.
CACHE_ENTRIES = 400_000
NEVER = np.int64(1) << 30


class PieceMerger:
    """Merge table of a byte-fallback piece model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = {sp.id_to_piece(i): i for i in range(n)
                 if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in plain):
            raise ValueError("a piece crosses a word start: pre-tokens would not be independent")
        if sp.normalize(" AＡ ") != f"{MARK}{MARK}AＡ{MARK}":
            raise ValueError("the model normalises texts in a way this operator does not")
        self.base = n
        self.symbol = np.arange(0x110000, dtype=np.int64) + n
        for piece, i in plain.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain.values()}, reverse=True))}
        keys, ranks, into = [], [], []
        for piece, i in plain.items():
            for cut in range(1, len(piece)):
                left, right = self._id(plain, piece[:cut]), self._id(plain, piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 21 | right)
                    ranks.append(order[sp.get_score(i)])
                    into.append(i)
        by = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[by]
        self.ranks = np.array(ranks, dtype=np.int64)[by]
        self.into = np.array(into, dtype=np.int64)[by]
        self.cache: dict[str, int] = {}

    def _id(self, plain: dict[str, int], s: str) -> int | None:
        return int(self.symbol[ord(s)]) if len(s) == 1 else plain.get(s)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; rank NEVER where no piece results."""
        key = left << 21 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NEVER), self.into[at]

    def cost(self, sym: np.ndarray) -> np.ndarray:
        """Tokens of final symbols: 1, or the UTF-8 length of an unknown character."""
        point = sym - self.base
        return np.where(point < 0, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))

    def count(self, words: list[str]) -> np.ndarray:
        """Token count of each pre-token."""
        out = np.zeros(len(words), dtype=np.int64)
        lens = np.array([len(w) for w in words], dtype=np.int64)
        for i in np.flatnonzero(lens > LONG):
            out[i] = self._count_long(words[i])
        live = np.flatnonzero((lens > 0) & (lens <= LONG))
        if not len(live):
            return out
        flat = np.frombuffer("".join(words[i] for i in live).encode("utf-32-le"), dtype=np.uint32)
        sym, lens = self.symbol[flat], lens[live]
        starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        rank = np.full(len(sym), NEVER, dtype=np.int64)
        if len(sym) > 1:
            rank[:-1] = self.lookup(sym[:-1], sym[1:])[0]
        rank[starts + lens - 1] = NEVER
        while len(live):
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            more = best < NEVER << 32
            if not more.all():
                done = ~more
                out[live[done]] = np.add.reduceat(self.cost(sym), starts)[done]
                keep = np.repeat(more, lens)
                gone = np.cumsum(np.where(done, lens, 0))[more]
                sym, rank, live, lens = sym[keep], rank[keep], live[more], lens[more]
                at = (best[more] & 0xFFFFFFFF) - gone
                starts = starts[more] - gone
                if not len(live):
                    break
            else:
                at = best & 0xFFFFFFFF
            sym[at] = self.lookup(sym[at], sym[at + 1])[1]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, rank = sym[keep], rank[keep]
            shift = np.arange(len(live))
            at, starts, lens = at - shift, starts - shift, lens - 1
            last = at == starts + lens - 1
            rank[at] = np.where(last, NEVER, self.lookup(sym[at], sym[np.where(last, at, at + 1)])[0])
            before = at[at > starts] - 1
            rank[before] = self.lookup(sym[before], sym[before + 1])[0]
        return out

    def _count_long(self, word: str) -> int:
        """The same merges in the same order for one long sequence, by a heap."""
        sym = self.symbol[np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)]
        ranks = self.lookup(sym[:-1], sym[1:])[0]
        heap = [(int(ranks[i]), int(i)) for i in np.flatnonzero(ranks < NEVER)]
        heapq.heapify(heap)
        s = sym.tolist()
        nxt, prv = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        pair = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.into.tolist())))
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i]
            if s[i] < 0 or j >= len(s) or pair.get(s[i] << 21 | s[j], (-1,))[0] != r:
                continue
            s[i], s[j] = pair[s[i] << 21 | s[j]][1], -1
            nxt[i] = nxt[j]
            if nxt[i] < len(s):
                prv[nxt[i]] = i
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b < len(s) and (hit := pair.get(s[a] << 21 | s[b])):
                    heapq.heappush(heap, (hit[0], a))
        return int(self.cost(np.array([x for x in s if x >= 0], dtype=np.int64)).sum())

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts; the distinct pre-tokens of all are merged together."""
        parts = [PRE_TOKEN.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = list(set().union(*parts).difference(self.cache))
        if len(self.cache) + len(fresh) > CACHE_ENTRIES:
            self.cache.clear()
            fresh = list(set().union(*parts))
        self.cache.update(zip(fresh, self.count(fresh).tolist()))
        got = self.cache.__getitem__
        return [sum(map(got, p)) for p in parts]


PRE_TOKEN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@lru_cache(maxsize=2)
def merger(path: str) -> PieceMerger:
    return PieceMerger(path)


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; see the module text."""

    def run(cols: dict) -> dict:
        texts = [t or "" for t in cols["text"]]
        n = merger(model_path).count_texts(texts)
        return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": n, "over_limit": [x > limit for x in n]}

    src = pick(df, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    return map_rows(src, run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
