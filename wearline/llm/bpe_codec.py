"""BPE encoding and decoding with content-defined chunks that are reused.

Chunk borders follow a rolling hash of the last eight characters, so a passage
that documents share is cut alike in all of them. A chunk is encoded once, as
it stands: its first and last word may be cut through. Chunks met a second time
are kept by their text, up to ``CACHE_BYTES`` a worker, across documents and
slices of a task (a first meeting leaves only a hash).

A border may split a word, so the ids around it are provisional. The join is
repaired by re-encoding: what stands between the nearest blanks left and right
of the border, with one more word on either side, is encoded as one text. If
its ids begin and end with those that the two chunks have for the outer words,
the middle ids replace the provisional ones; if not, the window grows by a
word on either side until they agree, or it holds the text.

A chunk's own ids come word by word from a bounded word cache (the tokenizer's
pre-tokens never hold a blank, and letters never join a following full stop or
comma; both are checked when the vocabulary is loaded).

Defined results: null text counts as empty (no ids, empty decoded text); any
column may be null; repeated rows give repeated results; an empty table gives
no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, pick

#: A border about every so many characters (a power of two).
CHUNK_CHARS = 512
#: Bytes of chunks (texts and ids), hashes of chunks met once, and words that a
#: Python worker keeps during a task.
CACHE_BYTES, CACHE_SEEN, CACHE_WORDS = 24 << 20, 500_000, 250_000
#: Bytes of text encoded at once; strings in one call of the library.
SLICE_BYTES, CALL = 2 << 20, 64
BASE = np.uint32(0x01000193)
SPREAD = np.uint32(0x9E3779B1)
STOP = re.compile("(?<=[a-z])(?=[.,])")


class ChunkCodec:
    """Encoder whose pieces are cached; ``decode`` follows the vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        spec = json.loads(self.lib.to_str())
        if spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("only vocabularies without decoder and post-processor are supported")
        probe = ["a", "é", "1", "'s", ",", "́", "<|endoftext|>", "Ab", "x."]
        for text in ("ab.", "ab,", "ab..", "ab.5", "ab,cd", "ab.cd", "'s.", "x,.y"):  # STOP never cuts through a pre-token
            parts = [i for w in STOP.sub(" ", text).split(" ") for i in self.lib.encode(w, add_special_tokens=False).ids]
            if self.lib.encode(text, add_special_tokens=False).ids != parts:
                raise ValueError("letters and following stops share pre-tokens")
        for gap in (" ", "\n"):
            whole = self.lib.encode(gap.join(probe), add_special_tokens=False).ids
            if whole != [i for w in probe for i in self.lib.encode(w, add_special_tokens=False).ids]:
                raise ValueError("pre-tokens hold blanks: chunk joins could not be repaired at them")
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.token = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.token[i] = t.encode()
        self.ends_word = np.array([t.endswith(b"</w>") for t in self.token])
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, tuple] = {}  # text -> (ids, bytes of the first word's ids, of the last word's)
        self.seen: set[int] = set()
        self.held = 0
        self.met = self.reused = 0

    def forget(self) -> None:
        """Empty all caches."""
        self.words.clear()
        self.chunks.clear()
        self.seen.clear()
        self.held = 0

    def chunked(self, text: str) -> list[str]:
        """Content-defined chunks of a text, in order."""
        if len(text) < CHUNK_CHARS:
            return [text]
        c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        h = c * SPREAD
        for step in (1, 2, 4):
            shifted = h[:-step] * np.uint32(pow(int(BASE), step, 1 << 32))
            h = h[step:] + shifted
        cuts = np.flatnonzero((h * SPREAD) >> np.uint32(16) & np.uint32(CHUNK_CHARS - 1) == 0) + 7
        edges = [0, *cuts[(cuts > 0) & (cuts < len(text))].tolist(), len(text)]
        return [text[a:b] for a, b in zip(edges, edges[1:])]

    def units(self, piece: str) -> list[str]:
        """Stretches of a piece that the tokenizer never joins: cut at blanks and
        between a letter and a full stop or comma; case is folded as the tokenizer
        does itself where a piece is pure ASCII (not where a special token might
        arise). Elsewhere the tokenizer composes first: a small letter may have a
        composed form that its capital lacks."""
        if piece.isascii() and "<|" not in piece:
            piece = piece.lower()
        return STOP.sub(" ", piece.replace("\n", " ")).split(" ")

    def _learn(self, units: set[str]) -> None:
        """Encode units not seen before: plain words many at a time (each ends
        with one word-end token, which is counted), others one by one."""
        fresh = [u for u in units if u not in self.words]
        if len(self.words) + len(fresh) > CACHE_WORDS:
            self.words.clear()
            fresh = list(units)
        plain = [u for u in fresh if u.isalpha()]
        other = [u for u in fresh if not u.isalpha()]
        groups = [plain[i:i + 128] for i in range(0, len(plain), 128)]
        for group, e in zip(groups, self._call([" ".join(g) for g in groups])):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(group):
                other += group
                continue
            raw, at = ids.tobytes(), [0, *(ends * 4).tolist()]
            self.words.update(zip(group, [raw[a:b] for a, b in zip(at, at[1:])]))
        self.words.update(zip(other, [np.array(e.ids, dtype="<u4").tobytes() for e in self._call(other)]))

    def _call(self, texts: list[str]) -> Iterator:
        for i in range(0, len(texts), CALL):
            yield from self.lib.encode_batch_fast(texts[i:i + CALL], add_special_tokens=False)

    def decode(self, ids: bytes) -> bytes:
        """Decoded text of little-endian uint32 ids: their tokens joined by a space."""
        return b" ".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def word_ids(self, word: str) -> bytes:
        """A whole word's ids, as the chunk beside it has them."""
        units = self.units(word)
        if any(u not in self.words for u in units):
            self._learn(set(units))
        return b"".join(map(self.words.__getitem__, units))

    def _encoded(self, chunks: list[str]) -> dict[str, tuple]:
        """Each chunk's ids as it stands, and the bytes of its first and last word's;
        the first and last word end at a blank (none: the chunk is one word)."""
        fresh = {c for c in chunks if c not in self.chunks}
        self.met += len(chunks)
        self.reused += len(chunks) - len(fresh)
        units = {}
        for c in fresh:
            i, j = first_blank(c), last_blank(c)
            units[c] = self.units(c), self.units(c[:i]) if i >= 0 else None, self.units(c[j + 1:]) if i >= 0 else None
        self._learn({u for us in units.values() for part in us if part for u in part})
        word, made = self.words.__getitem__, {}
        for c, (us, first, last) in units.items():
            whole = b"".join(map(word, us))
            one = (whole, len(whole), len(whole)) if first is None else (
                whole, sum(len(word(u)) for u in first), sum(len(word(u)) for u in last))
            made[c] = one
            h = hash(c)
            if h in self.seen:  # met in another slice: worth keeping
                size = 4 * len(c) + len(one[0]) + 200
                if size > CACHE_BYTES:  # larger than the whole cache
                    continue
                if self.held + size > CACHE_BYTES:
                    self.chunks.clear()
                    self.held = 0
                self.chunks[c] = one
                self.held += size
            else:
                if len(self.seen) >= CACHE_SEEN:
                    self.seen.clear()
                self.seen.add(h)
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        parts = [self.chunked(t) if t else [] for t in texts]
        known = dict(self.chunks)
        made = self._encoded([c for ps in parts for c in ps])
        joins = [Join(ps, k) for ps in parts for k in range(1, len(ps)) if _owns(ps, k)]
        # re-encode windows around all joins at once; those that disagree grow by a word a side
        todo = joins
        while todo:
            for join, e in zip(todo, self._call([j.window() for j in todo])):
                join.settle(np.array(e.ids, dtype="<u4").tobytes(), self)
            todo = [j for j in todo if j.ids is None]
        fixed = iter(joins)
        out = []
        for ps in parts:
            got = [made[c] if c in made else known[c] for c in ps]
            ids = []
            for k, (c, (whole, head, tail)) in enumerate(zip(ps, got)):
                if k and _owns(ps, k):
                    ids.append(next(fixed).ids)
                one = first_blank(c) < 0
                lo = head if k else 0
                hi = len(whole) - tail if k + 1 < len(ps) else len(whole)
                if not (one and (k or k + 1 < len(ps))):  # a chunk within one word lies inside joins
                    ids.append(whole[lo:hi])
            out.append(b"".join(ids))
        return out





def first_blank(text: str) -> int:
    i, j = text.find(" "), text.find("\n")
    return i if j < 0 else j if i < 0 else min(i, j)


def last_blank(text: str) -> int:
    return max(text.rfind(" "), text.rfind("\n"))


def _owns(chunks: list[str], k: int) -> bool:
    """Whether the join before chunk k is the first of the word it lies in."""
    return k == 1 or first_blank(chunks[k - 1]) >= 0


class Join:
    """The border before chunk k: the word it lies in, and the window around it."""

    def __init__(self, chunks: list[str], k: int):
        end = k
        while end + 1 < len(chunks) and first_blank(chunks[end]) < 0:
            end += 1
        left, right = chunks[k - 1], chunks[k] if end == k else "".join(chunks[k:end + 1])
        i, j = last_blank(left), first_blank(right)
        self.left, self.right = left[:max(i, 0)], right[j + 1:] if j >= 0 else ""
        self.word = left[i + 1:] + (right[:j] if j >= 0 else right)
        # a chunk's own first or last word may be cut: beyond the text's ends the outermost stay out
        self.cut_left, self.cut_right = k > 1, end + 1 < len(chunks)
        self.reach, self.before, self.after, self.all = 0, [], [], False
        self.ids: bytes | None = None
        self.grow()

    def grow(self) -> None:
        """One more whole word on either side, as far as the chunks go."""
        self.reach += 1
        before = self.left.replace("\n", " ").rsplit(" ", self.reach) if self.left else []
        after = self.right.replace("\n", " ").split(" ", self.reach) if self.right else []
        rest_left, rest_right = len(before) > self.reach, len(after) > self.reach
        self.before = before[1:] if before and (rest_left or self.cut_left) else before
        self.after = after[:-1] if after and (rest_right or self.cut_right) else after
        self.all = not rest_left and not rest_right

    def window(self) -> str:
        return " ".join([*self.before, self.word, *self.after])

    def settle(self, ids: bytes, codec: "ChunkCodec") -> None:
        """Takes the window's middle ids if its outer ids are those of the chunks."""
        left, right = (b"".join([codec.word_ids(w) for w in side]) for side in (self.before, self.after))
        if ids.startswith(left) and ids.endswith(right) and len(ids) >= len(left) + len(right):
            self.ids = ids[len(left):len(ids) - len(right)]
        elif self.all:
            raise ValueError("ids depend on words beyond the chunks beside a join")
        else:
            self.grow()


@lru_cache(maxsize=2)
def codec(path: str) -> ChunkCodec:
    return ChunkCodec(path)


def encode_decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids binary, decoded string) of every row: ``ids`` are
    little-endian unsigned 32-bit integers; see the module text."""

    def run(cols: dict) -> dict:
        got = codec(vocab_path).encode([t or "" for t in cols["text"]])
        return {"doc_id": cols["doc_id"], "n_tokens": [len(g) // 4 for g in got],
                "ids": got, "decoded": [codec(vocab_path).decode(g).decode() for g in got]}

    def forget() -> None:
        codec(vocab_path).forget()

    src = pick(df, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    return map_rows(src, run, f"doc_id {kind}, n_tokens long, ids binary, decoded string", SLICE_BYTES, after=forget)
