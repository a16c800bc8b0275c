"""Secret scans with a linear-chain conditional random field.

Base spans come from three fixed patterns. A chain CRF tags words as secret
begin, inside or outside and adds spans of kind ``crf``; base spans always
stay. Features of a word: shape, length, share of digits, distinct characters,
key words in it and in its neighbours, neighbouring shapes, and features of
the whole text (share of digits, assignments, lines). Decoding is Viterbi.

Every word of every text has features of its own and is decoded, whatever it holds.
Those of *marked* words (a digit, one of ``=_+``, or a key word) and of plain ones have
different names (``plain:``): the weights of the first are fitted on chains around marked words, those of the
second after them, on all chains. What a word adds to its own scores and to those of its neighbours is computed once and
kept (at most ``WORDS`` words a task); paths are found for many texts at once, in
blocks of ``BLOCK`` words that are then joined, so a text's tags are those of one
Viterbi pass over all of its words.

The model is fitted in each run, on the base spans of a bounded sample: the
words of at most ``TRAIN_DOCS`` distinct documents, those of
least hash of id and text (so rows without an id, or with one repeated id, are
sampled like any others), cut into successive chains of ``REGION`` words. Of chains around
marked words the ``TRAIN_CHAINS`` of least hash are taken, of those between them the ``TRAIN_PLAIN`` of least hash, from anywhere in a text. In half of
them what leads to a secret (``token =``) is taken out, so that the model learns what
secrets look like and not only what stands before them. A tenth is held out, with
its secrets alone too; on it the lead that the state "outside" needs is raised until ``PRECISION`` of the tagged
words are secrets. Scanning covers all rows and whole texts.

Defined results: null text counts as empty (no spans); offsets are code
points, end exclusive; any other column may be null; repeated rows give
repeated results; an empty table gives no rows; a sample without any base
span adds no span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, released, slices, stored

# ---- fixed values: the base patterns, key words and kinds ----
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
# ---------------------------------------------------------------

#: The sample (at most (TRAIN_CHAINS + TRAIN_PLAIN) * REGION words), and the training.
TRAIN_DOCS, TRAIN_CHAINS, TRAIN_PLAIN, REGION = 6000, 4000, 1000, 48
STEPS, RATE, DECAY = 80, 0.3, 1e-3
#: One chain in so many is held out.
HELD_OUT = 10
#: Chains whose gradient is computed at once.
SLICE = 256
#: Share of held-out tagged words that must be secrets; leads of "outside" that are tried.
PRECISION, LEADS = 0.99, [0.5 * i for i in range(25)]
KEY = re.compile("password|passwd|secret|token|api_?key", re.I | re.A)
NEAR = 2
#: Words whose scores a task keeps, words of a block of a path, bytes of text decoded at once.
WORDS, BLOCK, TEXT_BYTES = 1 << 18, 64, 4 << 20
#: Start of the names of plain words' features; places of the neighbours that a word sees.
PLAIN = "plain:"
STEPS_NEAR = (-2, -1, 1)
OUT, BEGIN, IN = 0, 1, 2
SPACE = np.zeros(128, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
MARKED = np.zeros(128, dtype=bool)
MARKED[[ord(c) for c in "0123456789=_+"]] = True
FOLD = str.maketrans({**{c: "A" for c in map(chr, range(65, 91))}, **{c: "a" for c in map(chr, range(97, 123))},
                      **{c: "9" for c in "0123456789"}})
RUNS = re.compile(r"(.)\1+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three patterns, by start, then kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


WORD = re.compile("[^ \\t\\n\\v\\f\\r]+")
ALNUM = re.compile("[A-Za-z0-9]+")
SWITCH = re.compile("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")


def word_features(word: str) -> list[str]:
    digits = sum(c in "0123456789" for c in word)
    run = max(ALNUM.findall(word), key=len, default="")
    random = f"run={min(len(run) // 8, 4)}", f"switch={min(len(SWITCH.findall(run)) // 2, 4)}"
    return [*random, "&".join(random), "shape=" + RUNS.sub(r"\1", word.translate(FOLD))[:10], f"len={min(len(word) // 4, 12)}",
            f"digits={digits * 4 // max(1, len(word))}", f"distinct={min(len(set(word)) // 3, 8)}",
            "key" if KEY.search(word) else "nokey", "sep" if word[-1:] in "=:" else "nosep"]


def spread(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Starts and ends of a text's words, its marked characters, and the text's features."""
    c = np.minimum(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), 127)
    at = np.flatnonzero(MARKED[c])
    edge = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[c], [True])).astype(np.int8)))
    whole = [f"share={min(len(at) * 200 // max(1, len(text)), 8)}", f"assigns={min(text.count('='), 3)}",
             f"lines={min(text.count(chr(10)), 40) // 8}"]
    return edge[::2], edge[1::2], at, whole


def stretches(text: str) -> tuple[list[tuple[bool, list[tuple[int, int]]]], list[str]]:
    """All words (start, end) in order, cut into runs around marked words (True) and the
    runs between them (False); and the text's features."""
    starts, ends, at, whole = spread(text)
    keys = np.array([m.start() for m in KEY.finditer(text)], dtype=np.int64)
    near = np.zeros(len(starts) + 2 * NEAR, dtype=bool)
    hit = np.unique(np.searchsorted(starts, np.concatenate((at, keys)), "right") - 1)
    for step in range(2 * NEAR + 1):
        near[hit + step] = True
    near = near[NEAR:NEAR + len(starts)]
    words = list(zip(starts.tolist(), ends.tolist()))
    cuts = [0, *(np.flatnonzero(near[1:] != near[:-1]) + 1).tolist(), len(words)] if words else [0]
    return [(bool(near[a]), words[a:b]) for a, b in zip(cuts, cuts[1:])], whole


def regions(text: str) -> tuple[list[list[tuple[int, int]]], list[str]]:
    """Runs of words (start, end) that make up the text, and the text's features."""
    runs, whole = stretches(text)
    return [words for _, words in runs], whole


def is_marked(word: str) -> bool:
    return any(ch in "0123456789=_+" for ch in word) or KEY.search(word) is not None


def word_parts(word: str) -> tuple[bool, list[str], list[list[str]]]:
    """Whether a word is marked, the features it gives to itself, and to the words that see it at each of ``STEPS_NEAR``."""
    marked, own = is_marked(word), word_features(word)
    seen = [x for x in own if not x.startswith(("len", "distinct", "run", "switch"))]
    kind = "" if marked else PLAIN
    return marked, ["marked" if marked else "plain", *[kind + x for x in own]], [[f"{kind}{step}:{x}" for x in seen] for step in STEPS_NEAR]


def text_parts(whole: list[str]) -> tuple[list[str], list[str]]:
    """Features that a text gives to its plain words, and to its marked ones."""
    return [PLAIN + x for x in whole], whole


def features_of(words: list[str], whole: list[str]) -> list[list[str]]:
    """Features of each word of a chain; a marked word sees its marked neighbours, a plain one all."""
    known = {w: word_parts(w) for w in set(words)}
    about = text_parts(whole)
    out = []
    for i, w in enumerate(words):
        marked, own, _ = known[w]
        f = [*own, *about[marked]]
        for k, step in enumerate(STEPS_NEAR):
            if 0 <= i + step < len(words):
                other, _, seen = known[words[i + step]]
                if other or not marked:
                    f += seen[k]
        out.append(f)
    return out


def chain_features(text: str, words: list[tuple[int, int]], whole: list[str]) -> list[list[str]]:
    """Features of each word of a run of a text."""
    return features_of([text[a:b] for a, b in words], whole)


def gold(words: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """Tags of words from spans: the first word of a span begins it."""
    tags, last = [], None
    for a, b in words:
        hit = next((k for k, (_, s, e) in enumerate(spans) if s < b and a < e), None)
        tags.append(OUT if hit is None else IN if hit == last else BEGIN)
        last = hit
    return tags


def hidden(text: str, words: list[tuple[int, int]], spans: list[tuple[str, int, int]],
           whole: list[str]) -> tuple[list[tuple[int, int]], list[int], list[str]]:
    """(words, tags, text's features) of a chain whose secrets stand alone: the words that lead to
    them (``token =``) are taken out, and with them what tells of assignments."""
    values, lead = [], []
    for kind, a, b in spans:
        at = ASSIGN.match(text, a).start(2) if kind == "assign" else a
        lead.append((a, at))
        values.append((kind, at, b))
    left = [(a, b) for a, b in words if not any(s <= a and b <= e for s, e in lead)]
    values = [v for i, v in enumerate(values) if not any(v[1] < w[2] and w[1] < v[2] for w in values[:i])]
    return left, gold(left, values), ["assigns=0" if x.startswith("assigns=") else x for x in whole]


def keyless(feats: list[list[str]]) -> list[list[str]]:
    """Features as if no word held a key word."""
    return [[x[:-3] + "nokey" if x == "key" or x.endswith(":key") else x for x in f] for f in feats]


class Chain:
    """CRF weights: ``emit`` (features x 3), ``step`` (3 x 3, from x to)."""

    BANNED = np.array([[0, 0, -1e4], [0, 0, 0], [0, 0, 0]])  # outside -> inside
    FIRST = np.array([0, 0, -1e4])

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray, lead: float = 0.0):
        self.names, self.emit, self.step, self.lead = names, emit, step, lead
        self.reader = Reader(self)

    def __reduce__(self):
        return Chain, (self.names, self.emit, self.step, self.lead)

    @classmethod
    def fit(cls, chains: list[tuple[list[list[str]], list[int]]]) -> "Chain":
        """Penalised maximum likelihood by Adam, all sequences at once: first on the chains around
        marked words, then what plain words add to it, on all."""
        names: dict[str, int] = {"plain": 0}
        for feats, _ in chains:
            for f in feats:
                for x in f:
                    names.setdefault(x, len(names))
        emit, step = np.zeros((len(names) + 1, 3)), cls.BANNED.copy()
        if not any(t for _, tags in chains for t in tags):
            emit[:, OUT] = 1.0  # nothing to learn from: always outside
            return cls(names, emit, step)
        # chains of like length share a slice, words lie one after the other
        around = sorted((c for c in chains if any("marked" in f for f in c[0])), key=lambda c: len(c[1]))
        chains = sorted(chains, key=lambda c: len(c[1]))
        of_plain = np.array([x.startswith(PLAIN) for x in names] + [False])
        emit, step = cls._climbed(emit, step, around, names, ~of_plain, True, len(around))
        emit, step = cls._climbed(emit, step, chains, names, of_plain, False, len(around))
        return cls(names, emit, step)

    @classmethod
    def _climbed(cls, emit, step, chains, names, free, free_step, n):
        """The weights after ``STEPS`` steps of Adam: those of ``free`` features, and of the
        transitions if ``free_step``; a feature that is not free yet stays where it is."""
        parts = [cls._packed(chains[at:at + SLICE], names) for at in range(0, len(chains), SLICE)]
        mean = [np.zeros_like(emit), np.zeros_like(step)]
        var = [np.zeros_like(emit), np.zeros_like(step)]
        for t in range(1, STEPS + 1):
            grads = [np.zeros_like(emit), np.zeros_like(step)]
            for part in parts:
                for g, more in zip(grads, cls._gradient(emit, step, *part)):
                    g += more
            grads[0][~free] = 0.0
            grads[1] *= free_step
            for k, (w, g, may) in enumerate(zip((emit, step), grads, (free[:, None], free_step))):
                g = g - DECAY * n * w * (np.abs(w) < 1e3) * may
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.99 * var[k] + 0.01 * g * g
                w += RATE * (mean[k] / (1 - 0.9 ** t)) / (np.sqrt(var[k] / (1 - 0.99 ** t)) + 1e-8)
            emit[-1] = 0
            step[OUT, IN] = -1e4
        return emit, step

    @staticmethod
    def _packed(chains, names):
        """(feature numbers: slot x word, tags, which cells hold words) of some chains."""
        slots = max((len(f) for feats, _ in chains for f in feats), default=1)
        rows = [f for feats, _ in chains for f in feats]
        index = np.full((len(rows), slots), len(names), dtype=np.int32)
        for row, f in zip(index, rows):
            row[:len(f)] = [names[x] for x in f]
        tags = np.zeros((len(chains), max(1, *(len(t) for _, t in chains))), dtype=np.int64)
        real = np.zeros(tags.shape, dtype=bool)
        for i, (_, tag) in enumerate(chains):
            real[i, :len(tag)], tags[i, :len(tag)] = True, tag
        return np.ascontiguousarray(index.T), tags, real

    @classmethod
    def _gradient(cls, emit, step, index, tags, real):
        """Observed minus expected feature counts (forward-backward)."""
        width = real.shape[1]
        score = np.zeros((*real.shape, 3))
        score[real] = np.stack([emit[:, s][index].sum(axis=0) for s in range(3)], axis=1)
        score[:, 0] += cls.FIRST
        score = np.where(real[:, :, None], score, np.array([0.0, -1e4, -1e4]))  # padding stays outside
        fwd, bwd = np.empty_like(score), np.zeros_like(score)
        fwd[:, 0] = score[:, 0]
        for i in range(1, width):
            free = np.where(real[:, i, None, None], step, 0.0)
            fwd[:, i] = _logsum(fwd[:, i - 1, :, None] + free, 1) + score[:, i]
        for i in range(width - 2, -1, -1):
            free = np.where(real[:, i + 1, None, None], step, 0.0)
            bwd[:, i] = _logsum(free + (score[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
        total = _logsum(fwd[:, -1], 1)
        seen = np.eye(3)[tags]
        node = (seen - np.exp(fwd + bwd - total[:, None, None])) * real[:, :, None]
        node, at = node[real], index.ravel()
        grad_emit = np.stack([np.bincount(at, np.tile(node[:, s], len(index)), len(emit)) for s in range(3)], axis=1)
        both = real[:, 1:] & real[:, :-1]
        pair = np.exp(fwd[:, :-1, :, None] + step + (score[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None])
        want = seen[:, :-1, :, None] * seen[:, 1:, None, :]
        grad_step = ((want - pair) * both[:, :, None, None]).sum(axis=(0, 1))
        return grad_emit, grad_step

    def tuned(self, chains: list[tuple[list[list[str]], list[int]]]) -> "Chain":
        """The least lead of "outside" at which ``PRECISION`` of the words tagged in
        the chains are secrets (the largest, if none is enough)."""
        scores = [self.scores(feats) for feats, _ in chains]
        truth = np.array([g for _, gold_ in chains for g in gold_], dtype=np.int64)
        for self.lead in LEADS:
            tagged = self.paths(np.concatenate([np.zeros((0, 3)), *scores]), [len(x) for x in scores]) != OUT
            if (truth[tagged] != OUT).sum() >= PRECISION * tagged.sum():
                break
        return self

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        """Scores (word, state) of words with these features."""
        get, blank = self.names.get, len(self.names)
        return np.array([self.emit[[get(x, blank) for x in f]].sum(axis=0) for f in feats]).reshape(-1, 3)

    def paths(self, scores: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Viterbi tags of sequences that lie one after the other in ``scores``.

        Sequences are cut into blocks. The best way through a block from each state
        before it to each state at its end gives the scores with which every block
        is entered; with them all blocks are decoded side by side, and their ends are
        joined from the last to the first. Rows after a sequence's end are outside."""
        size = np.asarray(lengths, dtype=np.int64)
        if not size.sum():
            return np.zeros(0, dtype=np.int8)
        order = np.argsort(-size, kind="stable")
        count = size // BLOCK + 1
        head = np.cumsum(count) - count                       # first block of each sequence
        n = int(count.sum())
        place = np.arange(len(scores)) + np.repeat(head * BLOCK - (np.cumsum(size) - size), size)
        e = np.full((n * BLOCK, 3), -1e9)
        e[:, OUT] = 0.0
        e[place] = scores
        e[place, OUT] += self.lead
        e = np.ascontiguousarray(e.reshape(n, BLOCK, 3).transpose(1, 2, 0))   # row, state, block
        first = np.zeros(n, dtype=bool)
        first[head] = True
        step = self.step

        def best(now, to):
            return np.maximum(np.maximum(now[0] + step[0, to], now[1] + step[1, to]), now[2] + step[2, to])

        # best scores from each state before a block (second index) to each at its end
        through = np.stack([np.where(first, self.FIRST[to], step[:, to, None]) + e[0, to] for to in range(3)])
        for t in range(1, BLOCK):
            through = np.stack([best(through, to) + e[t, to] for to in range(3)])
        enter = np.zeros((3, n))
        for j in range(1, int(count.max())):
            at = head[order[:np.searchsorted(-count[order], -j, "left")]] + j
            enter[:, at] = (enter[:, at - 1] + through[:, :, at - 1]).max(axis=1)
        # the same with the scores of each block's start, and where each best score came from
        came = np.empty((BLOCK, 3, n), dtype=np.int8)
        now = enter
        for t in range(BLOCK):
            new = []
            for to in range(3):
                a, b, c = now[0] + step[0, to], now[1] + step[1, to], now[2] + step[2, to]
                top = np.maximum(a, b)
                came[t, to] = np.where(c > top, 2, b > a)
                top = np.maximum(top, c)
                new.append((np.where(first, self.FIRST[to], top) if not t else top) + e[t, to])
            now = np.stack(new)
        tags = np.empty((BLOCK, 3, n), dtype=np.int8)         # of each state at the block's end
        at, blocks = np.repeat(np.arange(3, dtype=np.int8)[:, None], n, axis=1), np.arange(n)
        for t in range(BLOCK - 1, -1, -1):
            tags[t] = at
            at = came[t][at, blocks]
        end = np.zeros(n, dtype=np.int8)                      # a sequence's last block ends outside
        for j in range(int(count.max()) - 1, 0, -1):
            k = head[order[:np.searchsorted(-count[order], -j, "left")]] + j
            end[k - 1] = at[end[k], k]
        return tags[:, end, blocks].T.reshape(-1)[place]

    def decode(self, feats: list[list[str]]) -> list[int]:
        """Viterbi tags of one region."""
        get, blank = self.names.get, len(self.names)
        best, back = self.FIRST.astype(np.float64), []
        for i, f in enumerate(feats):
            e = self.emit[[get(x, blank) for x in f]].sum(axis=0)
            if i:
                moves = best[:, None] + self.step
                back.append(moves.argmax(axis=0))
                best = moves.max(axis=0)
            best = best + e
            best[OUT] += self.lead
        tags = [int((best + self.step[:, OUT]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def looks(word: str) -> tuple[str, int, bool]:
    """All that a word's features depend on: many words look alike."""
    low = word.lower()
    key = ("pass" in low or "secret" in low or "token" in low or "api" in low) and KEY.search(word) is not None
    return word.translate(FOLD), min(len(set(word)) // 3, 8), key


class Reader:
    """Scores of the words of texts; what each kind of word adds is kept."""

    def __init__(self, model: Chain):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}                # word -> row of its looks
        self.rows: dict[tuple[str, int, bool], int] = {}
        # a word's part for itself and for those that see it, and whether it is marked (row 0: no word)
        self.table, self.marked = np.zeros((1024, 1 + len(STEPS_NEAR), 3)), np.zeros(1024, dtype=bool)

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.ids]
        if len(self.ids) + len(fresh) > WORDS:
            self.forget()
            fresh = list(words)
        get, blank, emit = self.model.names.get, len(self.model.names), self.model.emit
        for w in fresh:
            look = looks(w)
            k = self.rows.get(look)
            if k is None:
                self.rows[look] = k = len(self.rows) + 1
                if k == len(self.table):
                    self.table = np.concatenate((self.table, np.zeros_like(self.table)))
                    self.marked = np.append(self.marked, np.zeros(len(self.marked), dtype=bool))
                self.marked[k], own, seen = word_parts(w)
                for i, part in enumerate((own, *seen)):
                    self.table[k, i] = emit[[get(x, blank) for x in part]].sum(axis=0)
            self.ids[w] = k

    def scores(self, texts: list[list[str]], wholes: list[list[str]]) -> np.ndarray:
        """Scores (word, state) of the words of texts, text after text."""
        self.learn(set().union(*texts))
        get, blank, pad = self.model.names.get, len(self.model.names), max(map(abs, STEPS_NEAR))
        size = np.array([len(t) for t in texts], dtype=np.int64)
        at = np.arange(size.sum()) + np.repeat(pad * np.arange(1, len(texts) + 1), size)
        ids = np.zeros(int(size.sum()) + pad * (len(texts) + 1), dtype=np.int32)
        ids[at] = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(texts)), np.int32, int(size.sum()))
        out, marked = self.table[ids[at], 0], self.marked[ids[at]]
        for k, step in enumerate(STEPS_NEAR):
            near = ids[at + step]
            out += self.table[np.where(marked & ~self.marked[near], 0, near), 1 + k]
        about = np.array([[self.model.emit[[get(x, blank) for x in part]].sum(axis=0) for part in text_parts(w)] for w in wholes])
        return out + about[np.repeat(np.arange(len(texts)), size), marked.astype(int)]


def scan_all(texts: list[str], model: Chain) -> list[list[tuple[str, int, int]]]:
    """Base spans and the model's further spans of each text, by start, then kind."""
    out = [base_spans(t) for t in texts]
    live = [i for i, t in enumerate(texts) if t]
    held, words, wholes = [], [], []
    for i in live:
        starts, ends, _, whole = spread(texts[i])
        held.append((starts, ends))
        words.append(WORD.findall(texts[i]))
        wholes.append(whole)
    if not any(words):
        return out
    size = [len(w) for w in words]
    tags = model.paths(model.reader.scores(words, wholes), size)
    hit = np.flatnonzero(tags)
    edge = np.cumsum(size)
    of = np.searchsorted(edge, hit, "right")
    found: dict[int, list[list[int]]] = {}
    last = -2
    for k, j, tag in zip(hit.tolist(), of.tolist(), tags[hit].tolist()):
        at = k - int(edge[j]) + size[j]
        starts, ends = held[j]
        if tag == BEGIN:
            found.setdefault(j, []).append([int(starts[at]), int(ends[at])])
            last = k
        elif last == k - 1 and j in found and at:
            found[j][-1][1] = int(ends[at])
            last = k
    for j, spans in found.items():
        text, base = texts[live[j]], out[live[j]]
        more = []
        for start, end in spans:
            while end > start and text[end - 1] in ".,;\"')":
                end -= 1
            if end > start and not any(s < end and start < e for _, s, e in base):
                more.append(("crf", start, end))
        out[live[j]] = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def scan(text: str, model: Chain) -> list[tuple[str, int, int]]:
    """Base spans and the model's further spans of one text."""
    return scan_all([text], model)[0]


def sampled(src: DataFrame) -> DataFrame:
    """At most ``TRAIN_DOCS`` distinct rows (doc_id, text) with text, those of least
    hash: the bound is found over hashes alone, then equal rows are collapsed."""
    keyed = src.where("text <> ''").withColumn("h", F.xxhash64("doc_id", "text"))
    last = keyed.select("h").distinct().orderBy("h").limit(TRAIN_DOCS).agg(F.max("h")).first()[0]
    return keyed.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).drop("h")


def _chains(src: DataFrame, upto: tuple[int, int] | None) -> DataFrame:
    """(plain, h, words, tags, whole, alone) of the sample's chains with a hash up to that of
    their kind in ``upto`` (around marked words, plain); without it ``plain`` and the hashes alone."""
    schema = [("plain", pa.bool_()), ("h", pa.int64())]
    if upto is not None:
        schema += [("words", pa.list_(pa.string())), ("tags", pa.list_(pa.int32())), ("whole", pa.list_(pa.string())), ("alone", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for seed, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                runs, whole = stretches(text)
                spans = base_spans(text) if runs and upto is not None else []
                parts = [(not marked, words[i:i + REGION]) for marked, words in runs for i in range(0, len(words), REGION)]
                numbered = (pair for kind in (False, True) for pair in enumerate(p for p in parts if p[0] == kind))
                for k, (plain, words) in numbered:
                    h = xxhash.xxh64_intdigest(f"{seed}:{'plain' * plain}{k}") >> 1
                    if upto is None:
                        rows.append((plain, h))
                    elif h <= upto[plain]:
                        some = [sp for sp in spans if sp[1] < words[-1][1] and words[0][0] < sp[2]]
                        alone = h % HELD_OUT == 0 or h % 2 == 1
                        kept, tags, told = hidden(text, words, some, whole) if alone else (words, gold(words, some), whole)
                        rows.append((plain, h, [text[a:b] for a, b in kept], tags, told, alone))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, (_, t) in enumerate(schema)],
                                             names=[n for n, _ in schema])

    more = ", words array<string>, tags array<int>, whole array<string>, alone boolean" if upto is not None else ""
    return src.mapInArrow(released(run), "plain boolean, h long" + more)


def training_chains(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, list[list[str]], list[int]]]:
    """(hash, features, tags) of at most ``TRAIN_CHAINS`` chains around marked words and
    ``TRAIN_PLAIN`` others, by hash."""
    src = stored(sampled(pick(df, doc_id=id_col, text=text_col)).select(F.xxhash64("doc_id", "text").alias("h"), "text"))
    heads = stored(_chains(src, None))
    most = (TRAIN_CHAINS, TRAIN_PLAIN)
    last = tuple(heads.where(F.col("plain") == bool(k)).orderBy("h").limit(n).agg(F.max("h")).first()[0] for k, n in enumerate(most))
    if last == (None, None):
        return []
    got = sorted(tuple(r) for r in _chains(src, tuple(-1 if x is None else x for x in last)).collect())
    out = []
    for k, n in enumerate(most):
        for _, h, words, tags, whole, alone in [r for r in got if r[0] == bool(k)][:n]:
            feats = features_of(words, whole)
            out.append((h, keyless(feats) if alone else feats, tags))
    return sorted(out)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A CRF fitted on the base spans of the sample (see the module text)."""
    chains = training_chains(df, id_col, text_col)
    return Chain.fit([(f, t) for h, f, t in chains if h % HELD_OUT]).tuned([(f, t) for h, f, t in chains if h % HELD_OUT == 0])


def scan_secrets(df: DataFrame, model: Chain | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row."""
    model = model or fit(df, id_col, text_col)
    src = pick(df, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                spans = [[dict(zip(("kind", "start", "end"), s)) for s in found]
                         for found in scan_all([t or "" for t in part.column("text").to_pylist()], model)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, SPANS)], names=["doc_id", "spans"])

    return src.mapInArrow(released(run), f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def redact(df: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df``; every span of a text is replaced by ``mask`` (null stays null)."""
    model = fit(df, id_col, text_col)
    names = df.columns
    src = df.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)])
    at = f"in_{names.index(text_col)}"

    def clean(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
        if not text:
            return text
        out, end = [], 0
        for _, a, b in spans:
            if b > end:
                if a >= end:
                    out.append(text[end:a])
                    out.append(mask)
                end = b
        return "".join(out) + text[end:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, TEXT_BYTES):
                k, texts = part.schema.get_field_index(at), part.column(at).to_pylist()
                yield part.set_column(k, at, pa.array(list(map(clean, texts, scan_all([t or "" for t in texts], model))), pa.string()))

    out = src.mapInArrow(released(run), src.schema)
    return out.select(*[F.col(f"in_{i}").alias(n) for i, n in enumerate(names)])
