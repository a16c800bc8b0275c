"""Secret scans over whole texts: every word is decoded, by one path through the text."""

import random

import numpy as np

from wearline.llm import secrets


def model(names, weights, lead=0.0):
    emit = np.zeros((len(names) + 1, 3))
    for k, w in enumerate(weights):
        emit[k] = w
    return secrets.Chain({x: k for k, x in enumerate(names)}, emit, secrets.Chain.BANNED.copy(), lead)


def test_words_without_marks_are_decoded():
    """A word is tagged by its own features, though no digit or key word stands in the text."""
    word = "QxWzErTyUiOp"
    shape = next(x for x in secrets.word_features(word) if x.startswith("shape="))
    own = model(["plain", "plain:" + shape], [(3.0, 0, 0), (0, 9.0, 0)])
    text = "the river " + "runs under bridges " * 40 + word + ", they say"
    at = text.index(word)
    assert secrets.scan(text, own) == [("crf", at, at + len(word))]
    assert secrets.scan(text.replace(word, "word"), own) == [] and secrets.scan("", own) == []


def test_a_path_goes_through_the_whole_text():
    rng = np.random.default_rng(4)
    chain = model(["plain"], [(0, 0, 0)], lead=0.3)
    chain.step += rng.normal(size=(3, 3))
    sizes = [0, 1, 2, 63, 64, 65, 127, 128, 129, 700, 0, 5]
    scores = [2 * rng.normal(size=(n, 3)) for n in sizes]

    def slow(e):
        best, back = None, []
        for row in e:
            if best is None:
                best = chain.FIRST.copy()
            else:
                moves = best[:, None] + chain.step
                back.append(moves.argmax(axis=0))
                best = moves.max(axis=0)
            best = best + row + np.array([chain.lead, 0, 0])
        if best is None:
            return []
        tags = [int((best + chain.step[:, 0]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    want = [t for e in scores for t in slow(e)]
    assert chain.paths(np.concatenate(scores), sizes).tolist() == want
    assert {0, 1, 2} == set(want)


def test_kept_scores_are_those_of_the_features(monkeypatch):
    rng = random.Random(1)
    words = ["the", "river", "token", "=", "a1b2c3d4e5f6", "AKIA", "Bridges.", "12", "x=1", "é", "QwErTy"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 90))) for _ in range(60)] + ["", "\v"]
    chains = []
    for t in texts:
        runs, whole = secrets.regions(t)
        assert [w for r in runs for w in r] == [(m.start(), m.end()) for m in secrets.WORD.finditer(t)]
        chains += [(secrets.chain_features(t, r, whole), [int("=" in t[a:b]) for a, b in r]) for r in runs]
    fitted = secrets.Chain.fit(chains)
    monkeypatch.setattr(secrets, "WORDS", 8)       # scores are forgotten all the time
    for t in texts:
        found = [(m.start(), m.end()) for m in secrets.WORD.finditer(t)]
        whole = secrets.spread(t)[3]
        if found:
            got = fitted.reader.scores([secrets.WORD.findall(t)], [whole])
            assert np.abs(got - fitted.scores(secrets.chain_features(t, found, whole))).max() < 1e-9
    alone = [secrets.scan(t, fitted) for t in texts]
    assert secrets.scan_all(texts, fitted) == alone and any(k == "crf" for spans in alone for k, _, _ in spans)
