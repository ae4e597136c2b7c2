import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import crc_fold, lower_ascii, words
from gristmill.llm.lattice_lm import WORD_MARK, Lattice, Pieces, lm_scores, log_marginals

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def by_recursion(word, pieces, names, log_p):
    text = chr(WORD_MARK) + word
    total = [1.0] + [0.0] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(e):
            part = text[s:e]
            if part in names:
                total[e] += total[s] * math.exp(log_p[names[part]])
            elif e - s == 1:
                total[e] += total[s] * math.exp(pieces.byte * len(part.encode()))
    return math.log(total[-1])


@pytest.fixture(scope="module")
def vocabulary():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return Pieces(MODEL), {sp.id_to_piece(i): k for k, i in enumerate(own)}


def test_forward_recursion(vocabulary):
    pieces, names = vocabulary
    log_p = np.log(pieces.prior)
    own = ["the", "thenonering", "é", "漢字\U0001f600", "a", "x" * 30, "Zq-9"]
    got = log_marginals([w.encode() for w in own], pieces, log_p)
    assert np.allclose(got, [by_recursion(w, pieces, names, log_p) for w in own])


def test_posteriors_cover_every_character_once(vocabulary):
    pieces, _ = vocabulary
    own = [b"thering", b"on", "ñandú".encode()]
    x = Lattice(own, pieces)
    _, posterior = x.run(np.log(pieces.prior), backward=True)
    assert math.isclose((posterior * (x.head - x.tail)).sum(), sum(len(w.decode()) + 1 for w in own), rel_tol=1e-9)


def test_counts_base_and_mixture(docs, corpus, vocabulary):
    tokens = {d: words(lower_ascii(t or "")) + [b"\n"] for d, t in corpus}
    held = {d: crc_fold(d, 7) == 2 for d in tokens}
    c = Counter(w for d in tokens if not held[d] for w in tokens[d])
    n, v = sum(c.values()), len(c)
    rows = lm_scores(docs, MODEL).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in own), rel_tol=1e-9)
        floor = sum(math.log10(c[w] / (n + v)) for w in own if c[w])
        if all(c[w] for w in own):
            assert floor - 1e-9 <= r.score < 0


def test_odd_rows(spark, empty):
    assert lm_scores(empty, MODEL).count() == 0
    rows = [(2, None), (2, None), (None, "a"), (4, " ")]
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()
    assert len(got) == 4 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)


def segmentations(text, names, log_p, byte):
    """(probability, pieces) of every way to cut a text; a character that no piece is costs its bytes."""
    if not text:
        yield 1.0, []
    for e in range(1, len(text) + 1):
        part = text[:e]
        if part in names:
            own, used = math.exp(log_p[names[part]]), [names[part]]
        elif e == 1:
            own, used = math.exp(byte * len(part.encode())), []
        else:
            continue
        for p, rest in segmentations(text[e:], names, log_p, byte):
            yield own * p, used + rest


def test_score_equals_enumerated_segmentations(spark, vocabulary):
    """Every step of the final score in its plainest form: re-estimation, the word's own edge, and the sum over words."""
    from gristmill.llm import lattice_lm as L

    pieces, names = vocabulary
    texts = ["The on, off the", "ring rings on\nthe rung", "zq the", "off-on é", "", None, "unseen thing on", "rung rings"] * 2
    rows = list(enumerate(texts))
    tokens = {d: words(lower_ascii(t or "")) for d, t in rows}
    train = [d for d in tokens if crc_fold(d, 7) != 2]
    c = Counter(w for d in train for w in [*tokens[d], b"\n"])
    n, v, end = sum(c.values()), len(c), c[b"\n"]
    p = pieces.prior
    for _ in range(L.ROUNDS):
        seen = L.PRIOR * pieces.prior
        for w in c:
            if w != b"\n":
                ways = list(segmentations(chr(WORD_MARK) + w.decode(), names, np.log(p), pieces.byte))
                total = sum(x for x, _ in ways)
                for x, used in ways:
                    for i in used:
                        seen[i] += x / total
        p = seen / seen.sum() * (1 - 0.001)
    marginal = lambda w: sum(x for x, _ in segmentations(chr(WORD_MARK) + w.decode(), names, np.log(p), pieces.byte))
    want = {d: sum(math.log10(c[w] / (n + v) + v / (n + v) * marginal(w)) for w in own) + math.log10(end / (n + v)) for d, own in tokens.items()}
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()
    assert len(got) == len(rows) and {crc_fold(d, 7) == 2 for d in tokens} == {True, False}
    assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-9) for r in got)
