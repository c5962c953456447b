"""Parts of the llm subpackage that need no session."""

import random
from collections import Counter

import numpy as np
import pytest

from quern.llm import packing, tokens
from quern.llm.bigru import BiGRU
from quern.llm.eliasfano import EliasFano, Seen


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 70_000])
@pytest.mark.parametrize("universe", [64, 57, 40, 20])
def test_elias_fano_is_the_sorted_array(n, universe):
    r = np.random.default_rng(n)
    x = np.unique(r.integers(0, 2**universe - 1, n, dtype=np.uint64, endpoint=True))
    if n == 3:
        x = np.unique(np.append(x, np.array([0, 2**universe - 1], np.uint64)))
    e = EliasFano(x, universe)
    probes = np.concatenate([x, x[x > 0] - np.uint64(1), r.integers(0, 2**universe - 1, 500, dtype=np.uint64, endpoint=True), np.array([0, 2**universe - 1], np.uint64)])
    assert (e.values() == x).all() and (e.values(np.arange(len(x))) == x).all()
    assert (e.successor(probes) == np.searchsorted(x, probes)).all()
    assert (e.contains(probes) == np.isin(probes, x)).all()
    again = EliasFano.of_bytes(e.to_bytes())
    assert (again.values() == x).all() and (again.contains(probes) == np.isin(probes, x)).all()


def test_elias_fano_is_small():
    x = np.unique(np.random.default_rng(0).integers(0, 2**63, 200_000, dtype=np.uint64))
    assert EliasFano(x).nbytes() * 8 / len(x) < 52


def test_seen_merges_batches():
    r, have, seen = np.random.default_rng(1), set(), Seen()
    for _ in range(40):
        batch = np.unique(r.integers(0, 5000, r.integers(1, 300), dtype=np.uint64))
        known = seen.contains(batch)
        assert known.tolist() == [int(b) in have for b in batch]
        seen.add(batch[~known])
        have |= set(map(int, batch))
    assert len(seen) == len(have) and len(seen.runs) < 12


@pytest.mark.parametrize("capacity", [1, 7, 256, 2048])
def test_packing_plan_holds_every_item_once(capacity):
    r = random.Random(capacity)
    for n in (0, 1, 50, 5000):
        counts = Counter(min(capacity, int(r.lognormvariate(4, 1)) + 1) for _ in range(n))
        segments, bins, _ = packing.plan(dict(counts), capacity)
        fill, ranks = Counter(), {}
        for s in segments:
            for k in range(s.per_bin * s.bins):
                fill[s.first_bin + k // s.per_bin] += s.size
                assert (s.size, s.first_rank + k) not in ranks
                ranks[s.size, s.first_rank + k] = True
        assert len(ranks) == n and set(fill) == set(range(bins)) and max(fill.values(), default=0) <= capacity
        assert all((s, k) in ranks for s, c in counts.items() for k in range(c))
        if n == 5000 and capacity >= 256:
            assert sum(s * c for s, c in counts.items()) / (bins * capacity) > 0.98


def test_gradients_of_the_network():
    r = np.random.default_rng(0)
    net = BiGRU(list("abc"), 5, 1)
    for w in net.ways:
        for k in w.p:
            w.p[k] = w.p[k].astype(np.float64)
    net.head, net.bias = net.head.astype(np.float64), net.bias.astype(np.float64)
    symbols, labels = r.integers(0, 257, (7, 4)), r.integers(-1, 3, (7, 4))
    for p, g in zip(net.parameters(), net.gradients(symbols, labels)[1], strict=True):
        for i in np.argsort(-np.abs(g).ravel())[:3]:
            kept, e = p.flat[i], 1e-4
            p.flat[i] = kept + e
            up = net.gradients(symbols, labels)[0]
            p.flat[i] = kept - e
            down = net.gradients(symbols, labels)[0]
            p.flat[i] = kept
            assert g.flat[i] == pytest.approx((up - down) / 2 / e, rel=2e-2, abs=1e-5)


def test_labelling_agrees_with_training():
    r = np.random.default_rng(0)
    net = BiGRU(list("abc"), 6, 2)
    symbols = r.integers(0, 257, (11, 5))
    fs, _ = net.ways[0].forward(symbols)
    bs, _ = net.ways[1].forward(symbols[::-1])
    scores = np.concatenate([fs[1:], bs[1:][::-1]], axis=2) @ net.head + net.bias
    e = np.exp(scores - scores.max(2, keepdims=True))
    assert np.allclose(net.probabilities(symbols), e / e.sum(2, keepdims=True), atol=1e-4)
    assert np.allclose(BiGRU.of(net.state()).probabilities(symbols), net.probabilities(symbols))


def test_tokens_round_trip_and_stretches():
    text = "Grüße an alle\n" * 20_000 + "x" * 250_000
    assert "".join(tokens.stretches(text)) == text and len(list(tokens.stretches(text))) > 2
    own = tokens.encoder()
    for t in (text, "words." * 20_000, "a b\u001c \n  c1 2'll d!  \r\n" * 9_000, " \n" * 80_000 + "e  f " * 30_000, "ab12" * 60_000):
        assert tokens.count_tokens(t) == len(own.encode_ordinary(t))
    for t in ("Dank u wel, voorzitter", "Благодаря ви, г-н председател", "", " \r\n\t", "🎉"):
        assert own.decode(own.encode_ordinary(t)) == t
        assert tokens.count_tokens(t) == len(own.encode_ordinary(t))
