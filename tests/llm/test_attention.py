"""The attention model computes what is scored, and its gradient is that of its loss."""

import numpy as np

from lexforge.llm import attention_lm as lm


def test_only_scored_positions_attend():
    rng = np.random.default_rng(2)
    w = lm.start_weights()
    w["cls"] *= 20
    w["mem"] *= 20
    big = lm.bigram_logs(rng.integers(0, 3, (lm.SYMBOLS, lm.SYMBOLS)))
    starts, ends = np.array([0, 5, 70]), np.array([5, 70, 190])
    sym = rng.integers(0, lm.SYMBOLS, 190)
    inputs = lm.gather(sym, *lm.windows(starts, ends))
    logp, kept = lm.forward(w, big, *inputs, keep=True)
    assert len(logp) == 190 and kept[4].shape == (8, lm.STRIDE, lm.WINDOW)
    g = lm.backward(w, kept)
    for name in w:
        d = rng.standard_normal(w[name].shape).astype(np.float32)
        d /= np.sqrt((d * d).sum())
        up, down = (-lm.forward(w | {name: w[name] + np.float32(s) * d}, big, *inputs).astype(float).mean() for s in (0.02, -0.02))
        assert abs((up - down) / 0.04 - float((g[name] * d).sum())) < 2e-3 * max(1.0, float(np.abs(g[name]).max())), name


def test_gradient_goes_to_given_arrays_and_member_logs_may_lie_by_class():
    rng = np.random.default_rng(3)
    w = lm.start_weights()
    big = lm.bigram_logs(rng.integers(0, 3, (lm.SYMBOLS, lm.SYMBOLS)))
    starts, ends = np.array([0, 5, 70]), np.array([5, 70, 190])
    inputs = lm.gather(rng.integers(0, lm.SYMBOLS, 190), *lm.windows(starts, ends))
    logp, kept = lm.forward(w, big, *inputs, keep=True)
    want = lm.backward(w, kept)
    logp2, kept = lm.forward(w, lm.by_class(big), *inputs, keep=True)
    vector = rng.standard_normal(len(lm.flat(w))).astype(np.float32)
    got = lm.backward(w, kept, lm._views(vector))
    assert np.array_equal(logp, logp2) and all(np.array_equal(want[k], got[k]) for k in w)
    assert np.array_equal(vector, lm.flat(want).astype(np.float32))


def test_adam_steps_on_one_vector():
    rng = np.random.default_rng(4)
    w = rng.standard_normal(20_000).astype(np.float32)
    opt, plain, m, v = lm.Adam(w), w.astype(float), 0.0, 0.0
    for t in range(1, 30):
        g = rng.standard_normal(len(w)) * 10.0 ** rng.integers(-6, 3, len(w))
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        plain -= 0.03 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.98**t)) + 1e-7)
        opt.step(w, g.astype(np.float32), 0.03)
    assert np.abs(w - plain).max() < 1e-4


def test_scores_of_many_windows_are_those_of_each_batch():
    rng = np.random.default_rng(6)
    w = lm.start_weights()
    w["cls"] *= 20
    w["mem"] *= 20
    w["qkv"] *= 12  # some attention scores are beyond the limit of 30
    big = lm.bigram_logs(rng.integers(0, 3, (lm.SYMBOLS, lm.SYMBOLS)))
    n = rng.integers(1, 200, 300)
    ends = np.cumsum(n)
    sym = np.minimum(rng.zipf(1.3, ends[-1]), lm.SYMBOLS) - 1
    inputs = lm.gather(sym, *lm.windows(ends - n, ends))
    assert len(inputs[0]) > 2 * lm.BATCH and ends[-1] > 2 * lm.BLOCK
    parts = [lm.forward(w, big, *(x[k : k + 50] for x in inputs)) for k in range(0, len(inputs[0]), 50)]
    assert np.abs(lm._log_probabilities(w, big, *inputs) - np.concatenate(parts)).max() < 1e-4
    assert np.abs(lm.score(w, big, sym, ends - n, ends) - np.concatenate(parts)).max() < 1e-4
    # the attention of one window in double precision
    before, last, target, there, scored = (x[:1] for x in inputs)
    x = (w["emb"][before[0]] + w["last"][last[0]]).astype(float)
    q, k, v = np.split(x @ w["qkv"].astype(float), 3, axis=1)
    e = q @ k.T / np.sqrt(lm.DIM) + w["rel"][np.maximum(0, np.arange(lm.WINDOW)[:, None] - np.arange(lm.WINDOW))]
    assert np.abs(e).max() > 30
    e = np.exp(np.clip(e, -30, 30)) * np.tril(there[0][None, :] * np.ones((lm.WINDOW, lm.WINDOW)))
    want = (e / np.maximum(e.sum(1, keepdims=True), 1e-300) @ v)[scored[0]]
    _, kept = lm.forward(w, big, before, last, target, there, scored, keep=True)
    got = (kept[6] * kept[5][:, None])[scored[0, lm.OVERLAP :]]
    assert np.abs(got - want).max() < 1e-2 * np.abs(want).max()
