"""A small causal self-attention language model over subword symbols, trained and run in numpy.

Frequent subword ids are symbols of their own, the rest share one symbol and split its probability by their
smoothed counts. A window holds WINDOW positions, of which the first OVERLAP only give context, so that every
token is scored once with at least OVERLAP tokens before it (fewer at a document's start). Attention is a
batch of masked matrix products over windows, with a learned bias by distance. The output is a class and a
member of it, either by softmax over the corpus's bigram log-probabilities plus what the model adds to them,
so an untrained model scores as the bigrams do.
"""

from __future__ import annotations

import numpy as np

DIM, WINDOW, OVERLAP, CLASSES = 16, 40, 10, 32
SYMBOLS = CLASSES * CLASSES
STRIDE = WINDOW - OVERLAP
BATCH = 128
#: Scored tokens whose outputs are computed at once.
BLOCK = 2048
#: Weights that Adam changes at a time, which stay in the cache.
PIECE = 1 << 14
#: Windows whose inputs are looked up at once.
AHEAD = 4096
_F = np.float32

SHAPES = {
    "emb": (SYMBOLS, DIM), "last": (SYMBOLS, DIM), "rel": (WINDOW,), "qkv": (DIM, 3 * DIM), "out": (DIM, DIM), "up": (DIM, 2 * DIM), "up_b": (2 * DIM,), "down": (2 * DIM, DIM),
    "cls": (DIM, CLASSES), "cls_b": (CLASSES,), "mem": (CLASSES, DIM, CLASSES), "mem_b": (CLASSES, CLASSES),
}


def start_weights(seed: int = 11) -> dict[str, np.ndarray]:
    """Random weights; the outputs add nothing to the bigrams yet."""
    rng = np.random.default_rng(seed)
    w = {k: (rng.standard_normal(s) * (0.5 if k in ("emb", "last") else 1 / np.sqrt(s[-2])) if len(s) > 1 and not k.endswith("_b") else np.zeros(s)).astype(_F) for k, s in SHAPES.items()}
    w["rel"] = (-0.3 * np.arange(WINDOW)).astype(_F)
    w["cls"] *= _F(0.02)
    w["mem"] *= _F(0.02)
    return w


def bigram_logs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of class, and of member given class, after each symbol; counts[i, j] of j after i.
    Witten-Bell smoothing towards the unigrams."""
    counts = counts.astype(np.float64)
    un = counts.sum(0) + 0.5
    un /= un.sum()
    kinds = np.maximum(1, (counts > 0).sum(1, keepdims=True))
    p = ((counts + kinds * un) / (counts.sum(1, keepdims=True) + kinds)).reshape(SYMBOLS, CLASSES, CLASSES)
    pc = p.sum(2)
    return np.log(pc).astype(_F), np.log(p / pc[:, :, None]).astype(_F)


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES]).astype(np.float64)


def _views(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s)
        at += n
    return out


def unflat(v: np.ndarray) -> dict[str, np.ndarray]:
    return _views(v.astype(_F))


#: For positions that can be scored, the only ones that attend: what each may see, and how far back it is.
_CAUSAL = np.tril(np.ones((WINDOW, WINDOW), _F))[OVERLAP:]
_APART = np.maximum(0, np.arange(WINDOW)[:, None] - np.arange(WINDOW))[OVERLAP:]
_SCALE = np.repeat([1 / np.sqrt(DIM), 1, 1], DIM).astype(_F)
_ONES = np.ones(max(WINDOW, CLASSES), _F)


def windows(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of tokens [start, end): each window's first scored position, its document's start and end."""
    n = -(-(ends - starts) // STRIDE)
    doc = np.repeat(np.arange(len(starts)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return starts[doc] + k * STRIDE, starts[doc], ends[doc]


def gather(sym: np.ndarray, first: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Inputs, the symbols before them, targets (B, WINDOW), which positions exist, and which are scored. The input before a document's
    first token is symbol 0, its end."""
    at = first[:, None] - OVERLAP - 2 + np.arange(WINDOW + 2)
    own = sym.take(at, mode="clip")
    odd = np.flatnonzero(at[:, 0] < lo)
    own[odd] *= at[odd] >= lo[odd, None]
    there = (at[:, 2:] >= lo[:, None]) & (at[:, 2:] < hi[:, None])
    scored = there.copy()
    scored[:, :OVERLAP] = False
    return own[:, 1:-1], own[:, :-2], own[:, 2:], there, scored


def by_class(bigram: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The same logs, those of members stored class by class, as forward() reads them."""
    return bigram[0], np.ascontiguousarray(bigram[1].transpose(1, 0, 2)).transpose(1, 0, 2)


def _hidden(w: dict[str, np.ndarray], before: np.ndarray, last: np.ndarray, there: np.ndarray, place: np.ndarray, keep: bool = False):
    """What the outputs see at the given places among the positions that can be scored, (DIM + 1, places), and, with keep, what
    backward() needs. After attention positions lie in columns, so that a factor for each position is one row."""
    b = len(before)
    x = w["emb"].take(before, axis=0)
    x += w["last"].take(last, axis=0)
    flat_x, proj = x.reshape(-1, DIM), w["qkv"] * _SCALE
    qkv = (flat_x @ proj).reshape(b, WINDOW, 3 * DIM)
    q, k, v = qkv[:, OVERLAP:, :DIM], qkv[..., DIM : 2 * DIM], qkv[..., 2 * DIM :]
    # keys, and for backward() values, once more by component: small matrices are multiplied faster as they are than transposed
    across = (proj[:, DIM : (3 if keep else 2) * DIM].T @ flat_x.T).reshape(-1, DIM, b, WINDOW).transpose(0, 2, 1, 3)
    e = q @ across[0]
    e += w["rel"].take(_APART)
    if not (e.max() <= 30 and e.min() >= -30):
        np.clip(e, -30, 30, out=e)
    np.exp(e, out=e)
    e *= _CAUSAL
    odd = np.flatnonzero(~there[:, 0])  # windows that begin before their document
    if len(odd):
        e[odd] *= there[odd][:, None, :]
    part = e.reshape(-1, WINDOW) @ _ONES[:WINDOW]
    part += _F(1e-9)
    np.divide(_F(1), part, out=part)
    ctx = (e @ v).reshape(-1, DIM)
    cs, ps = ctx.take(place, axis=0), part.take(place)
    y = np.empty((DIM + 1, len(place)), _F)
    y[DIM] = 1  # so that one product takes weights and bias
    np.matmul(w["out"].T, cs.T, out=y[:DIM])
    y[:DIM] *= ps
    own = (np.arange(b)[:, None] * WINDOW + np.arange(OVERLAP, WINDOW)).ravel()
    y[:DIM] += flat_x.take(own.take(place), axis=0).T
    hid = np.vstack([w["up"], w["up_b"]]).T @ y
    np.maximum(hid, np.zeros_like(hid), out=hid)
    z = np.empty_like(y)
    z[DIM] = 1
    np.matmul(w["down"].T, hid, out=z[:DIM])
    z[:DIM] += y[:DIM]
    norm = 1 / np.sqrt((_ONES[:DIM] @ (z[:DIM] * z[:DIM])) * _F(1 / DIM) + _F(1e-5))
    z[:DIM] *= norm
    return z, (x, q, k, across[1], e, part, ctx, place, cs, ps, y, hid, z, norm, proj, before, last) if keep else None


def _outputs(w: dict[str, np.ndarray], bigram: tuple[np.ndarray, np.ndarray], rows: np.ndarray, prev: np.ndarray, c: np.ndarray, m: np.ndarray):
    """Log-probability of member m of class c, sorted, after symbol prev at each of the rows (of _hidden()), and what it comes from."""
    n = len(rows)
    cuts = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
    runs = [(j, lo, hi) for j, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
    pc = rows @ np.vstack([w["cls"], w["cls_b"]])
    pc += bigram[0].take(prev, axis=0)
    pm = np.empty((n, CLASSES), _F)
    mem = np.concatenate([w["mem"], w["mem_b"][:, None]], axis=1)
    for j, lo, hi in runs:
        np.dot(rows[lo:hi], mem[j], out=pm[lo:hi])
    pm += bigram[1].transpose(1, 0, 2).reshape(SYMBOLS * CLASSES, CLASSES).take(c * SYMBOLS + prev, axis=0)
    at = np.arange(0, n * CLASSES, CLASSES)
    at_c, at_m = at + c, at + m
    own = pc.ravel().take(at_c) + pm.ravel().take(at_m)
    np.exp(pc, out=pc)
    np.exp(pm, out=pm)
    sum_c, sum_m = pc @ _ONES[:CLASSES], pm @ _ONES[:CLASSES]
    return own - np.log(sum_c) - np.log(sum_m), (runs, pc, sum_c, at_c, pm, sum_m, at_m)


def _targets(before: np.ndarray, target: np.ndarray, scored: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of what is scored: its place among the positions that can be, the symbol before it, its class and its member of that."""
    place = np.flatnonzero(scored[:, OVERLAP:])
    t = target[:, OVERLAP:].ravel().take(place)
    c = t // CLASSES
    return place, before[:, OVERLAP:].ravel().take(place), c, t - c * CLASSES


def forward(w: dict[str, np.ndarray], bigram: tuple[np.ndarray, np.ndarray], before: np.ndarray, last: np.ndarray, target: np.ndarray, there: np.ndarray, scored: np.ndarray, keep: bool = False):
    """Log-probability of every scored target, in row order; with keep also what backward() needs."""
    place, prev, c, m = _targets(before, target, scored)
    order = np.argsort(c.astype(np.uint8), kind="stable")
    z, kept = _hidden(w, before, last, there, place.take(order), keep)
    sorted_logp, out = _outputs(w, bigram, np.ascontiguousarray(z.T), prev.take(order), c.take(order), m.take(order))
    logp = np.empty(len(order), _F)
    logp[order] = sorted_logp
    return (logp, kept + out) if keep else logp


def backward(w: dict[str, np.ndarray], kept, g: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Gradient of the mean negative log-probability, in g's arrays if they are given. What was kept is used up."""
    x, q, k, v_across, e, part, ctx, place, cs, ps, y, hid, z, norm, proj, before, last, runs, pc, sum_c, at_c, pm, sum_m, at_m = kept
    g = {n: np.empty_like(v) for n, v in w.items()} if g is None else g
    b, n, flat_x = len(x), len(place), x.reshape(-1, DIM)
    r = _F(1 / n)
    pc *= (r / sum_c)[:, None]
    pc.ravel()[at_c] -= r
    both = z @ pc
    g["cls"][:], g["cls_b"][:] = both[:DIM], both[DIM]
    dz = pc @ np.ascontiguousarray(w["cls"].T)
    pm *= (r / sum_m)[:, None]
    pm.ravel()[at_m] -= r
    dzm, both, mem = np.empty_like(dz), np.zeros((CLASSES, DIM + 1, CLASSES), _F), np.ascontiguousarray(w["mem"].transpose(0, 2, 1))
    for j, lo, hi in runs:
        own = pm[lo:hi]
        np.dot(z[:, lo:hi], own, out=both[j])
        np.dot(own, mem[j], out=dzm[lo:hi])
    g["mem"][:], g["mem_b"][:] = both[:, :DIM], both[:, DIM]
    dz += dzm
    dz, z = np.ascontiguousarray(dz.T), z[:DIM]
    dz -= z * ((_ONES[:DIM] @ (dz * z)) * _F(1 / DIM))
    dz *= norm
    g["down"][:] = hid @ dz.T
    dh = w["down"] @ dz
    dh *= (hid > 0).astype(_F)
    both = y @ dh.T
    g["up"][:], g["up_b"][:] = both[:DIM], both[DIM]
    dz += w["up"] @ dh
    # back to all positions that can be scored; those that are not take a row of zeros
    slot = np.full(b * STRIDE, n)
    slot[place] = np.arange(n)
    rows = np.zeros((2, n + 1, DIM), _F)
    rows[0, :n] = dz.T
    dz *= ps
    g["out"][:] = cs.T @ dz.T
    np.matmul(dz.T, w["out"].T, out=rows[1, :n])
    dy, dctx = rows[0].take(slot, axis=0), rows[1].take(slot, axis=0)
    # of the scores: a row's mean of da is dctx * ctx, summed
    mean = (dctx * ctx) @ _ONES[:DIM]
    mean *= part
    dctx = dctx.reshape(b, STRIDE, DIM)
    ds = dctx @ v_across
    ds -= mean.reshape(b, STRIDE, 1)
    ds *= e
    dqkv = np.empty((b, WINDOW, 3 * DIM), _F)
    dqkv[:, :OVERLAP, :DIM] = 0
    np.matmul(ds, k, out=dqkv[:, OVERLAP:, :DIM])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., DIM : 2 * DIM])
    np.matmul(e.transpose(0, 2, 1), dctx, out=dqkv[..., 2 * DIM :])
    dqkv = dqkv.reshape(-1, 3 * DIM)
    g["qkv"][:] = flat_x.T @ dqkv
    g["qkv"] *= _SCALE
    dx = dqkv @ np.ascontiguousarray(proj.T)
    dx.reshape(b, WINDOW, DIM)[:, OVERLAP:] += dy.reshape(b, STRIDE, DIM)
    # read in rows shorter by one, each row moves one place further right, and equal distances come to lie in one column
    far = np.zeros((STRIDE, STRIDE + WINDOW + 1), _F)
    far[:, :WINDOW] = (np.ones(b, _F) @ ds.reshape(b, -1)).reshape(STRIDE, WINDOW)[:, ::-1]
    far = far.ravel()[: STRIDE * (STRIDE + WINDOW)].reshape(STRIDE, STRIDE + WINDOW)
    g["rel"][:] = (_ONES[:STRIDE] @ far)[STRIDE - 1 : STRIDE - 1 + WINDOW]
    _scatter(before.ravel(), dx, g["emb"])
    _scatter(last.ravel(), dx, g["last"])
    return g


def _scatter(at: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Sum of the rows at each symbol. Two neighbouring values are added as one complex number, which takes half the steps."""
    out[:] = 0
    half = DIM // 2
    np.add.at(out.reshape(-1).view(np.complex64), ((at * half)[:, None] + np.arange(half)).ravel(), rows.reshape(-1).view(np.complex64))


class Adam:
    """Steps on all weights as one vector. m and v are the decayed sums of gradients and of their squares, without the
    factors 0.1 and 0.02 that make means of them."""

    def __init__(self, w: np.ndarray):
        self.m, self.v, self.t = np.zeros_like(w), np.zeros_like(w), 0

    def step(self, w: np.ndarray, g: np.ndarray, rate: float) -> None:
        """Change w; g is used up."""
        self.t += 1
        root = np.sqrt(0.02 / (1 - 0.98**self.t))
        a, least = _F(0.1 * rate / (1 - 0.9**self.t) / root), _F(1e-7 / root)
        for at in range(0, len(w), PIECE):
            i = slice(at, at + PIECE)
            m, v, x = self.m[i], self.v[i], g[i]
            m *= _F(0.9)
            m += x
            x *= x
            v *= _F(0.98)
            v += x
            np.sqrt(v, out=x)
            x += least
            np.divide(m, x, out=x)
            x *= a
            w[i] -= x


def train(w: dict[str, np.ndarray], bigram: tuple[np.ndarray, np.ndarray], sym: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray, whole: np.ndarray, rate: float, seed: list[int], batch: int = 32) -> tuple[dict[str, np.ndarray], int]:
    """Adam over every window of stretches [start, end) of sym, in random order; weights and the number of windows
    seen. The first lead tokens of a stretch only give context; whole: a document starts with it."""
    first, lo, hi = windows(starts + lead, ends)
    n = -(-(ends - starts - lead) // STRIDE)
    lo = np.repeat(np.where(whole, starts, starts - WINDOW), n)
    bigram = by_class(bigram)
    own = flat(w).astype(_F)
    grad = np.empty_like(own)
    w, g = _views(own), _views(grad)
    rng, opt = np.random.default_rng(seed), Adam(own)
    order, steps = rng.permutation(len(first)), -(-len(first) // batch)
    ahead = max(1, AHEAD // batch)
    for k in range(steps):
        if not k % ahead:
            i = order[k * batch : (k + ahead) * batch]
            inputs = gather(sym, first[i], lo[i], hi[i])
        i = slice(k % ahead * batch, (k % ahead + 1) * batch)
        _, kept = forward(w, bigram, *(x[i] for x in inputs), keep=True)
        backward(w, kept, g)
        opt.step(own, grad, rate * min(1.0, (k + 1) / 20) * (1 - 0.5 * k / steps))
    return w, len(first)


def _log_probabilities(w: dict[str, np.ndarray], bigram: tuple[np.ndarray, np.ndarray], before: np.ndarray, last: np.ndarray, target: np.ndarray, there: np.ndarray, scored: np.ndarray) -> np.ndarray:
    """As forward(), for many windows: the outputs are computed in the order of class and symbol before, whose logs lie together."""
    place, prev, c, m = _targets(before, target, scored)
    rows = np.empty((len(place), DIM + 1), _F)
    cut = np.searchsorted(place, np.arange(0, len(before) + BATCH, BATCH) * STRIDE)
    for k, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        i = slice(k * BATCH, (k + 1) * BATCH)
        rows[lo:hi] = _hidden(w, before[i], last[i], there[i], place[lo:hi] - k * BATCH * STRIDE)[0].T
    order = np.argsort((c * SYMBOLS + prev).astype(np.uint16), kind="stable")
    logp = np.empty(len(place), _F)
    for at in range(0, len(order), BLOCK):
        i = order[at : at + BLOCK]
        logp[i] = _outputs(w, bigram, rows.take(i, axis=0), prev.take(i), c.take(i), m.take(i))[0]
    return logp


def score(w: dict[str, np.ndarray], bigram: tuple[np.ndarray, np.ndarray], sym: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Natural-log probability of every token, in order."""
    first, lo, hi = windows(starts, ends)
    bigram = by_class(bigram)
    out = np.zeros(len(sym), np.float64)
    for a in range(0, len(first), AHEAD):
        i = slice(a, a + AHEAD)
        inputs = gather(sym, first[i], lo[i], hi[i])
        out[(first[i][:, None] - OVERLAP + np.arange(WINDOW))[inputs[-1]]] = _log_probabilities(w, bigram, *inputs)
    return out
