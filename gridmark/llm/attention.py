"""A small causal self-attention model in numpy: classes of subword ids from the ids before.

An id's probability is that of its class given the context (the attention model) times its own
within the class (training counts, one added). Contexts are overlapping windows: a block of
``BLOCK`` tokens is scored with the block before it as further context, so that every token is
scored once, with at least ``BLOCK`` tokens of context where the text has them.
"""

from __future__ import annotations

import numpy as np

BLOCK, DIM, HIDDEN, CLASSES, SINGLES, OWN_ROWS = 16, 24, 48, 256, 200, 4096
_FAR = np.float32(-1e9)
#: distance from query i of a block to key j of the block before and the block itself
_DIST = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]
_CAUSAL = np.where(_DIST >= 0, 0, _FAR).astype(np.float32)
_AT = np.maximum(_DIST, 0)


class Vocabulary:
    """Input rows, classes and within-class log10 probabilities of ``n_ids`` subword ids.

    ``counts`` (n_ids, buckets): how often each id came after ids of each bucket. The most frequent
    ids are classes of their own; the others are clustered by what they come after.
    """

    def __init__(self, counts: np.ndarray):
        n = counts.sum(1)
        order = np.lexsort((np.arange(len(n)), -n))
        self.row = np.full(len(n), -1, np.int32)
        self.row[order[:OWN_ROWS]] = np.arange(min(OWN_ROWS, len(n)))
        self.cls = np.full(len(n), CLASSES - 1, np.int64)
        self.cls[order[:SINGLES]] = np.arange(min(SINGLES, len(n)))
        rest = order[SINGLES:]
        rest = rest[n[rest] >= 3]
        if len(rest):
            x = np.sqrt(counts[rest] / n[rest, None])
            k = min(CLASSES - 1 - SINGLES, len(rest))
            # the start: frequent ids far from each other
            pick = [0]
            near = 2 - 2 * x @ x[0]
            for _ in range(k - 1):
                pick.append(int((np.maximum(near, 0) * n[rest]).argmax()))
                near = np.minimum(near, 2 - 2 * x @ x[pick[-1]])
            c = x[pick]
            for _ in range(12):
                own = (x @ c.T).argmax(1)
                c = np.stack([np.bincount(own, x[:, j] * n[rest], minlength=k) for j in range(x.shape[1])], 1)
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            self.cls[rest] = SINGLES + own
        shared = self.row < 0  # the others share a row for each class
        self.row[shared] = OWN_ROWS + self.cls[shared]
        self.bos, self.pad, self.rows = OWN_ROWS + CLASSES, OWN_ROWS + CLASSES + 1, OWN_ROWS + CLASSES + 2
        of_class = np.bincount(self.cls, n, minlength=CLASSES)
        size = np.bincount(self.cls, minlength=CLASSES)
        self.within = np.log10((n + 1) / (of_class[self.cls] + size[self.cls]))
        self.prior = np.log(np.maximum(of_class + size, 1e-9) / (of_class.sum() + size.sum()))


def shapes(rows: int) -> dict[str, tuple]:
    return {"emb": (rows, DIM), "wq": (DIM, DIM), "wk": (DIM, DIM), "wv": (DIM, DIM), "rel": (2 * BLOCK,), "w1": (DIM, HIDDEN), "b1": (HIDDEN,), "wo": (HIDDEN, CLASSES), "bo": (CLASSES,)}


def start(vocab: Vocabulary, seed: int = 11) -> np.ndarray:
    """Initial parameters as one vector; they say the class frequencies."""
    rng = np.random.default_rng(seed)
    parts = []
    for name, shape in shapes(vocab.rows).items():
        if name == "bo":
            parts.append(vocab.prior)
        elif name in ("rel", "b1"):
            parts.append(np.zeros(shape))
        else:
            parts.append(rng.normal(0, {"emb": 0.3, "wo": 0.05}.get(name, shape[0] ** -0.5), shape).ravel())
    return np.concatenate(parts).astype(np.float32)


def views(flat: np.ndarray, rows: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(rows).items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def lay_out(ids: np.ndarray, lengths: np.ndarray, vocab: Vocabulary, end_id: int):
    """Blocks of texts whose ids stand one after the other.

    Returns inputs and the inputs of the blocks before (n, BLOCK), targets (n, BLOCK; -1: none) and
    the first block of each text. A text is its ids and the end; its first input is the begin row.
    """
    m = lengths.astype(np.int64)
    padded = -(-(m + 1) // BLOCK) * BLOCK
    off = np.cumsum(padded) - padded
    total = int(padded.sum())
    inp, tgt = np.full(total + 1, vocab.pad, np.int32), np.full(total, -1, np.int32)
    pos = np.arange(len(ids)) + np.repeat(off - (np.cumsum(m) - m), m)
    tgt[pos] = ids
    tgt[off + m] = end_id
    inp[pos + 1] = vocab.row[ids]
    inp[off] = vocab.bos
    cur = inp[:total].reshape(-1, BLOCK)
    prev = np.empty_like(cur)
    prev[1:] = cur[:-1]
    prev[off // BLOCK] = vocab.pad
    return cur, prev, tgt.reshape(-1, BLOCK), off // BLOCK


#: blocks that are scored at once
_SCORED = 128
#: exponents whose sizes are below this need no maximum taken off
_BOUND = 60


def _softmax(x: np.ndarray, bounded: bool) -> np.ndarray:
    """In place; ``bounded``: a row's largest number is within ``_BOUND`` of zero, or the row is all far below
    and gets zeros."""
    if not bounded:
        x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x *= (1 / np.maximum(x @ np.ones(x.shape[-1], x.dtype), 1e-30))[..., None]
    return x


def _hidden(h: np.ndarray, p: dict[str, np.ndarray], z1: np.ndarray | None = None) -> np.ndarray:
    """The hidden units of places, and a one, which brings the classes' own numbers into ``_output``'s products."""
    z1 = np.empty((len(h), HIDDEN + 1), h.dtype) if z1 is None else z1[: len(h)]
    z = z1[:, :HIDDEN]
    np.matmul(h, p["w1"], out=z)
    z += p["b1"]
    np.tanh(z, out=z)
    z1[:, HIDDEN] = 1
    return z1


def _output(flat: np.ndarray) -> np.ndarray:
    """``wo`` with ``bo`` below it: they stand last among the parameters."""
    return flat[-(HIDDEN + 1) * CLASSES :].reshape(HIDDEN + 1, CLASSES)


class Scorer:
    """log10 probabilities by blocks; projections are looked up by input row.

    Exponents are taken without their maximum where the parameters bound them, which they do unless
    training went astray.
    """

    def __init__(self, flat: np.ndarray, vocab: Vocabulary):
        p = views(flat, vocab.rows)
        self.p, self.vocab, self.out = p, vocab, _output(flat)
        q, k, v = p["emb"] @ p["wq"] * np.float32(DIM**-0.5), p["emb"] @ p["wk"], p["emb"] @ p["wv"]
        k[vocab.pad] = v[vocab.pad] = 0
        # values have a one beside them that sums the weights; pads have neither value nor one
        v = np.concatenate([v, np.ones((len(v), 1), np.float32)], axis=1)
        v[vocab.pad] = 0
        self.q, self.k, self.v, self.e = (np.ascontiguousarray(x) for x in (q, k, v, p["emb"]))
        self.bias = (p["rel"][_AT] + _CAUSAL).astype(np.float32)
        most = np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max() + np.abs(p["rel"]).max()
        self.bounded = most < 40 and np.abs(p["wo"]).sum(0).max() + np.abs(p["bo"]).max() < 60
        self.ones = np.ones(CLASSES, np.float32)

    def blocks(self, cur: np.ndarray, prev: np.ndarray, tgt: np.ndarray) -> np.ndarray:
        """Sum over each block of the log10 probabilities of its targets."""
        out = np.empty(len(cur))
        k, v = np.zeros((_SCORED + 1, BLOCK, DIM), np.float32), np.zeros((_SCORED + 1, BLOCK, DIM + 1), np.float32)
        z1, room = np.empty((_SCORED * BLOCK, HIDDEN + 1), np.float32), np.empty((_SCORED * BLOCK, CLASSES), np.float32)
        # the keys of a block and of the one before it stand side by side: windows of the same memory
        keys, values = (np.lib.stride_tricks.as_strided(y, (_SCORED, 2 * BLOCK, y.shape[2]), y.strides) for y in (k, v))
        for a in range(0, len(cur), _SCORED):
            s = slice(a, a + _SCORED)
            rows = cur[s]
            n = len(rows)
            q, e = self.q.take(rows, axis=0), self.e.take(rows, axis=0)
            self.k.take(rows, axis=0, out=k[1 : n + 1], mode="clip")
            self.v.take(rows, axis=0, out=v[1 : n + 1], mode="clip")
            w = q @ keys[:n].transpose(0, 2, 1)
            w += self.bias
            w[prev[s, 0] == self.vocab.pad, :, :BLOCK] = _FAR  # a text's first block
            if not self.bounded:
                w -= w.max(-1, keepdims=True)
            np.exp(w, out=w)
            h = w @ values[:n]
            k[0], v[0] = k[n], v[n]
            h = h[:, :, :DIM] / np.maximum(h[:, :, DIM:], 1e-30)
            h += e
            logits = np.matmul(_hidden(h.reshape(-1, DIM), self.p, z1), self.out, out=room[: n * BLOCK])
            if not self.bounded:
                logits -= logits.max(1, keepdims=True)
            t = tgt[s].ravel()
            chosen = logits.ravel()[np.arange(0, logits.size, CLASSES) + self.vocab.cls[t]]
            np.exp(logits, out=logits)
            logp = (chosen - np.log(logits @ self.ones)) * np.log10(np.e) + self.vocab.within[t]
            out[s] = np.where(t >= 0, logp, 0.0).reshape(-1, BLOCK).sum(1)
        return out


class Trainer:
    """Adam on the classes' cross entropy."""

    def __init__(self, flat: np.ndarray, vocab: Vocabulary, rate: float = 4e-3):
        self.flat, self.vocab, self.rate = flat.copy(), vocab, rate
        self.p = views(self.flat, vocab.rows)
        self.m, self.s, self.t, self.tokens = np.zeros_like(flat), np.zeros_like(flat), 0, 0

    def step(self, cur: np.ndarray, prev: np.ndarray, tgt: np.ndarray) -> float:
        """A step on blocks that follow each other as ``lay_out`` lays them; returns the loss."""
        p, scale, n = self.p, DIM**-0.5, len(cur)
        rows = np.concatenate([prev[:1], cur]).ravel()
        x = p["emb"].take(rows, axis=0)
        xc = x[BLOCK:]
        q, k, v = (xc @ p["wq"] * scale).reshape(n, BLOCK, DIM), x @ p["wk"], x @ p["wv"]
        # the keys of a block and of the one before it stand side by side: windows of the same memory
        k, v = (np.lib.stride_tricks.as_strided(y, (n, 2 * BLOCK, DIM), (BLOCK * y.strides[0], *y.strides)) for y in (k, v))
        a = q @ k.transpose(0, 2, 1)
        a += p["rel"][_AT] + _CAUSAL
        a[prev[:, 0] == self.vocab.pad, :, :BLOCK] = _FAR  # a text's first block; pads in a block come after all its tokens
        self_ = a.reshape(n, -1)[:, BLOCK :: 2 * BLOCK + 1]  # a token sees itself, so its row's largest is no less
        a = _softmax(a, a.max() < _BOUND and self_.min() > -_BOUND)
        h = (a @ v).reshape(-1, DIM)
        h += xc
        z1 = _hidden(h, p)
        z, out = z1[:, :HIDDEN], _output(self.flat)
        prob = z1 @ out
        if np.abs(p["wo"]).sum(0).max() + np.abs(p["bo"]).max() >= _BOUND:
            prob -= prob.max(1, keepdims=True)
        t = tgt.ravel()
        ok = t >= 0
        m = max(1, int(ok.sum()))
        at = np.arange(0, prob.size, CLASSES) + self.vocab.cls[t]
        chosen = prob.ravel()[at]
        np.exp(prob, out=prob)
        total = prob @ np.ones(CLASSES, prob.dtype)
        loss = -float((chosen - np.log(total))[ok].sum(dtype=np.float64)) / m
        # the classes' gradient is this times ``weight``, which goes to the narrower sides of the products
        prob.ravel()[at] -= total
        weight = (ok / m).astype(prob.dtype) / total
        grad = np.zeros_like(self.flat)
        g = views(grad, self.vocab.rows)
        np.matmul((z1 * weight[:, None]).T, prob, out=_output(grad))
        dz = prob @ p["wo"].T
        dz *= weight[:, None]
        dz *= 1 - z * z
        g["w1"][:], g["b1"][:] = h.T @ dz, dz.sum(0)
        dh = dz @ p["w1"].T
        dh_ = dh.reshape(n, BLOCK, DIM)
        ds = dh_ @ v.transpose(0, 2, 1)
        ds -= ((ds * a) @ np.ones(2 * BLOCK, a.dtype))[..., None]
        ds *= a
        g["rel"][:] = np.bincount(_AT.ravel(), (ds.sum(0) * (_DIST >= 0)).ravel(), minlength=2 * BLOCK)
        dq = (ds @ k).reshape(-1, DIM)
        dq *= scale
        dk, dv = np.zeros((2, n + 1, BLOCK, DIM), h.dtype)
        for of, both in ((dk, ds.transpose(0, 2, 1) @ q), (dv, a.transpose(0, 2, 1) @ dh_)):
            of[:-1] = both[:, :BLOCK]
            of[1:] += both[:, BLOCK:]
        dk, dv = dk.reshape(-1, DIM), dv.reshape(-1, DIM)
        g["wq"][:], g["wk"][:], g["wv"][:] = xc.T @ dq, x.T @ dk, x.T @ dv
        dx = dk @ p["wk"].T
        dx += dv @ p["wv"].T
        dx[BLOCK:] += dh
        dx[BLOCK:] += dq @ p["wq"].T
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # rows are fewer than 2^16
        own = rows[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        g["emb"][own[first]] = np.add.reduceat(dx[order], first, axis=0)
        g["emb"][self.vocab.pad] = 0
        self.t += 1
        self.tokens += m
        by = grad - self.m
        by *= 0.1
        self.m += by
        grad *= grad
        grad -= self.s
        grad *= 0.01
        self.s += grad
        if not self.t % 50:  # numbers on their way to nothing are slow
            self.m[np.abs(self.m) < 1e-12] = 0
            self.s[self.s < 1e-24] = 0
        np.sqrt(self.s, out=by)
        by += 1e-7
        np.divide(self.m, by, out=by)
        by *= self.rate / (1 - 0.9**self.t) * (1 - 0.99**self.t) ** 0.5
        self.flat -= by
        return loss
