"""A one-layer causal self-attention model over subwords, in numpy: scoring, gradients and Adam.

Every subword seen in training is a bucket of its own; those never seen share one, evenly. Buckets are grouped into
about as many classes as each has members (the square root of the vocabulary), by the contexts they follow. A
bucket's probability is that of its class times that of the bucket within its class. Both are softmaxes over what
attention makes of the window, added to log probabilities given the one subword before (pair counts with absolute
discounting, where the commonest ``CONTEXTS - 1`` subwords are contexts of their own and all others share one). So the
probabilities of all subwords sum to one. Cost per token grows with the square root of the vocabulary seen.
"""

from __future__ import annotations

import ctypes
import functools
import glob
import os
from dataclasses import dataclass

import numpy as np

WINDOW, OVERLAP = 32, 8
WIDTH, HIDDEN = 16, 32
CONTEXTS = 1024
#: Taken from each pair count and given to what the context wasn't seen with.
DISCOUNT = 0.75
#: Windows of a step in training, and of a block in scoring, of which BATCH at a time go through attention.
STEP, BLOCK, BATCH = 256, 1024, 64
#: Times that few windows are gone through at most.
MAX_EPOCHS = 6
#: Logits above this count as this: exp stays finite without looking for the largest.
TOP = np.float32(40)
_MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))


@functools.cache
def one_thread() -> None:
    """Keeps numpy's linear algebra to one thread: a task has one core, and more threads would only wait for each other."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(ctypes.c_int(1))


@dataclass
class Tables:
    """Counts as the model uses them. bucket: of each subword, numbered class by class; own_logp: of a subword within
    its bucket; context: of each bucket; edges: first bucket of each class, and the end; before[context, class] and
    inside[context, bucket]: log probabilities of a class, and of a bucket within its class. Natural logarithms."""

    bucket: np.ndarray
    own_logp: np.ndarray
    context: np.ndarray
    edges: np.ndarray
    before: np.ndarray
    inside: np.ndarray

    @property
    def size(self) -> int:
        """Buckets."""
        return int(self.edges[-1])

    @functools.cached_property
    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges)).astype(np.int16)


def ranked(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(rank of each subword by count, ties by number; those unseen share the last rank, number of ranks)."""
    n = int((counts > 0).sum())
    order = np.argsort(-counts, kind="stable")[:n]
    rank = np.full(len(counts), n, np.int32)
    rank[order] = np.arange(n)
    return rank, n + 1


def tables(counts: np.ndarray, pairs: np.ndarray) -> Tables:
    """From subword counts and pair counts (context: rank of the subword before, at most CONTEXTS - 1; rank of the next)."""
    rank, n = ranked(counts)
    follows = (pairs > 0).sum(0) + 0.5
    total, kinds = pairs.sum(1, keepdims=True), (pairs > 0).sum(1, keepdims=True)
    p = np.maximum(pairs - DISCOUNT, 0)
    p = (p + np.where(total > 0, DISCOUNT * kinds + 0.5, 1.0) * (follows / follows.sum())) / np.where(total > 0, total + 0.5, 1.0)
    order, edges = _classes(pairs)
    number = np.empty(n, np.int32)
    number[order] = np.arange(n)
    p = p[:, order]
    by_class = np.add.reduceat(p, edges[:-1], axis=1)
    inside = np.log(p / np.repeat(by_class, np.diff(edges), axis=1)).astype(np.float32)
    context = np.minimum(order, CONTEXTS - 1).astype(np.int16)
    own = np.where(counts > 0, 0.0, -np.log(max(1, (counts == 0).sum())))
    before = np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32)
    return Tables(number[rank], own.astype(np.float32), context, edges, before, inside)


def _classes(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ranks class by class, first place of each class and the end): classes of even size with like contexts.

    The ranks are halved again and again along the direction in which their contexts differ most.
    """
    n = pairs.shape[1]
    share = pairs.sum(1, keepdims=True) + 1
    x = np.log1p(pairs * (pairs.sum() + 1) / (share * (pairs.sum(0) + 1)))
    # leading directions from the small square matrix of contexts
    values, vectors = np.linalg.eigh(x @ x.T)
    feats = (x.T @ vectors[:, -16:]).astype(np.float64)
    feats /= np.maximum(1e-9, np.linalg.norm(feats, axis=1, keepdims=True))
    groups = [np.arange(n)]
    for _ in range(max(0, round(np.log2(max(1, n)) / 2))):
        halves = []
        for g in groups:
            f = feats[g] - feats[g].mean(0)
            _, v = np.linalg.eigh(f.T @ f)
            at = np.argsort(f @ v[:, -1], kind="stable")
            halves += [np.sort(g[at[: len(g) // 2]]), np.sort(g[at[len(g) // 2 :]])]
        groups = [h for h in halves if len(h)]
    return np.concatenate(groups), np.concatenate([[0], np.cumsum([len(g) for g in groups])])


def shapes(t: Tables) -> dict[str, tuple[int, ...]]:
    return {
        "emb": (t.size, WIDTH),
        "own": (t.size, WIDTH),
        "pos": (WINDOW, WIDTH),
        "qkv": (WIDTH, 3 * WIDTH),
        "mix": (WIDTH, WIDTH),
        "up": (WIDTH, HIDDEN),
        "bias": (HIDDEN,),
        "down": (HIDDEN, WIDTH),
        "out": (WIDTH, len(t.edges) - 1),
    }


def initial(t: Tables) -> np.ndarray:
    rng = np.random.default_rng(11)
    parts = []
    for name, shape in shapes(t).items():
        scale = {"emb": 0.5, "own": 0.02, "pos": 0.1, "bias": 0.0, "out": 0.02}.get(name, shape[0] ** -0.5)
        parts.append((rng.standard_normal(shape) * scale).ravel())
    return np.concatenate(parts).astype(np.float32)


def named(flat: np.ndarray, t: Tables) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(t).items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def forward(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Hidden states of buckets x (windows, WINDOW), a row for each position, and what gradients need."""
    n = len(x)
    e = p["emb"][x]
    e += p["pos"]
    flat = e.reshape(-1, WIDTH)
    qkv = (flat @ p["qkv"]).reshape(n, WINDOW, 3 * WIDTH)
    q, k, v = qkv[:, :, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH], qkv[:, :, 2 * WIDTH :]
    a = np.matmul(q, k.transpose(0, 2, 1))
    a *= np.float32(WIDTH**-0.5)
    np.minimum(a, TOP, out=a)
    np.exp(a, out=a)
    a *= _MASK
    a /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, a.dtype)).reshape(n, WINDOW, 1)
    o = np.matmul(a, v)
    h = o.reshape(-1, WIDTH) @ p["mix"]
    h += flat
    f = h @ p["up"]
    f += p["bias"]
    np.maximum(f, 0, out=f)
    z = f @ p["down"]
    z += h
    return z, (e, q, k, v, a, o, h, f)


def _softmax(s: np.ndarray) -> np.ndarray:
    """The sums of exp of the rows of s, which becomes exp(s)."""
    np.minimum(s, TOP, out=s)
    np.exp(s, out=s)
    return s @ np.ones(s.shape[1], s.dtype)


def _by_class(t: Tables, y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """(order of y by class, (first row, last row, first bucket, last bucket) of each class in it)."""
    of = t.class_of[y]
    order = np.argsort(of, kind="stable")
    found, begin = np.unique(of[order], return_index=True)
    ends = [*begin[1:].tolist(), len(y)]
    spans = zip(begin.tolist(), ends, t.edges[found].tolist(), t.edges[found + 1].tolist(), strict=True)
    return order, list(spans)


def log_probability(p: dict[str, np.ndarray], t: Tables, z: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of buckets y after buckets x, given hidden states z."""
    context, of, out = t.context[x], t.class_of[y], np.empty(len(y), z.dtype)
    for lo in range(0, len(y), WINDOW * BATCH):
        hi = min(lo + WINDOW * BATCH, len(y))
        s = z[lo:hi] @ p["out"]
        s += t.before[context[lo:hi]]
        out[lo:hi] = np.minimum(s[np.arange(hi - lo), of[lo:hi]], TOP)
        out[lo:hi] -= np.log(_softmax(s))
    order, spans = _by_class(t, y)
    zs, cs, ys = z[order], context[order], y[order]
    within = np.empty(len(y), z.dtype)
    for lo, hi, first, last in spans:
        s = zs[lo:hi] @ p["own"][first:last].T
        s += t.inside[cs[lo:hi], first:last]
        own = np.minimum(s[np.arange(hi - lo), ys[lo:hi] - first], TOP)
        within[lo:hi] = own - np.log(_softmax(s))
    out[order] += within
    return out


def gradient(p: dict[str, np.ndarray], t: Tables, windows: np.ndarray, tell: bool = True) -> tuple[float, np.ndarray]:
    """(loss if tell, flat gradient) of the mean negative log probability of the last WINDOW buckets of windows (rows of
    WINDOW + 1)."""
    x, y = windows[:, :-1], windows[:, 1:].ravel()
    n, size = len(x), y.size
    z, (e, q, k, v, a, o, h, f) = forward(p, x)
    context = t.context[x.ravel()]
    share = z.dtype.type(1 / size)

    s = z @ p["out"]
    s += t.before[context]
    total = _softmax(s)
    rows, of = np.arange(size), t.class_of[y]
    loss = np.log(total).sum() - np.log(s[rows, of]).sum() if tell else 0.0
    s *= (share / total)[:, None]
    s[rows, of] -= share
    g = {"out": z.T @ s}
    dz = s @ p["out"].T

    order, spans = _by_class(t, y)
    zs, cs, ys = z[order], context[order], y[order]
    ds, g["own"] = np.empty_like(zs), np.zeros_like(p["own"])
    for lo, hi, first, last in spans:
        s = zs[lo:hi] @ p["own"][first:last].T
        s += t.inside[cs[lo:hi], first:last]
        total = _softmax(s)
        at = rows[: hi - lo] * (last - first) + (ys[lo:hi] - first)
        if tell:
            loss += np.log(total).sum() - np.log(s.ravel()[at]).sum()
        s *= (share / total)[:, None]
        s.ravel()[at] -= share
        g["own"][first:last] = s.T @ zs[lo:hi]
        ds[lo:hi] = s @ p["own"][first:last]
    dz[order] += ds

    df = dz @ p["down"].T
    df *= f > 0
    g["down"], g["up"], g["bias"] = f.T @ dz, h.T @ df, df.sum(0)
    dh = df @ p["up"].T
    dh += dz
    g["mix"] = o.reshape(-1, WIDTH).T @ dh
    do = (dh @ p["mix"].T).reshape(n, WINDOW, WIDTH)
    da = np.matmul(do, v.transpose(0, 2, 1))
    dqkv = np.empty((n, WINDOW, 3 * WIDTH), z.dtype)
    dqkv[:, :, 2 * WIDTH :] = np.matmul(a.transpose(0, 2, 1), do)
    da *= a
    da -= a * (da.reshape(-1, WINDOW) @ np.ones(WINDOW, da.dtype)).reshape(n, WINDOW, 1)
    da *= np.float32(WIDTH**-0.5)
    dqkv[:, :, :WIDTH] = np.matmul(da, k)
    dqkv[:, :, WIDTH : 2 * WIDTH] = np.matmul(da.transpose(0, 2, 1), q)
    dqkv = dqkv.reshape(-1, 3 * WIDTH)
    g["qkv"] = e.reshape(-1, WIDTH).T @ dqkv
    dh += dqkv @ p["qkv"].T
    g["pos"] = dh.reshape(n, -1).sum(0).reshape(WINDOW, WIDTH)
    g["emb"] = _sum_by(x.ravel(), dh, t.size)
    return float(loss) / size, np.concatenate([g[name].ravel() for name in shapes(t)])


def _sum_by(key: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by key, one row for each of n keys."""
    order = np.argsort(key, kind="stable")
    found, begin = np.unique(key[order], return_index=True)
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[found] = np.add.reduceat(rows[order], begin, axis=0)
    return out


class Adam:
    def __init__(self, flat: np.ndarray):
        self.flat, self.t = flat.copy(), 0
        self.m, self.v = np.zeros_like(flat), np.zeros_like(flat)

    def step(self, g: np.ndarray, rate: float) -> None:
        self.t += 1
        self.m += np.float32(0.1) * (g - self.m)
        np.square(g, out=g)
        g -= self.v
        g *= np.float32(0.01)
        self.v += g
        scale = np.sqrt(self.v)
        scale *= np.float32((1 - 0.99**self.t) ** -0.5)
        scale += np.float32(1e-8)
        np.divide(self.m, scale, out=scale)
        scale *= np.float32(rate / (1 - 0.9**self.t))
        self.flat -= scale


def cut(x: np.ndarray) -> np.ndarray:
    """Windows (WINDOW + 1 buckets) of a stream x that starts with an end token.

    The last window ends with the stream, and a stream shorter than a window gets more end tokens in front, so together they
    predict each bucket at least once."""
    n = len(x) - 1
    if n < 1:
        return np.zeros((0, WINDOW + 1), x.dtype)
    if n < WINDOW:
        x, n = np.concatenate([np.full(WINDOW - n, x[0], x.dtype), x]), WINDOW
    begin = np.minimum(np.arange(0, n, WINDOW), n - WINDOW)
    return x[begin[:, None] + np.arange(WINDOW + 1)]


def train_windows(
    flat: np.ndarray, t: Tables, windows: np.ndarray, rate: float, min_steps: int, step: int = STEP
) -> np.ndarray:
    """The parameters after steps over all windows (rows of WINDOW + 1 buckets), in a fixed shuffled order; few windows are
    gone through up to MAX_EPOCHS times to make min_steps."""
    if not len(windows):
        return flat
    one_thread()
    opt = Adam(flat)
    order = np.random.default_rng(3).permutation(len(windows))
    once = -(-len(order) // step)
    steps = max(once, min(min_steps, MAX_EPOCHS * once))
    for k in range(steps):
        at = k % once * step
        _, g = gradient(named(opt.flat, t), t, windows[order[at : at + step]], tell=False)
        opt.step(g, rate * min(1.0, 1.5 * (steps - k) / steps))
    return opt.flat


def score_streams(flat: np.ndarray, t: Tables, ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """Natural log probability of each stream: ids end to end, sizes of the streams, each closed by its end token.

    A stream begins after an end token. Windows overlap by OVERLAP inputs, which give context and aren't scored again.
    """
    out = np.zeros(len(sizes))
    if not len(ids):
        return out
    one_thread()
    begin = np.cumsum(sizes) - sizes
    target = t.bucket[ids]
    given = np.empty_like(target)
    given[1:] = target[:-1]
    given[begin] = t.bucket[end]
    step = WINDOW - OVERLAP
    count = 1 + np.maximum(0, -(-(sizes - WINDOW) // step))
    owner = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start, left = begin[owner] + k * step, sizes[owner] - k * step
    p = named(flat, t)
    logp = np.zeros(len(ids), np.float64)
    span = np.arange(WINDOW)
    for at in range(0, len(owner), BLOCK):
        hidden, wanted = [], []
        for lo in range(at, min(at + BLOCK, len(owner)), BATCH):
            hi = min(lo + BATCH, at + BLOCK)
            place = np.minimum(start[lo:hi, None] + span, len(ids) - 1)
            z, _ = forward(p, given[place])
            use = ((span < left[lo:hi, None]) & ((k[lo:hi, None] == 0) | (span >= OVERLAP))).ravel()
            hidden.append(z[use])
            wanted.append(place.ravel()[use])
        where = np.concatenate(wanted)
        logp[where] = log_probability(p, t, np.concatenate(hidden), given[where], target[where])
    logp += t.own_logp[ids]
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), logp, len(sizes))
