"""A small causal self-attention model in numpy: forward, backward, training and scoring of subword ids.

One attention layer reads windows of two blocks of `BLOCK` positions that overlap by one: a position attends to itself and to what
precedes it in its own block and the block before, never over the start of its text, and each id is scored once, in the
later half of its window. A feed-forward layer follows, and a softmax in two steps: the class of the next id, then the id within
the class (both start from the ids' counts in the corpus, which are biases). The steps keep the cost of an id near twice the root
of the vocabulary. Ids without a count share one place, evenly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

DIM, HIDDEN, BLOCK = 16, 32, 8
#: Ids of a training step; ids that pass the layers at once, and that wait for the second step of the softmax.
BATCH, CHUNK, STORE = 4096, 1 << 12, 1 << 15
OFF = np.float32(-1e9)


@dataclass
class Vocabulary:
    """Places of ids: 0 is the most frequent one; the last place holds all ids without a count."""

    place: np.ndarray
    counts: np.ndarray
    unseen: int

    @classmethod
    def of(cls, counts: np.ndarray) -> Vocabulary:
        order = np.argsort(-counts, kind="stable")
        seen = int((counts > 0).sum())
        place = np.full(len(counts), seen, np.int32)
        place[order[:seen]] = np.arange(seen)
        return cls(place, np.append(counts[order[:seen]], 1.0), len(counts) - seen)

    @property
    def class_size(self) -> int:
        return int(np.ceil(np.sqrt(len(self.counts))))


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    vocabulary: Vocabulary
    tables: tuple = field(default=(), repr=False)

    @classmethod
    def fresh(cls, vocabulary: Vocabulary, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        n, size = len(vocabulary.counts), vocabulary.class_size
        classes = -(-n // size)
        normal = lambda scale, *shape: (rng.normal(size=shape) * scale).astype(np.float32)
        counts = np.zeros(classes * size)
        counts[:n] = vocabulary.counts
        with np.errstate(divide="ignore"):
            item_bias = np.maximum(np.log(counts.reshape(classes, size)), OFF).astype(np.float32)
        weights = {
            "embed": normal(0.1, n, DIM), "query": normal(DIM**-0.5, DIM, DIM), "key": normal(DIM**-0.5, DIM, DIM), "value": normal(DIM**-0.5, DIM, DIM),
            "near": np.zeros(2 * BLOCK, np.float32), "up": normal(DIM**-0.5, DIM, HIDDEN), "up_bias": np.zeros(HIDDEN, np.float32), "down": normal(0.1 * HIDDEN**-0.5, HIDDEN, DIM),
            "classes": normal(0.1, DIM, classes), "class_bias": np.log(counts.reshape(classes, size).sum(axis=1)).astype(np.float32), "items": normal(0.1, classes, size, DIM), "item_bias": item_bias,
        }
        return cls(weights, vocabulary)

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def with_flat(self, values: np.ndarray) -> Model:
        out, at = {}, 0
        for name, w in self.weights.items():
            out[name] = values[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return Model(out, self.vocabulary)

    def prepared(self) -> Model:
        """With the projections of every id, so that scoring looks them up."""
        w = self.weights
        e = w["embed"]
        one = np.ones((len(e), 1), np.float32)  # beside the values: its weighted sum is the sum of the weights
        table = np.hstack([e, e @ w["query"] * np.float32(DIM**-0.5), e @ w["key"], e @ w["value"], one])
        largest = lambda m: float(np.sqrt((m.astype(float) ** 2).sum(axis=-1).max()))
        # each bias stands below its weights, for the one beside the layers' output
        classes = np.vstack([w["classes"], w["class_bias"] - w["class_bias"].max()])
        items = np.concatenate([w["items"].transpose(0, 2, 1), (w["item_bias"] - w["item_bias"].max(axis=1, keepdims=True))[:, None]], axis=1)
        bounds = largest(table[:, DIM : 2 * DIM]) * largest(table[:, 2 * DIM : 3 * DIM]) + float(np.abs(w["near"]).max()), max(largest(w["classes"].T), largest(w["items"]))
        self.tables = (table, _distances(w["near"]), np.ascontiguousarray(classes), np.ascontiguousarray(items), *bounds)
        return self


def _distances(near: np.ndarray) -> np.ndarray:
    """What the distance adds to the logits of the window's keys, for each position of a block; later keys are off."""
    back = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)
    return np.where(back >= 0, near[np.clip(back, 0, 2 * BLOCK - 1)], OFF).astype(near.dtype)


def _windows(x: np.ndarray) -> np.ndarray:
    """Blocks (n, BLOCK, d) with the block before each: (n, 2 BLOCK, d); nothing stands before the first."""
    out = np.empty((len(x), 2 * BLOCK, x.shape[2]), x.dtype)
    out[:, BLOCK:] = x
    out[1:, :BLOCK] = x[:-1]
    out[0, :BLOCK] = 0
    return out


def _turned(m: np.ndarray) -> np.ndarray:
    """Each matrix transposed, as a copy: products with it are several times faster."""
    return np.ascontiguousarray(m.transpose(0, 2, 1))


def _logits(q: np.ndarray, k: np.ndarray, near: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Logits of the window's keys for each position, masked; start: where each position's text begins."""
    blocks = len(q)
    a = q @ _turned(k)
    a += near
    first = start.reshape(blocks, BLOCK) - (np.arange(blocks)[:, None] - 1) * BLOCK
    cut = np.flatnonzero(first.max(axis=1) > 0)
    if len(cut):
        a[cut] = np.where(np.arange(2 * BLOCK) < first[cut][:, :, None], OFF, a[cut])
    return a


def _row_sums(m: np.ndarray) -> np.ndarray:
    """Sums over the last axis, kept; one product, since rows are short."""
    return (m.reshape(-1, m.shape[-1]) @ np.ones(m.shape[-1], m.dtype)).reshape(*m.shape[:-1], 1)


def _largest(m: np.ndarray) -> float:
    """The largest length of the vectors along the last axis."""
    return float(np.sqrt(_row_sums(m * m).max(initial=0)))


def _attention(q: np.ndarray, k: np.ndarray, near: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Shares of the window's keys for each position."""
    a = _logits(q, k, near, start)
    if _largest(q) * _largest(k) + float(np.abs(near[near > OFF]).max()) > SAFE:
        a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a /= _row_sums(a)
    return a


def _shares_less_own(z: np.ndarray, own: np.ndarray, n, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(the gradient of the mean of n losses by the logits z, the probabilities of the targets) where each row's target is `own`; z is overwritten."""
    if not safe:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    at = np.arange(0, z.size, z.shape[1]) + own
    z /= _row_sums(z)
    flat = z.ravel()
    mine = flat.take(at)
    flat[at] = mine - 1
    z *= 1 / n
    return z, mine


#: Logits whose parts from the layers are at most this size need no shift before their exponentials are summed: of the biases beside
#: them the largest is 0.
SAFE = 80.0


def _log_total(z: np.ndarray, safe: bool) -> np.ndarray:
    """Log of the sum of exponentials of each row; z is overwritten."""
    if safe:
        return np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32))
    top = z.max(axis=1)
    z -= top[:, None]
    return np.log(np.exp(z, out=z).sum(axis=1)) + top


def log_probabilities(model: Model, x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Natural log probability of each place in y after what precedes it: x are the inputs, start[i] where i's text begins. 0 where y < 0."""
    size, most_weight = model.vocabulary.class_size, model.tables[-1]
    classes, items = model.tables[2:4]
    out = np.empty(len(y))
    for first in range(0, len(y), STORE):  # ids of a class are many enough here for one product
        last = min(first + STORE, len(y))
        h, found = np.empty((last - first, DIM + 1), np.float32), np.empty(last - first, np.float32)
        cls, item = np.divmod(np.maximum(y[first:last], 0).astype(np.int32), np.int32(size))
        for at in range(first, last, CHUNK):
            upto = min(at + CHUNK, last)
            part = slice(at - first, upto - first)
            h[part] = _hidden(model, x, start, at, upto)
        safe = most_weight * _largest(h[:, :DIM]) < SAFE
        for at in range(0, last - first, CHUNK):
            part = slice(at, min(at + CHUNK, last - first))
            z = h[part] @ classes
            found[part] = z.ravel().take(np.arange(0, z.size, z.shape[1]) + cls[part])
            found[part] -= _log_total(z, safe)
        order = np.argsort(cls.astype(np.int16), kind="stable")
        h, item = h.take(order, axis=0), item.take(order)
        cuts = np.searchsorted(cls.take(order), np.arange(len(items) + 1)).tolist()
        within = np.empty(len(h), np.float32)
        for c, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for at in range(a, b, CHUNK):
                part = slice(at, min(at + CHUNK, b))
                z = h[part] @ items[c]
                within[part] = z.ravel().take(np.arange(0, z.size, z.shape[1]) + item[part])
                within[part] -= _log_total(z, safe)
        found[order] += within
        out[first:last] = found
    last = len(model.vocabulary.counts) - 1
    out[y == last] -= np.log(max(1, model.vocabulary.unseen))
    out[y < 0] = 0
    return out


def _hidden(model: Model, x: np.ndarray, start: np.ndarray, at: int, upto: int) -> np.ndarray:
    """What the layers make of the inputs at:upto and their windows, and a one beside it."""
    w, (table, near, _, _, most_attention, _) = model.weights, model.tables
    before = min(at, BLOCK)
    n = upto - at + before
    pad = -n % BLOCK
    rows = table.take(np.append(x[at - before : upto], np.zeros(pad, x.dtype)), axis=0).reshape(-1, BLOCK, 4 * DIM + 1)
    begins = np.append(start[at - before : upto] - (at - before), np.full(pad, n))
    a = _logits(rows[:, :, DIM : 2 * DIM], _windows(rows[:, :, 2 * DIM : 3 * DIM]), near, begins)
    if most_attention > SAFE:
        a -= a.max(axis=2, keepdims=True)
    seen = np.exp(a, out=a) @ _windows(rows[:, :, 3 * DIM :])
    h = (rows[:, :, :DIM] + seen[:, :, :DIM] / seen[:, :, DIM:]).reshape(-1, DIM)[before:n]
    up = h @ w["up"]
    up += w["up_bias"]
    out = np.ones((len(h), DIM + 1), np.float32)
    out[:, :DIM] = h + np.maximum(up, 0, out=up) @ w["down"]
    return out


def loss_and_gradients(model: Model, x: np.ndarray, y: np.ndarray, start: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log probability (unseen ids as one) and its gradients; the number of ids is a multiple of BLOCK, and ids with y < 0 are left out."""
    w, size = model.weights, model.vocabulary.class_size
    g, scale = {}, np.float32(DIM**-0.5)
    cut = lambda m: m.reshape(-1, BLOCK, m.shape[1])
    e = w["embed"].take(x, axis=0)
    three = np.hstack([w["query"] * scale, w["key"], w["value"]])
    made = cut(e @ three)
    q, kv = made[:, :, :DIM], _windows(made[:, :, DIM:])
    k2, v2 = kv[:, :, :DIM], kv[:, :, DIM:]
    p = _attention(q, k2, _distances(w["near"]), start)
    h0 = e + (p @ v2).reshape(-1, DIM)
    z = h0 @ w["up"]
    z += w["up_bias"]
    np.maximum(z, 0, out=z)
    h = np.ones((len(x), DIM + 1), h0.dtype)
    h[:, :DIM] = h0 + z @ w["down"]
    used = np.flatnonzero(y >= 0)
    # ids of a class lie together
    cls, item = np.divmod(y[used].astype(np.int32), np.int32(size))
    order = np.argsort(cls.astype(np.int16), kind="stable")
    used, cls, item = used[order], cls[order], item[order]
    hu, n = h.take(used, axis=0), np.float32(max(1, len(used)))
    most = _largest(hu[:, :DIM])
    # biases less their largest stand below their weights, for the one beside h
    classes = np.vstack([w["classes"], w["class_bias"] - w["class_bias"].max()])
    safe = most * _largest(w["classes"].T) < SAFE
    dhu, likely, gc = np.empty_like(hu), np.empty(len(hu), hu.dtype), np.zeros_like(classes)
    for at in range(0, len(hu), CHUNK):
        part = slice(at, at + CHUNK)
        d, likely[part] = _shares_less_own(hu[part] @ classes, cls[part], n, safe)
        gc += hu[part].T @ d
        dhu[part] = d @ classes.T
    g["classes"], g["class_bias"] = gc[:DIM], gc[DIM]
    items = np.concatenate([w["items"], (w["item_bias"] - w["item_bias"].max(axis=1, keepdims=True))[:, :, None]], axis=2)
    gi, safe = np.zeros_like(items), most * _largest(w["items"]) < SAFE
    cuts = np.searchsorted(cls, np.arange(len(items) + 1)).tolist()
    for c, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            d, mine = _shares_less_own(hu[a:b] @ items[c].T, item[a:b], n, safe)
            likely[a:b] *= mine
            gi[c] = d.T @ hu[a:b]
            dhu[a:b] += d @ items[c]
    g["items"], g["item_bias"] = gi[:, :, :DIM], gi[:, :, DIM]
    dh = np.zeros_like(h0)
    dh[used] = dhu[:, :DIM]
    dz = dh @ w["down"].T
    dz *= z > 0
    g["down"], g["up"], g["up_bias"] = z.T @ dh, h0.T @ dz, np.ones(len(dz), dz.dtype) @ dz
    dh += dz @ w["up"].T
    dc = cut(dh)
    da = dc @ _turned(v2)
    da -= _row_sums(da * p)
    da *= p
    back = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)
    flat = da.sum(axis=0)
    g["near"] = np.bincount(back[back >= 0], flat[back >= 0], 2 * BLOCK).astype(flat.dtype)
    dkv = np.empty_like(kv)
    np.matmul(da.transpose(0, 2, 1), q, out=dkv[:, :, :DIM])
    np.matmul(p.transpose(0, 2, 1), dc, out=dkv[:, :, DIM:])
    d = np.empty_like(made)
    np.matmul(da, k2, out=d[:, :, :DIM])
    d[:, :, DIM:] = _unwindowed(dkv)
    d = d.reshape(-1, 3 * DIM)
    both = e.T @ d
    g["query"], g["key"], g["value"] = both[:, :DIM] * scale, both[:, DIM : 2 * DIM], both[:, 2 * DIM :]
    dh += d @ three.T
    g["embed"] = np.empty_like(w["embed"])
    for i, column in enumerate(np.ascontiguousarray(dh.T, float)):
        g["embed"][:, i] = np.bincount(x, column, len(w["embed"]))
    with np.errstate(divide="ignore"):
        return float(-np.log(likely).sum()) / float(n), g


def _unwindowed(x: np.ndarray) -> np.ndarray:
    out = x[:, BLOCK:].copy()
    out[:-1] += x[1:, :BLOCK]
    return out


def aligned(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(place of each id, start of its text, places in all) where every text begins a block: what precedes a text in the stream does not matter."""
    room = -(-sizes // BLOCK) * BLOCK
    starts = np.cumsum(room) - room
    first = np.repeat(starts, sizes)
    return first + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), first, int(room.sum())


def stream(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, starts, places): texts of the given sizes laid out in blocks; targets between them are -1."""
    place, first, total = aligned(sizes)
    out = np.zeros(total, np.int64), np.full(total, -1, np.int64), np.arange(total)
    for target, values in zip(out, (x, y, first), strict=True):
        target[place] = values
    return *out, place


def pieces_to_steps(texts: list[tuple[np.ndarray, bool]], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, starts) of stretches of places; True marks one that begins a text, whose first input is the end's place."""
    both = [(np.append(end, p[:-1]), p) if begins else (p[:-1], p[1:]) for p, begins in texts]
    empty = [np.zeros(0, np.int64)]
    xs, ys = (np.concatenate([b[k] for b in both] or empty).astype(np.int64) for k in (0, 1))
    return stream(xs, ys, np.array([len(x) for x, _ in both], np.int64))[:3]


class Trainer:
    """Adam from a model that stays as it is: `model` is what the batches have made of it so far."""

    def __init__(self, model: Model):
        self.model = Model({k: v.copy() for k, v in model.weights.items()}, model.vocabulary)
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
        self.steps = self.ids = 0

    def step(self, x: np.ndarray, y: np.ndarray, start: np.ndarray, rate: float) -> None:
        _, g = loss_and_gradients(self.model, x, y, start)
        self.steps, self.ids = self.steps + 1, self.ids + int((y >= 0).sum())
        now = rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for k, d in g.items():
            mean, square, w = self.mean[k], self.square[k], self.model.weights[k]
            mean += np.float32(0.1) * (d - mean)
            square += np.float32(0.01) * (d * d - square)
            w -= np.float32(now) * mean / (np.sqrt(square) + np.float32(1e-8))


def batches(x: np.ndarray, y: np.ndarray, start: np.ndarray, batch: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of whole blocks, the last one filled up with ids that count for nothing; texts begin within their batch."""
    count = -(-len(x) // batch)
    pad = count * batch - len(x)
    x, y, start = np.append(x, np.zeros(pad, x.dtype)), np.append(y, np.full(pad, -1)), np.append(start, np.full(pad, len(x)))
    return [(x[a : a + batch], y[a : a + batch], np.maximum(start[a : a + batch] - a, 0)) for a in range(0, count * batch, batch)]


def train(model: Model, x: np.ndarray, y: np.ndarray, start: np.ndarray, epochs: int, rate: float, seed: int = 9) -> Model:
    """Epochs over batches in random order, with a falling rate; the model given stays as it is."""
    if not len(x):
        return model
    parts, rng = batches(x, y, start, BATCH), np.random.default_rng(seed)
    trainer, steps = Trainer(model), epochs * len(parts)
    for _ in range(epochs):
        for b in rng.permutation(len(parts)):
            trainer.step(*parts[b], rate * (1 - 0.95 * (trainer.steps + 1) / steps))
    return trainer.model
