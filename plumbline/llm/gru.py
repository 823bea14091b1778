"""A gated recurrent language model in numpy with a class-factored output.

Ids 0 .. head - 1 are words, in classes of `WIDTH` by frequency; id 0 is the end of a
text, which also stands before its first word. Ids from head on are tail classes, of
which a word is told apart outside the model. P(word) = P(class | state) times
P(word | class, state), the second only for words of the head. Word vectors serve as
input and as output weights.
"""

from __future__ import annotations

import heapq

import numpy as np

SIZE, WIDTH = 24, 64
#: Streams learnt side by side, and steps of truncated backpropagation.
STREAMS, STEPS = 256, 24
RATE, CLIP = 0.03, 5.0
#: Streams of text scored side by side, and steps between two computations of the output.
LANES, WINDOW = 512, 32
_F = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Exponentials in place; their sums."""
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    return x.sum(1)


class Gru:
    """Parameters: word vectors, gates, and the output's classes and biases."""

    names = ("vectors", "input", "state", "bias", "classes", "class_bias", "word_bias")

    def __init__(self, head: int, tails: int, counts: np.ndarray, seed: int = 11):
        """counts: of the head's words, then of the tail classes, for the first biases."""
        rng = np.random.default_rng(seed)
        self.head, self.tails = head, tails
        self.groups = -(-head // WIDTH)
        self.vectors = rng.normal(0, 0.1, (self.groups * WIDTH + tails, SIZE)).astype(_F)
        self.input = rng.normal(0, SIZE**-0.5, (SIZE, 3 * SIZE)).astype(_F)
        self.state = rng.normal(0, SIZE**-0.5, (SIZE, 3 * SIZE)).astype(_F)
        self.bias = np.zeros(3 * SIZE, _F)
        self.classes = np.zeros((SIZE, self.groups + tails), _F)
        padded = np.zeros(self.groups * WIDTH)
        padded[:head] = counts[:head] + 0.5
        grouped = padded.reshape(self.groups, WIDTH)
        whole = np.r_[grouped.sum(1), counts[head:] + 0.5]
        self.class_bias = np.log(whole / whole.sum()).astype(_F)
        self.moments, self.updates = None, 0
        with np.errstate(divide="ignore"):
            self.word_bias = np.maximum(np.log(grouped / grouped.sum(1, keepdims=True)), -30).astype(_F)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.names])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for n in self.names:
            old = getattr(self, n)
            setattr(self, n, np.array(flat[at : at + old.size], _F).reshape(old.shape))
            at += old.size
        return self

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """The rows of the vectors: tail classes come after the padded head."""
        return np.where(ids < self.head, ids, ids - self.head + self.groups * WIDTH)

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.head, ids // WIDTH, ids - self.head + self.groups)

    def step(self, gates: np.ndarray, h: np.ndarray):
        """One step: the new state and what the way back needs."""
        own = h @ self.state
        zr = _sigmoid(gates[:, : 2 * SIZE] + own[:, : 2 * SIZE])
        z, r, o = zr[:, :SIZE], zr[:, SIZE:], own[:, 2 * SIZE :]
        n = r * o
        n += gates[:, 2 * SIZE :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, (z, r, n, o)

    def _by_class(self, target: np.ndarray):
        """The classes of the targets, an order by class, and where the groups of words begin in it."""
        kind = self.class_of(target).astype(np.int16)
        order = np.argsort(kind, kind="stable")
        return kind, order, np.searchsorted(kind[order], np.arange(self.groups + 1))

    def log_probabilities(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms of P(target | state) for rows of states."""
        kind, order, edges = self._by_class(target)
        logits = h @ self.classes
        logits += self.class_bias
        out = np.minimum(logits[np.arange(len(h)), kind], 80).astype(float)
        out -= np.log(_softmax(logits))
        held, place = h[order[: edges[-1]]], target[order[: edges[-1]]] % WIDTH
        inside = np.zeros(len(held))
        for c in range(self.groups):
            a, b = edges[c], edges[c + 1]
            if a < b:
                inner = held[a:b] @ self.vectors[c * WIDTH : (c + 1) * WIDTH].T
                inner += self.word_bias[c]
                chosen = np.minimum(inner[np.arange(b - a), place[a:b]], 80)
                inside[a:b] = chosen - np.log(_softmax(inner))
        out[order[: edges[-1]]] += inside
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """The natural log-likelihood of each text of ids with its end. Texts are laid one after
        another on lanes; a lane's state is carried from window to window, and is cleared
        only where a text begins."""
        out = np.zeros(len(texts))
        if not texts:
            return out
        lengths = np.array([len(t) + 1 for t in texts])
        lanes = min(LANES, len(texts))
        load, held = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
        heap = [(0, k) for k in range(lanes)]
        for t in np.argsort(-lengths, kind="stable").tolist():
            size, k = heapq.heappop(heap)
            held[k].append(t)
            load[k] = size + lengths[t]
            heapq.heappush(heap, (int(load[k]), k))
        order = np.argsort(-load, kind="stable")
        load = load[order]
        most = int(load[0])
        before, after = (np.zeros((most, lanes), np.int32) for _ in range(2))
        owner = np.zeros((most, lanes), np.int32)
        for lane, k in enumerate(order.tolist()):
            at = 0
            for t in held[k]:
                n = len(texts[t])
                before[at + 1 : at + n + 1, lane] = texts[t]
                after[at : at + n, lane] = texts[t]
                owner[at : at + n + 1, lane] = t
                at += n + 1
        table = self.vectors @ self.input + self.bias
        h = np.zeros((lanes, SIZE), _F)
        for t0 in range(0, most, WINDOW):
            t1 = min(t0 + WINDOW, most)
            active = int(np.searchsorted(-load, -t0, "left"))
            h = h[:active]
            states = np.zeros((t1 - t0, active, SIZE), _F)
            ids = before[t0:t1, :active]
            gates, go = table[self.rows(ids)], (ids != 0).astype(_F)[:, :, None]
            for t in range(t1 - t0):
                h, _ = self.step(gates[t], h * go[t])
                states[t] = h
            inside = np.arange(t0, t1)[:, None] < load[None, :active]
            logs = self.log_probabilities(states[inside], after[t0:t1, :active][inside])
            out += np.bincount(owner[t0:t1, :active][inside], logs, len(texts))
        return out

    def learn(self, texts: list[np.ndarray], rate: float = RATE) -> int:
        """One pass of truncated backpropagation through time with Adam over all the texts, dealt
        to streams whose state is carried from window to window. Adam's moments are kept from call to
        call. Returns the tokens learnt."""
        if not texts:
            return 0
        stream = np.concatenate([np.r_[t, 0] for t in texts]).astype(np.int32)
        told, lanes = len(stream), min(STREAMS, len(stream))
        per = -(-told // lanes)
        stream = np.resize(stream, per * lanes)  # streams of one length: the first tokens fill the last
        before = np.concatenate([np.zeros(1, np.int32), stream[:-1]])
        after, before = (np.ascontiguousarray(x.reshape(lanes, per).T) for x in (stream, before))
        self.moments = self.moments or [{n: np.zeros_like(getattr(self, n)) for n in self.names} for _ in range(2)]
        first, second = self.moments
        h = np.zeros((lanes, SIZE), _F)
        for t0 in range(0, per, STEPS):
            grads, h = self._window(before[t0 : t0 + STEPS], after[t0 : t0 + STEPS], h)
            self.updates += 1
            k = self.updates
            scale = _F(rate * (1 - 0.999**k) ** 0.5 / (1 - 0.9**k))
            for n, g in grads.items():
                np.clip(g, -CLIP, CLIP, out=g)
                first[n] *= _F(0.9)
                second[n] *= _F(0.999)
                first[n] += _F(0.1) * g
                np.square(g, out=g)
                g *= _F(0.001)
                second[n] += g
                np.sqrt(second[n], out=g)
                g += _F(1e-8)
                np.divide(first[n], g, out=g)
                g *= scale
                getattr(self, n)[...] -= g
        return told

    def _window(self, ids, target, h):
        steps, lanes = ids.shape
        rows = self.rows(ids)
        used = self.vectors[rows.ravel()]
        gates = (used @ self.input + self.bias).reshape(steps, lanes, 3 * SIZE)
        go = (ids != 0).astype(_F)[:, :, None]
        kept, states = [], np.zeros((steps, lanes, SIZE), _F)
        for t in range(steps):
            old = h * go[t]
            h, saved = self.step(gates[t], old)
            kept.append((old, *saved))
            states[t] = h
        flat, goal = states.reshape(-1, SIZE), target.ravel()
        size = _F(1 / len(flat))
        kind, order, edges = self._by_class(goal)
        p = flat @ self.classes
        p += self.class_bias
        p *= (size / _softmax(p))[:, None]
        p[np.arange(len(flat)), kind] -= size
        grads = {n: np.zeros_like(getattr(self, n)) for n in self.names}
        grads["classes"], grads["class_bias"] = flat.T @ p, p.sum(0)
        back = p @ self.classes.T
        held, place = flat[order[: edges[-1]]], goal[order[: edges[-1]]] % WIDTH
        inside = np.zeros_like(held)
        for c in range(self.groups):
            a, b = edges[c], edges[c + 1]
            if a < b:
                words = self.vectors[c * WIDTH : (c + 1) * WIDTH]
                q = held[a:b] @ words.T
                q += self.word_bias[c]
                q *= (size / _softmax(q))[:, None]
                q[np.arange(b - a), place[a:b]] -= size
                grads["vectors"][c * WIDTH : (c + 1) * WIDTH] = q.T @ held[a:b]
                grads["word_bias"][c] = q.sum(0)
                np.matmul(q, words, out=inside[a:b])
        back[order[: edges[-1]]] += inside
        back = back.reshape(steps, lanes, SIZE)
        d_gates, d_own = (np.zeros((steps, lanes, 3 * SIZE), _F) for _ in range(2))
        dh = np.zeros((lanes, SIZE), _F)
        turned = np.ascontiguousarray(self.state.T)
        for t in range(steps - 1, -1, -1):
            old, z, r, n, own = kept[t]
            dh += back[t]
            keep = dh * z
            dn = dh - keep
            dn *= 1 - n * n
            dz = dh * (old - n)
            dz *= z * (1 - z)
            dr = dn * own
            dr *= r * (1 - r)
            g, o = d_gates[t], d_own[t]
            g[:, :SIZE] = o[:, :SIZE] = dz
            g[:, SIZE : 2 * SIZE] = o[:, SIZE : 2 * SIZE] = dr
            g[:, 2 * SIZE :] = dn
            np.multiply(dn, r, out=o[:, 2 * SIZE :])
            keep += o @ turned
            dh = keep * go[t]
        flat_d = d_gates.reshape(-1, 3 * SIZE)
        olds = np.concatenate([k[0] for k in kept])
        grads["state"] = olds.T @ d_own.reshape(-1, 3 * SIZE)
        grads["bias"] = flat_d.sum(0)
        grads["input"] = used.T @ flat_d
        back = flat_d @ self.input.T
        order = np.argsort(rows.ravel(), kind="stable")
        at = rows.ravel()[order]
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        grads["vectors"][at[begin]] += np.add.reduceat(back[order], begin, axis=0)
        return grads, h
