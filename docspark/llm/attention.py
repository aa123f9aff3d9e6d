"""A small causal self-attention model over subword ids, in numpy.

A window has CONTEXT + SCORED inputs; each of its last SCORED inputs attends to itself and what stands before it in the window and predicts
the next id, in three steps: one of SUPERS groups of classes, one of the WITHIN classes of that group, and the id by its share of its class in the corpus.
Frequent ids are classes of their own, others are grouped by the company they keep. Windows overlap by CONTEXT, so every id is scored exactly once.

The prediction is mixed, with weights fitted by expectation maximisation, with the corpus's own counts of pairs of pieces within words.
"""

from __future__ import annotations

import numpy as np

CONTEXT, SCORED = 8, 24
WIDTH, HIDDEN = 16, 32
#: Ids that are classes of their own; classes are SUPERS * WITHIN.
SINGLES, SUPERS, WITHIN = 64, 16, 16
CLASSES = SUPERS * WITHIN
BATCH, EPOCHS, RATE = 128, 3, 8e-3
#: Windows scored at once; bounds the memory of a batch whatever the length of its texts.
SCORE_WINDOWS = 256
#: Steps in which shares of two probabilities are counted.
SHARES = 1000

T = CONTEXT + SCORED
LAG = np.arange(CONTEXT, T)[:, None] - np.arange(T)[None, :]
AHEAD = np.where(LAG < 0, np.float32(-1e9), np.float32(0))
#: A product with ones sums short rows several times faster than `sum`; windows have more places than groups have classes.
ONES = np.ones(T, np.float32)


def windows_of(ids: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of a text's windows, (n, T) and (n, SCORED), -1 where there is nothing. begin, end: ids around the text."""
    stream = np.concatenate([[begin], ids, [end]]).astype(np.int32)
    n = len(stream) - 1  # targets
    count = -(-n // SCORED)
    at = np.arange(count)[:, None] * SCORED + np.arange(-CONTEXT, SCORED)
    inputs = np.where((at >= 0) & (at < n), stream[np.clip(at, 0, n - 1)], -1)
    to = at[:, CONTEXT:]
    return inputs, np.where(to < n, stream[1 + np.clip(to, 0, n - 1)], -1)


def company_of(met: np.ndarray, top: np.ndarray, size: int, inputs: np.ndarray) -> np.ndarray:
    """For each id of `met`: which of the `top` ids stand in its windows, before it and after it, as square roots of shares."""
    place = np.full(size + 1, len(top), np.int64)
    place[top] = np.arange(len(top))
    wide, flat = len(top) + 1, inputs.reshape(-1)
    near = np.zeros((len(inputs), wide), np.float32)
    np.add.at(near, (np.repeat(np.arange(len(inputs)), T), place[flat]), (flat >= 0).astype(np.float32))
    row = np.full(size + 1, -1)
    row[met] = np.arange(len(met))
    company, before, after = (np.zeros((len(met), wide), np.float32) for _ in range(3))
    for k in range(T):
        own = row[inputs[:, k]]
        use = (own >= 0) & (inputs[:, k] >= 0)
        np.add.at(company, own[use], near[use])
        if k:
            np.add.at(before, (own[use], place[inputs[use, k - 1]]), 1)
        if k + 1 < T:
            np.add.at(after, (own[use], place[inputs[use, k + 1]]), 1)
    return np.concatenate([np.sqrt(m / np.maximum(m.sum(1, keepdims=True), 1)) for m in (company, before, after)], 1)


def company_keys(streams: list[np.ndarray], places: np.ndarray, wide: int) -> np.ndarray:
    """A number for each id and neighbour of it in `streams`: (id * 3 + kind) * wide + place of the neighbour; kinds: one or two places away, just before, just after. places: of ids, one more for the rest."""
    gap = np.full(2, -1)
    ids = np.concatenate([x for s in streams for x in (gap, s)]).astype(np.int64)
    out = []
    for lag in (1, 2):
        a, b = ids[:-lag], ids[lag:]
        both = (a >= 0) & (b >= 0)
        a, b = a[both], b[both]
        out += [b * 3 * wide + places[a], a * 3 * wide + places[b]]
        if lag == 1:
            out += [(b * 3 + 1) * wide + places[a], (a * 3 + 2) * wide + places[b]]
    return np.concatenate(out)


def places_of(counts: np.ndarray) -> np.ndarray:
    """The SINGLES most frequent ids by number, SINGLES for all others."""
    top = np.argsort(-counts, kind="stable")[:SINGLES]
    places = np.full(len(counts), len(top), np.int64)
    places[top] = np.arange(len(top))
    return places


def company_vectors(key: np.ndarray, count: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and of each square roots of shares, from counted company_keys."""
    ids, at = np.unique(key // (3 * wide), return_inverse=True)
    vectors = np.zeros((len(ids), 3 * wide), np.float32)
    vectors[at, key % (3 * wide)] = count
    for k in range(3):
        part = vectors[:, k * wide : (k + 1) * wide]
        np.sqrt(part / np.maximum(part.sum(1, keepdims=True), 1), out=part)
    return ids, vectors


def halved(vectors: np.ndarray, times: int) -> np.ndarray:
    """An order of the vectors in which each half, quarter and so on holds like ones: split in the middle along the main direction."""
    order = np.arange(len(vectors))
    for level in range(times):
        for part in np.split(order, 1 << level):
            centred = vectors[part] - vectors[part].mean(0)
            part[:] = part[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]
    return order


def classes_of(counts: np.ndarray, inputs: np.ndarray, seed: int = 3, company: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A class for each id: SINGLES frequent ids alone, others by k-means over the company they keep; ids without any by hash. Like classes are in one group.

    company: ids and vectors, from more texts than `inputs` hold.
    """
    rng, size, groups = np.random.default_rng(seed), len(counts), CLASSES - SINGLES
    top = np.argsort(-counts, kind="stable")[:SINGLES]
    if company is None:
        met = np.unique(np.concatenate([top, inputs[inputs >= 0]]))
        vectors = company_of(met, top, size, inputs)
    else:
        met = np.unique(np.concatenate([top, company[0]]))
        vectors = np.zeros((len(met), company[1].shape[1]), np.float32)
        vectors[np.searchsorted(met, company[0])] = company[1]
    alone = np.isin(met, top)
    rest = vectors[~alone]
    centres = np.zeros((groups, vectors.shape[1]), np.float32)
    out = SINGLES + (np.arange(size) * 0x9E3779B1 >> 7) % groups
    if len(rest):
        centres[: min(groups, len(rest))] = rest[rng.choice(len(rest), min(groups, len(rest)), replace=False)]
        for _ in range(8):
            nearest = np.argmax(rest @ centres.T - 0.5 * (centres * centres).sum(1), 1)
            number = np.bincount(nearest, minlength=groups)
            total = np.zeros_like(centres)
            np.add.at(total, nearest, rest)
            centres = np.where(number[:, None] > 0, total / np.maximum(number, 1)[:, None], centres)
        out[met[~alone]] = SINGLES + nearest
    singles = np.zeros((SINGLES, vectors.shape[1]), np.float32)
    singles[: len(top)] = vectors[np.searchsorted(met, top)]
    out[top] = np.arange(len(top))
    place = np.empty(CLASSES, np.int64)
    place[halved(np.concatenate([singles, centres]), SUPERS.bit_length() - 1)] = np.arange(CLASSES)
    return place[out]


class Pairs:
    """Share of an id after the piece before it, from counts of pairs; after a piece that ends a word, after `start`.

    key: previous id << 32 | id, sorted, with its count; ids in no pair get their share of all ids, as much as the context is varied.
    """

    def __init__(self, key: np.ndarray, count: np.ndarray, ids: np.ndarray, ends: np.ndarray):
        self.key, self.count, self.ends, self.start = key, count.astype(np.float32), ends, len(ids)
        before = key >> 32
        total = np.bincount(before, count, self.start + 1)
        back = 1 + 0.3 * np.bincount(before, minlength=self.start + 1)
        self.back, self.scale = back.astype(np.float32), (1 / (total + back)).astype(np.float32)
        self.share = ((ids + 0.5) / (ids + 0.5).sum()).astype(np.float32)

    def contexts(self, before: np.ndarray) -> np.ndarray:
        return np.where(self.ends[before], self.start, before)

    def probability(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """before: ids, or `start`."""
        context = np.where(before == self.start, before, self.contexts(np.minimum(before, self.start - 1)))
        wanted = context.astype(np.int64) << 32 | ids
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            seen = np.where(self.key[at] == wanted, self.count[at], np.float32(0))
        else:
            seen = np.float32(0)
        return (seen + self.back[context] * self.share[ids]) * self.scale[context]


class Attention:
    def __init__(self, counts: np.ndarray, pairs: Pairs, inputs: np.ndarray, targets: np.ndarray, seed: int = 5, company: tuple[np.ndarray, np.ndarray] | None = None):
        """counts, pairs, company: of the whole corpus; inputs, targets: windows that training begins with."""
        self.pairs, self.mix = pairs, np.array([0.5, 0.5])  # weight of attention after a word's end, and within a word
        self.cls = classes_of(counts, inputs, company=company)
        smooth = counts + 0.5
        share = np.bincount(self.cls, smooth, CLASSES)
        self.inside = np.log(smooth / share[self.cls]).astype(np.float32)
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        both = np.maximum(share, 1e-3).reshape(SUPERS, WITHIN)
        self.p = {
            "e": draw(len(counts), WIDTH, scale=0.5), "q": draw(WIDTH, WIDTH, scale=0.25), "k": draw(WIDTH, WIDTH, scale=0.25), "v": draw(WIDTH, WIDTH, scale=0.25),
            "lag": np.zeros(T, np.float32), "w": draw(WIDTH, HIDDEN, scale=0.25), "b": np.zeros(HIDDEN, np.float32),
            "c1": draw(HIDDEN, SUPERS, scale=0.1), "prior1": np.log(both.sum(1) / both.sum()).astype(np.float32), "pair1": np.zeros((CLASSES, SUPERS), np.float32),
            "c2": draw(SUPERS, HIDDEN, WITHIN, scale=0.1), "prior2": np.log(both / both.sum(1, keepdims=True)).astype(np.float32), "pair2": np.zeros((CLASSES * SUPERS, WITHIN), np.float32),
        }
        known = np.zeros(len(counts), bool)
        known[inputs[inputs >= 0]] = True
        if company is not None:
            known[company[0]] = True
        self.p["e"][~known] = 0  # an id that no window holds says nothing
        self.train(inputs, targets, rng)
        self.prepare()

    def prepare(self) -> None:
        """What scoring looks up, from the parameters."""
        p = self.p
        # of each id: what it adds, its key and its value side by side, and its query; one more row for where there is no id
        row = np.concatenate([p["e"], p["e"] @ p["k"], p["e"] @ p["v"]], 1)
        self.rows = np.concatenate([row, np.zeros((1, 3 * WIDTH), np.float32)])
        self.queries = np.concatenate([p["e"] @ p["q"] / np.float32(WIDTH**0.5), np.zeros((1, WIDTH), np.float32)])
        norm = lambda m: float(np.sqrt((m * m).sum(1)).max())
        self.large = norm(self.queries) * norm(row[:, WIDTH : 2 * WIDTH]) + np.abs(p["lag"]).max() > 80  # then exponents are held down
        self.follow1 = p["pair1"] + p["prior1"]
        self.follow2 = (p["pair2"].reshape(CLASSES, SUPERS, WITHIN) + p["prior2"]).reshape(CLASSES * SUPERS, WITHIN)
        self.space: dict[str, np.ndarray] = {}

    def compared(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """(2, SHARES): of targets after a word's end, and within a word, how many have which share of attention in the sum of both probabilities."""
        own, other, inner = self.parts(inputs, targets)
        share = np.minimum(own / np.maximum(own + other, 1e-30) * SHARES, SHARES - 1).astype(np.int64)
        return np.bincount(inner * SHARES + share, minlength=2 * SHARES).reshape(2, SHARES).astype(np.float64)

    def fit_mix(self, compared: np.ndarray) -> None:
        """Weights of attention against pairs, by expectation maximisation over counts of compared()."""
        share = (np.arange(SHARES) + 0.5) / SHARES
        for _ in range(20):
            weight = self.mix[:, None]
            part = weight * share / (weight * share + (1 - weight) * (1 - share))
            self.mix = np.clip(((compared * part).sum(1) + 1) / (compared.sum(1) + 2), 0.01, 0.99)

    def train(self, inputs: np.ndarray, targets: np.ndarray, rng, epochs: int = EPOCHS, rate: float = RATE) -> None:
        """Adam on the cross-entropy of classes; of embeddings only those in the batch move."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, max(1, epochs * -(-len(inputs) // BATCH))
        warm = max(1, min(20, steps // 4))
        for _ in range(epochs):
            order = rng.permutation(len(inputs))
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                step += 1
                now = rate * min(1, step / warm) * (1 - 0.95 * step / steps) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for name, (at, g) in self.gradients(inputs[rows], targets[rows]).items():
                    m, v = 0.9 * first[name][at] + 0.1 * g, 0.999 * second[name][at] + 0.001 * (g * g)
                    first[name][at], second[name][at] = m, v
                    self.p[name][at] -= (now * m / (np.sqrt(v) + 1e-8)).astype(np.float32)

    def grouped(self, group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order that brings targets of a group together, and (group, from, to) of those that are there."""
        order = np.argsort(group.astype(np.int8), kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=SUPERS)).tolist()
        return order, [(s, a, b) for s, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]

    def gradients(self, inputs: np.ndarray, targets: np.ndarray) -> dict[str, tuple]:
        """For each parameter: which of its rows the gradient is for, and the gradient."""
        p, root = self.p, np.float32(WIDTH**0.5)
        there = inputs >= 0
        x = p["e"][inputs] * there[..., None]
        own = x[:, CONTEXT:]
        q, k, v = own @ p["q"], x @ p["k"], x @ p["v"]
        s = q @ k.transpose(0, 2, 1) / root + p["lag"][np.maximum(LAG, 0)] + AHEAD + np.where(there, np.float32(0), np.float32(-1e9))[:, None, :]
        a = np.exp(s - s.max(2, keepdims=True))
        a /= (a @ ONES)[..., None]
        h = (own + a @ v).reshape(-1, WIDTH)
        to = targets.reshape(-1)
        use = np.flatnonzero(to >= 0)
        z = np.maximum(h @ p["w"] + p["b"], 0)[use]
        last, cls = self.cls[inputs[:, CONTEXT:].reshape(-1)[use]], self.cls[to[use]]
        group, within = cls // WITHIN, cls % WITHIN

        def softmax(logits, right):
            g = np.exp(np.minimum(logits, np.float32(80)))
            g /= (g @ ONES[: g.shape[1]])[:, None]
            g.reshape(-1)[np.arange(len(g)) * g.shape[1] + right] -= 1
            return g / np.float32(max(1, len(use)))

        g1 = softmax(z @ p["c1"] + p["prior1"] + p["pair1"][last], group)
        order, parts = self.grouped(group)
        zs, where = z[order], (last * SUPERS + group)[order]
        logits = p["pair2"][where]
        for s_, a_, b_ in parts:
            logits[a_:b_] += zs[a_:b_] @ p["c2"][s_] + p["prior2"][s_]
        g2 = softmax(logits, within[order])
        c2, prior2, back = np.zeros_like(p["c2"]), np.zeros_like(p["prior2"]), np.empty_like(zs)
        for s_, a_, b_ in parts:
            c2[s_], prior2[s_], back[a_:b_] = zs[a_:b_].T @ g2[a_:b_], g2[a_:b_].sum(0), g2[a_:b_] @ p["c2"][s_].T
        dzu = g1 @ p["c1"].T
        dzu[order] += back
        dz = np.zeros((len(to), HIDDEN), p["w"].dtype)
        dz[use] = dzu * (z > 0)
        dh = (dz @ p["w"].T).reshape(own.shape)
        da = dh @ v.transpose(0, 2, 1)
        ds = a * (da - ((da * a) @ ONES)[..., None])
        dq, dk, dv = ds @ k / root, ds.transpose(0, 2, 1) @ q / root, a.transpose(0, 2, 1) @ dh
        dx = dk @ p["k"].T + dv @ p["v"].T
        dx[:, CONTEXT:] += dh + dq @ p["q"].T
        dx *= there[..., None]

        def summed(keys, values):
            if not len(keys):
                return keys, values
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(values[order], first, axis=0)

        seen = inputs.reshape(-1)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        every = slice(None)
        return {
            "e": summed(seen[seen >= 0], flat(dx)[seen >= 0]), "q": (every, flat(own).T @ flat(dq)), "k": (every, flat(x).T @ flat(dk)), "v": (every, flat(x).T @ flat(dv)),
            "lag": (every, np.bincount(np.maximum(LAG, 0).reshape(-1), ds.sum(0).reshape(-1), T).astype(np.float32)), "w": (every, h.T @ dz), "b": (every, dz.sum(0)),
            "c1": (every, z.T @ g1), "prior1": (every, g1.sum(0)), "pair1": summed(last, g1), "c2": (every, c2), "prior2": (every, prior2), "pair2": summed(where, g2),
        }

    def room(self, name: str, *shape: int) -> np.ndarray:
        """Scratch space that is kept from call to call: fresh large arrays cost more than what is computed in them."""
        need = int(np.prod(shape))
        if name not in self.space or self.space[name].size < need:
            self.space[name] = np.empty(need, np.float32)
        return self.space[name][:need].reshape(shape)

    def __getstate__(self):
        return self.__dict__ | {"space": {}}

    def attend(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """The probability by attention of each target there is, in order."""
        p, found = self.p, []
        lag = p["lag"][np.maximum(LAG, 0)] + AHEAD
        for at in range(0, len(inputs), SCORE_WINDOWS):
            i, to = inputs[at : at + SCORE_WINDOWS], targets[at : at + SCORE_WINDOWS].reshape(-1)
            n, own = len(i), np.ascontiguousarray(i[:, CONTEXT:])
            x = np.take(self.rows, i, axis=0, mode="wrap", out=self.room("x", n, T, 3 * WIDTH))  # -1 is the last row
            q = np.take(self.queries, own, axis=0, mode="wrap", out=self.room("q", n, SCORED, WIDTH))
            s = np.matmul(q, x[:, :, WIDTH : 2 * WIDTH].transpose(0, 2, 1), out=self.room("s", n, SCORED, T))
            s += lag
            some = np.flatnonzero(i.min(1) < 0)
            if len(some):  # a text's first and last window; a row without any key has equal shares of nothing
                s[some] = np.maximum(s[some] + np.where(i[some] >= 0, np.float32(0), np.float32(-1e9))[:, None, :], np.float32(-80))
            if self.large:
                np.minimum(s, np.float32(80), out=s)
            np.exp(s, out=s)
            h = np.matmul(s, x[:, :, 2 * WIDTH :], out=self.room("h", n, SCORED, WIDTH))
            h /= (s.reshape(-1, T) @ ONES).reshape(n, SCORED, 1)
            h += x[:, CONTEXT:, :WIDTH]
            h, before = h.reshape(-1, WIDTH), own.reshape(-1)
            if to.min() < 0:
                use = np.flatnonzero(to >= 0)
                h, to, before = h[use], to[use], before[use]
            n = len(to)
            if not n:
                continue
            z = np.matmul(h, p["w"], out=self.room("z", n, HIDDEN))
            z += p["b"]
            np.maximum(z, 0, out=z)
            last, cls = np.take(self.cls, before, mode="clip"), np.take(self.cls, to)
            group, every = cls // WITHIN, np.arange(n)

            def log_share(logits, right):
                np.minimum(logits, np.float32(80), out=logits)
                own = np.take(logits.reshape(-1), every * logits.shape[1] + right)
                np.exp(logits, out=logits)
                return own - np.log(logits @ ONES[: logits.shape[1]])

            logits = np.matmul(z, p["c1"], out=self.room("l1", n, SUPERS))
            logits += np.take(self.follow1, last, axis=0, mode="clip", out=self.room("f", n, SUPERS))
            out = log_share(logits, group) + np.take(self.inside, to)
            order, parts = self.grouped(group)
            zs = np.take(z, order, axis=0, out=self.room("zs", n, HIDDEN), mode="clip")
            logits = self.room("l2", n, WITHIN)
            for k, a, b in parts:
                np.matmul(zs[a:b], p["c2"][k], out=logits[a:b])
            logits += np.take(self.follow2, (last * SUPERS + group)[order], axis=0, mode="clip", out=self.room("f", n, WITHIN))
            out[order] += log_share(logits, (cls % WITHIN)[order])
            found.append(np.exp(out))
        return np.concatenate(found) if found else np.empty(0, np.float32)

    def parts(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each target there is, in order: its probability by attention, by pairs, and 1 within a word, else 0."""
        to = targets.reshape(-1)
        use = np.flatnonzero(to >= 0)
        before = inputs[:, CONTEXT:].reshape(-1)[use]
        return self.attend(inputs, targets).astype(np.float64), self.pairs.probability(before, to[use]), np.where(self.pairs.ends[before], 0, 1)
