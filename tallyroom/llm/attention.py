"""A small causal self-attention language model over subword ids, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Model ids: SIZE of SIDE classes of SIDE members; then the start of a text.
SIDE = 32
SIZE = SIDE * SIDE
START = SIZE
#: Width, hidden width, and a window's context and scored places.
WIDTH, HIDDEN, CONTEXT, SCORED = 16, 32, 16, 32
WINDOW = CONTEXT + SCORED
#: Windows whose states are computed at once, and told at once.
BLOCK, TOLD = 96, 1536
_EARLIER = (np.arange(WINDOW)[None] <= np.arange(CONTEXT, WINDOW)[:, None]).astype(np.float32)
_LATER = np.where(_EARLIER > 0, 0, -1e9).astype(np.float32)


class Model(NamedTuple):
    embed: np.ndarray  # (SIZE + 1, WIDTH)
    place: np.ndarray  # (WINDOW, WIDTH)
    query: np.ndarray  # (WIDTH, WIDTH), and so on
    key: np.ndarray
    value: np.ndarray
    mixed: np.ndarray
    up: np.ndarray  # (WIDTH, HIDDEN)
    up_bias: np.ndarray
    down: np.ndarray
    out: np.ndarray  # (WIDTH, SIDE) to classes
    out_bias: np.ndarray
    member: np.ndarray  # (SIDE, WIDTH, SIDE) to members of a class
    member_bias: np.ndarray


def new_model(counts: np.ndarray, seed: int) -> Model:
    """Random weights; biases that give each id its share of ``counts`` (SIZE)."""
    rng = np.random.default_rng(seed)

    def draw(*shape, size):
        return (rng.standard_normal(shape) * size).astype(np.float32)

    table = (counts.reshape(SIDE, SIDE) + 0.1).astype(np.float64)
    flat = WIDTH**-0.5
    return Model(
        draw(SIZE + 1, WIDTH, size=0.5), draw(WINDOW, WIDTH, size=0.2),
        draw(WIDTH, WIDTH, size=flat), draw(WIDTH, WIDTH, size=flat), draw(WIDTH, WIDTH, size=flat),
        draw(WIDTH, WIDTH, size=flat), draw(WIDTH, HIDDEN, size=flat), np.zeros(HIDDEN, np.float32),
        draw(HIDDEN, WIDTH, size=HIDDEN**-0.5), draw(WIDTH, SIDE, size=0.1),
        np.log(table.sum(1) / table.sum()).astype(np.float32), draw(SIDE, WIDTH, SIDE, size=0.1),
        np.log(table / table.sum(1, keepdims=True)).astype(np.float32),
    )


def windows(stream: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of texts in a stream, ``count`` ids from ``first`` on: ids read
    (-1 where there is none), ids to tell, and their places in the stream (-1 for none).
    Every id of a text is told once, from what stands before it; START stands before all."""
    number = -(-count // SCORED)
    text = np.repeat(np.arange(len(count)), number)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)) * SCORED
    if not len(text):
        none = np.empty((0, SCORED), dtype=np.int32)
        return np.empty((0, WINDOW), dtype=np.int32), none, none
    # Places fit 32 bits: a group of texts has far fewer ids.
    start, first, count = (x.astype(np.int32)[:, None] for x in (start, first[text], count[text]))
    told = start + np.arange(SCORED, dtype=np.int32)
    there = told < count
    at = np.where(there, first + told, np.int32(-1))
    read = start - CONTEXT - 1 + np.arange(WINDOW, dtype=np.int32)
    ids = stream.astype(np.int32)[np.clip(first + read, 0, len(stream) - 1)]
    ids[(read < -1) | (read >= count)] = -1
    ids[read == -1] = START
    return ids, np.where(there, stream[at], 0).astype(np.int32), at


#: Scores are kept within this, so that no exponential of a single number over- or underflows.
_EDGE = 80.0


def _raised(x: np.ndarray) -> np.ndarray:
    """exp(x) in place."""
    np.clip(x, -_EDGE, _EDGE, out=x)
    return np.exp(x, out=x)


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(x) in place, and its sums along the last axis."""
    x = _raised(x)
    return x, x @ np.ones(x.shape[-1], dtype=x.dtype)


def _softmax(x: np.ndarray) -> np.ndarray:
    x, total = _exponentials(x)
    x /= total[..., None]
    return x


def _seen(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows whose context has places without an id, and where each of them has one."""
    some = np.flatnonzero((ids[:, :CONTEXT] < 0).any(axis=1))
    return some, (ids[some] >= 0)[:, None, :]


def _states(m: Model, ids: np.ndarray):
    """States of the scored places (B * SCORED, WIDTH), and what the way back needs."""
    # START is the last row, and stands where there is no id.
    x = m.embed.take(ids, axis=0)
    x += m.place
    own = x[:, CONTEXT:].reshape(-1, WIDTH)
    q = (own @ (m.query * np.float32(WIDTH**-0.5))).reshape(-1, SCORED, WIDTH)
    kv = (x.reshape(-1, WIDTH) @ np.concatenate([m.key, m.value], axis=1)).reshape(*x.shape[:2], 2 * WIDTH)
    score = np.matmul(q, kv[:, :, :WIDTH].transpose(0, 2, 1))
    score += _LATER
    some, there = _seen(ids)
    if len(some):
        score[some] += np.where(there, np.float32(0), np.float32(-1e9))
    share = _softmax(score)
    seen = np.matmul(share, kv[:, :, WIDTH:]).reshape(-1, WIDTH)
    flat = seen @ m.mixed
    flat += own
    up = flat @ m.up
    up += m.up_bias
    np.maximum(up, 0, out=up)
    state = up @ m.down
    state += flat
    return state, (x, own, q, kv, share, seen, flat, up)


def log_probabilities(m: Model, ids: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probabilities of the ids to tell, shaped like ``told``."""
    return log_probabilities_and_opening(m, ids, told, SIDE)[0]


def log_probabilities_and_opening(m: Model, ids: np.ndarray, told: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithms of the probabilities of the ids to tell, shaped like ``told``: of
    the class, and of the member among its class, class by class; and at the same places
    those of any id of the first ``classes``."""
    out, opening = (np.empty(told.shape, dtype=np.float32) for _ in range(2))
    first = (np.arange(SIDE) < classes).astype(np.float32)
    for s in range(0, len(ids), TOLD):
        stop = min(len(ids), s + TOLD)
        want = told[s:stop].ravel()
        group, member = want // SIDE, want % SIDE
        state, result = np.empty((len(want), WIDTH), dtype=np.float32), np.empty(len(want), dtype=np.float32)
        for b in range(s, stop, BLOCK):
            z = slice((b - s) * SCORED, (min(b + BLOCK, stop) - s) * SCORED)
            state[z] = _states(m, ids[b : min(b + BLOCK, stop)])[0]
            chance = state[z] @ m.out
            chance += m.out_bias
            chance, total = _exponentials(chance)
            opening[b : b + BLOCK] = np.log(chance @ first / total).reshape(-1, SCORED)
            result[z] = _picked(chance, group[z]) / total
        order = np.argsort(group.astype(np.int8), kind="stable")
        state, member = state.take(order, axis=0), member[order]
        ends = np.searchsorted(group[order], np.arange(SIDE + 1))
        inner = np.empty(len(want), dtype=np.float32)
        for c in np.flatnonzero(np.diff(ends)):
            rows = slice(ends[c], ends[c + 1])
            chance = state[rows] @ m.member[c]
            chance += m.member_bias[c]
            chance, total = _exponentials(chance)
            inner[rows] = _picked(chance, member[rows]) / total
        result = np.log(result)
        result[order] += np.log(inner)
        out[s:stop] = result.reshape(-1, SCORED)
    return out, opening


def _picked(x: np.ndarray, column: np.ndarray) -> np.ndarray:
    """One number of each row."""
    return x.reshape(-1).take(np.arange(0, x.size, SIDE) + column)


def _less_one(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What stands at the flat places ``at``, one each, of which 1 is taken in place."""
    flat = p.reshape(-1)
    found = flat.take(at)
    flat[at] = found - 1
    return found


def gradients(m: Model, ids: np.ndarray, told: np.ndarray, there: np.ndarray) -> tuple[float, Model]:
    """Mean loss over the places that are there, and its gradients."""
    state, (x, own, q, kv, share, seen, flat, up) = _states(m, ids)
    want, weight = told.ravel(), there.ravel().astype(np.float32)
    weight = weight / max(1.0, weight.sum())
    group, member = want // SIDE, want % SIDE
    every = np.arange(len(want))
    p = state @ m.out
    p += m.out_bias
    p = _softmax(p)
    loss = -float((weight * np.log(_less_one(p, every * SIDE + group) + 1e-30)).sum())
    p *= weight[:, None]
    g = {"out": state.T @ p, "out_bias": p.sum(0)}
    ds = p @ m.out.T
    # Members class by class, in the order of the classes.
    by_member, by_bias = np.zeros_like(m.member), np.zeros_like(m.member_bias)
    order = np.argsort(group.astype(np.int8), kind="stable")
    group = group[order]
    ends = np.searchsorted(group, np.arange(SIDE + 1))
    ordered, weight = state.take(order, axis=0), weight[order]
    some = [(c, slice(ends[c], ends[c + 1])) for c in np.flatnonzero(np.diff(ends)).tolist()]
    inner = np.empty((len(ordered), SIDE), dtype=ordered.dtype)
    for c, rows in some:
        np.matmul(ordered[rows], m.member[c], out=inner[rows])
    inner += m.member_bias.take(group, axis=0)
    inner = _raised(inner)
    # Sums class by class: over all rows at once they would round otherwise.
    total, each = np.empty(len(inner), dtype=inner.dtype), np.ones(SIDE, dtype=inner.dtype)
    for _, rows in some:
        np.matmul(inner[rows], each, out=total[rows])
    inner /= total[:, None]
    loss -= float((weight * np.log(_less_one(inner, every * SIDE + member[order]) + 1e-30)).sum())
    inner *= weight[:, None]
    back = np.empty_like(ds)
    for c, rows in some:
        np.matmul(ordered[rows].T, inner[rows], out=by_member[c])
        np.add.reduce(inner[rows], axis=0, out=by_bias[c])
        np.matmul(inner[rows], m.member[c].T, out=back[rows])
    place = np.empty_like(order)
    place[order] = every
    ds += back.take(place, axis=0)
    g["member"], g["member_bias"] = by_member, by_bias
    g["down"] = up.T @ ds
    du = ds @ m.down.T
    du *= up > 0
    g["up"], g["up_bias"] = flat.T @ du, du.sum(0)
    dh = du @ m.up.T
    dh += ds
    g["mixed"] = seen.T @ dh
    dseen = dh @ m.mixed.T
    # What is hidden has a share near 0; products of it would be subnormal, which is slow.
    share *= _EARLIER
    some, with_id = _seen(ids)
    if len(some):
        share[some] *= with_id
    less = (dseen * seen).sum(-1).reshape(-1, SCORED, 1)
    dseen = dseen.reshape(-1, SCORED, WIDTH)
    dscore = np.matmul(dseen, kv[:, :, WIDTH:].transpose(0, 2, 1))
    dscore -= less
    dscore *= share
    dkv = np.empty_like(kv)
    np.matmul(dscore.transpose(0, 2, 1), q, out=dkv[:, :, :WIDTH])
    np.matmul(share.transpose(0, 2, 1), dseen, out=dkv[:, :, WIDTH:])
    dq, dkv = np.matmul(dscore, kv[:, :, :WIDTH]).reshape(-1, WIDTH), dkv.reshape(-1, 2 * WIDTH)
    scale = np.float32(WIDTH**-0.5)
    g["query"] = own.T @ dq * scale
    by_kv = x.reshape(-1, WIDTH).T @ dkv
    g["key"], g["value"] = by_kv[:, :WIDTH], by_kv[:, WIDTH:]
    dx = dkv[:, :WIDTH] @ m.key.T
    dx += dkv[:, WIDTH:] @ m.value.T
    dx = dx.reshape(x.shape)
    dh += dq @ (m.query.T * scale)
    dx[:, CONTEXT:] += dh.reshape(-1, SCORED, WIDTH)
    g["place"] = dx.sum(0)
    by_embed = np.zeros_like(m.embed)
    read = np.where(ids < 0, START, ids).astype(np.int16).ravel()
    order = np.argsort(read, kind="stable")
    read = read[order]
    first = np.concatenate([[0], np.flatnonzero(read[1:] != read[:-1]) + 1])
    by_embed[read[first]] = np.add.reduceat(dx.reshape(-1, WIDTH).take(order, axis=0), first)
    g["embed"] = by_embed
    return loss, Model(**g)


class Learner(NamedTuple):
    """A model and the moments of its gradients, changed in place: each a row of numbers."""

    model: Model  # its arrays are parts of the first row
    numbers: np.ndarray

    def learn(self, n: int, done: float, *windows: np.ndarray) -> None:
        """Adam's step ``n``, from 1 on, when the part ``done`` of all steps is behind."""
        _, slope = gradients(self.model, *windows)
        pace = 0.01 * min(1.0, n / 30) * (1 - done) ** 0.5
        s = np.concatenate([x.ravel() for x in slope])
        p, a, b = self.numbers
        a += 0.1 * (s - a)
        b += 0.01 * (s * s - b)
        p -= pace * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.99**n)) + 1e-7)

    def flat(self) -> np.ndarray:
        return self.numbers.reshape(-1)

    def filled(self, flat: np.ndarray) -> Learner:
        """A learner of these shapes with the numbers of ``flat``."""
        numbers = np.array(flat, dtype=np.float32).reshape(3, -1)
        cut = np.split(numbers[0], np.cumsum([p.size for p in self.model])[:-1])
        return Learner(Model(*[x.reshape(p.shape) for x, p in zip(cut, self.model)]), numbers)


def learner(m: Model) -> Learner:
    first = np.concatenate([p.ravel() for p in m])
    return Learner(m, first).filled(np.concatenate([first, np.zeros(2 * len(first))]))


def train(m: Model, ids: np.ndarray, told: np.ndarray, there: np.ndarray, steps: int, batch: int, seed: int) -> Model:
    """Adam with a falling rate over all windows in a drawn order, again and again."""
    rng = np.random.default_rng(seed)
    mine, order = learner(m), np.empty(0, dtype=np.int64)
    for n in range(1, steps + 1 if len(ids) else 1):
        while len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(ids))])
        pick, order = order[:batch], order[batch:]
        mine.learn(n, n / (steps + 1), ids[pick], told[pick], there[pick])
    return mine.model


def arranged(counts: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """An order of ids in which neighbours follow similar ids: halves of whole classes by the
    first principal direction, again and again, down to classes of SIDE. ``follow`` (ids, n)
    counts what each id follows."""
    share = np.log1p(follow) / (1 + np.log1p(counts))[:, None]

    def split(rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= SIDE:
            return [rows]
        x = share[rows] - share[rows].mean(0)
        line = np.ones(x.shape[1])
        for _ in range(20):
            line = x.T @ (x @ line) + 1e-12
            line /= np.linalg.norm(line)
        rows = rows[np.argsort(x @ line, kind="stable")]
        half = max(1, len(rows) // SIDE // 2) * SIDE
        return split(rows[:half]) + split(rows[half:])

    return np.concatenate(split(np.arange(len(counts))))
