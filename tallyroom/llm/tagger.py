"""A character tagger: bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tags: 0 outside, 1 + 2 * kind first character, 2 + 2 * kind further ones.
TAGS = 1 + 2 * len(KINDS)
#: Character codes: 0 fills a window, then printable ASCII with capitals and digits as one
#: each, white space, and anything else.
_PLAIN = "abcdefghijklmnopqrstuvwxyz@.+-_%()[]{}<>,:;/=|'\"!?#*&$~^`\\"
_CODES = np.full(128, len(_PLAIN) + 5, dtype=np.int64)
for _i, _c in enumerate(_PLAIN):
    _CODES[ord(_c)] = _i + 1
_CODES[65:91], _CODES[48:58] = len(_PLAIN) + 1, len(_PLAIN) + 2
_CODES[32], _CODES[9:14] = len(_PLAIN) + 3, len(_PLAIN) + 4
OTHER, CODES = len(_PLAIN) + 5, len(_PLAIN) + 6
HIDDEN = 16

_allowed = np.zeros((TAGS, TAGS), dtype=bool)
_allowed[:, 0] = _allowed[:, 1::2] = True
for _k in range(len(KINDS)):
    _allowed[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True
FORBIDDEN = np.where(_allowed, 0.0, -1e4).astype(np.float32)
START = np.where(np.arange(TAGS) % 2 + (np.arange(TAGS) == 0) > 0, 0.0, -1e4).astype(np.float32)


def codes(text: str, length: int) -> np.ndarray:
    points = np.frombuffer(text[:length].encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.zeros(length, dtype=np.int64)
    out[: len(points)] = np.where(points < 128, _CODES[np.minimum(points, 127)], OTHER)
    return out


class Tagger(NamedTuple):
    """Both directions stacked: input rows (2, CODES, 4H), recurrent (2, H, 4H), output
    (2H, TAGS), its bias, and transitions."""

    enter: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    move: np.ndarray


def new_tagger(rng: np.random.Generator, hidden: int = HIDDEN) -> Tagger:
    def draw(*shape, size):
        return (rng.standard_normal(shape) * size).astype(np.float32)
    enter = draw(2, CODES, 4 * hidden, size=0.3)
    enter[:, :, hidden : 2 * hidden] += 1.0
    return Tagger(
        enter, draw(2, hidden, 4 * hidden, size=hidden**-0.5), draw(2 * hidden, TAGS, size=hidden**-0.5),
        np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(model: Tagger, both: np.ndarray, keep: bool):
    """States (T, 2, B, H) of codes (2, B, T), and what the way back needs."""
    _, batch, length = both.shape
    hidden = model.recur.shape[1]
    h = np.zeros((2, batch, hidden), np.float32)
    c = np.zeros_like(h)
    states = np.empty((length, 2, batch, hidden), np.float32)
    kept = []
    for t in range(length):
        gates = np.matmul(h, model.recur)
        gates[0] += model.enter[0][both[0, :, t]]
        gates[1] += model.enter[1][both[1, :, t]]
        soft = _sigmoid(gates[..., : 3 * hidden])
        i, f, o = soft[..., :hidden], soft[..., hidden : 2 * hidden], soft[..., 2 * hidden :]
        g = np.tanh(gates[..., 3 * hidden :])
        new = f * c + i * g
        tan = np.tanh(new)
        if keep:
            kept.append((i, f, o, g, c, tan, h))
        c, h = new, o * tan
        states[t] = h
    return states, kept


def _emissions(model: Tagger, states: np.ndarray) -> np.ndarray:
    """(T, B, TAGS) scores: the forward state and the backward state of the same place."""
    joined = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
    return joined @ model.out + model.bias


def decode(model: Tagger, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags (B, T) of windows of codes (B, T), and each place's lead of its emission
    over the second best."""
    states, _ = _run(model, np.stack([windows, windows[:, ::-1]]), False)
    scores = _emissions(model, states)
    top = np.partition(scores, TAGS - 2, axis=2)
    move = model.move + FORBIDDEN
    best = scores[0] + START
    back = np.empty(scores.shape, dtype=np.int8)
    for t in range(1, len(scores)):
        ways = best[:, :, None] + move
        back[t] = ways.argmax(1)
        best = ways.max(1) + scores[t]
    tags = np.empty(windows.shape, dtype=np.int64)
    tags[:, -1] = best.argmax(1)
    every = np.arange(len(windows))
    for t in range(len(scores) - 1, 0, -1):
        tags[:, t - 1] = back[t][every, tags[:, t]]
    return tags, (top[..., -1] - top[..., -2]).T


def _crf(scores: np.ndarray, move: np.ndarray, tags: np.ndarray):
    """Mean loss of the tags, and its gradients by scores (T, B, TAGS) and transitions."""
    length, batch, _ = scores.shape
    every = np.arange(batch)
    step = np.exp(move + FORBIDDEN)
    high = scores.max(2, keepdims=True)
    emit = np.exp(scores - high)
    ahead, behind = np.empty_like(emit), np.empty_like(emit)
    norm = np.empty((length, batch, 1), np.float32)
    for t in range(length):
        a = emit[t] * (np.exp(START) if t == 0 else ahead[t - 1] @ step)
        norm[t] = a.sum(1, keepdims=True)
        ahead[t] = a / norm[t]
    behind[-1] = 1
    for t in range(length - 2, -1, -1):
        behind[t] = (emit[t + 1] * behind[t + 1]) @ step.T / norm[t + 1]
    share = ahead * behind
    pairs = np.zeros_like(step)
    for t in range(1, length):
        pairs += (ahead[t - 1].T @ (emit[t] * behind[t] / norm[t])) * step
    by_score = share
    place = tags.T
    at = np.arange(length)[:, None]
    truth = scores[at, every, place].sum() + move[place[:-1], place[1:]].sum()
    loss = (np.log(norm).sum() + high.sum() - truth) / batch
    by_score[at, every, place] -= 1
    np.subtract.at(pairs, (place[:-1].ravel(), place[1:].ravel()), 1)
    return loss, by_score / batch, pairs / batch


def gradients(model: Tagger, windows: np.ndarray, tags: np.ndarray) -> tuple[float, Tagger]:
    both = np.stack([windows, windows[:, ::-1]])
    states, kept = _run(model, both, True)
    hidden = model.recur.shape[1]
    loss, by_score, by_move = _crf(_emissions(model, states), model.move, tags)
    joined = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
    by_out = np.tensordot(joined, by_score, ([0, 1], [0, 1]))
    by_joined = by_score @ model.out.T
    by_state = np.stack([by_joined[..., :hidden], by_joined[::-1, :, hidden:]], axis=1)
    by_enter, by_recur = np.zeros_like(model.enter), np.zeros_like(model.recur)
    dh = np.zeros_like(by_state[0])
    dc = np.zeros_like(dh)
    for t in range(len(kept) - 1, -1, -1):
        i, f, o, g, c, tan, h = kept[t]
        dh = dh + by_state[t]
        dc = dc + dh * o * (1 - tan * tan)
        gate = np.concatenate(
            [dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tan * o * (1 - o), dc * i * (1 - g * g)], axis=2
        )
        for d in (0, 1):
            np.add.at(by_enter[d], both[d, :, t], gate[d])
        by_recur += np.matmul(h.transpose(0, 2, 1), gate)
        dh, dc = np.matmul(gate, model.recur.transpose(0, 2, 1)), dc * f
    return loss, Tagger(by_enter, by_recur, by_out, by_score.sum((0, 1)), by_move)


def train(windows: np.ndarray, tags: np.ndarray, steps: int, batch: int, seed: int, rate: float = 0.02) -> Tagger:
    """Adam over shuffled batches; without windows an untrained tagger, which adds what
    later checks let through."""
    rng = np.random.default_rng(seed)
    model = new_tagger(rng)
    first = [np.zeros_like(p) for p in model]
    second = [np.zeros_like(p) for p in model]
    for n in range(1, steps + 1 if len(windows) else 1):
        pick = rng.integers(0, len(windows), min(batch, len(windows)))
        _, slope = gradients(model, windows[pick], tags[pick])
        norm = np.sqrt(sum(float((s * s).sum()) for s in slope))
        pace = rate * min(1.0, 4 * (1 - n / (steps + 1)))
        for p, s, m, v in zip(model, slope, first, second):
            s = s * min(1.0, 5.0 / (norm + 1e-9))
            m += 0.1 * (s - m)
            v += 0.01 * (s * s - v)
            p -= (pace * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
    return model
