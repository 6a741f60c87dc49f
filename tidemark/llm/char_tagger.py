"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SIGNS = " \n\t.,;:!?@+-_()[]{}<>=/\\\"'%&#*$|~^`"
PAD, OTHER, DIGIT, LOWER, UPPER, LETTER = range(6)
SYMBOLS = 6 + len(_SIGNS)


def _symbol_table() -> np.ndarray:
    """Symbols of the first 256 code points: a sign stands for itself, digits and letters for their kind."""
    table = np.full(256, OTHER, np.int64)
    for code in range(256):
        c = chr(code)
        if c in _SIGNS:
            table[code] = 6 + _SIGNS.index(c)
        elif c.isascii() and c.isdigit():
            table[code] = DIGIT
        elif c.isalpha():
            table[code] = (LOWER if c.islower() else UPPER) if c.isascii() else LETTER
    return table


_TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 256, _TABLE[np.minimum(codes, 255)], LETTER)


@dataclass(frozen=True)
class Training:
    width: int = 96
    embedding: int = 10
    hidden: int = 16
    steps: int = 200
    batch: int = 32
    rate: float = 0.02
    seed: int = 3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def start_parameters(tags: int, plan: Training) -> dict[str, np.ndarray]:
    draw, e, h = np.random.default_rng(plan.seed), plan.embedding, plan.hidden
    normal = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
    bias = np.zeros((2, 1, 4 * h), np.float32)
    bias[:, :, h: 2 * h] = 1
    return {
        "letters": normal(SYMBOLS, e) * 2, "inputs": normal(2, e, 4 * h), "state": normal(2, h, 4 * h), "bias": bias,
        "out": normal(2 * h, tags), "out_bias": np.zeros(tags, np.float32),
        "moves": np.zeros((tags, tags), np.float32), "first": np.zeros(tags, np.float32), "last": np.zeros(tags, np.float32),
    }


def emissions(p: dict[str, np.ndarray], ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Tag scores of each character, windows x characters x tags. Both directions advance in one step."""
    count, width = ids.shape
    hidden = p["state"].shape[1]
    x = p["letters"][ids]
    both = np.stack((x, x[:, ::-1]))
    pre = (both.reshape(2, count * width, -1) @ p["inputs"] + p["bias"]).reshape(2, count, width, -1)
    h = c = np.zeros((2, count, hidden), np.float32)
    states = np.empty((2, count, width, hidden), np.float32)
    trail = []
    for t in range(width):
        z = pre[:, :, t] + h @ p["state"]
        gate, new = _sigmoid(z[..., : 3 * hidden]), np.tanh(z[..., 3 * hidden:])
        i, f, o = gate[..., :hidden], gate[..., hidden: 2 * hidden], gate[..., 2 * hidden:]
        before, h_before = c, h
        c = f * c + i * new
        squashed = np.tanh(c)
        h = o * squashed
        states[:, :, t] = h
        if keep is not None:
            trail.append((i, f, o, new, before, squashed, h_before))
    top = np.concatenate((states[0], states[1][:, ::-1]), axis=2)
    if keep is not None:
        keep.update(both=both, trail=trail, top=top)
    return top @ p["out"] + p["out_bias"]


def gradients(p: dict[str, np.ndarray], ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood of the tag sequences, and its gradient."""
    keep: dict = {}
    score = emissions(p, ids, keep).astype(np.float64)
    count, width, kinds = score.shape
    moves = p["moves"].astype(np.float64)
    ahead, back = np.empty_like(score), np.empty_like(score)
    ahead[:, 0] = p["first"] + score[:, 0]
    for t in range(1, width):
        ahead[:, t] = _log_sum(ahead[:, t - 1, :, None] + moves, 1) + score[:, t]
    back[:, -1] = p["last"]
    for t in range(width - 2, -1, -1):
        back[:, t] = _log_sum(moves + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
    total = _log_sum(ahead[:, -1] + p["last"], 1)
    chance = np.exp(ahead + back - total[:, None, None])
    rows, at = np.arange(count)[:, None], np.arange(width)[None, :]
    right = p["first"][tags[:, 0]] + p["last"][tags[:, -1]] + score[rows, at, tags].sum(1) + moves[tags[:, :-1], tags[:, 1:]].sum(1)
    step = np.exp(ahead[:, :-1, :, None] + moves + (score[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum((0, 1))
    np.subtract.at(step, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    error = chance.copy()
    error[rows, at, tags] -= 1
    error /= count
    g = {"moves": step / count, "first": error[:, 0].sum(0), "last": error[:, -1].sum(0)}
    flat = error.reshape(-1, kinds).astype(np.float32)
    g["out"], g["out_bias"] = keep["top"].reshape(count * width, -1).T @ flat, flat.sum(0)
    above = (flat @ p["out"].T).reshape(count, width, -1)
    hidden = p["state"].shape[1]
    above = np.stack((above[..., :hidden], above[:, ::-1, hidden:]))
    dz = np.empty((2, count, width, 4 * hidden), np.float32)
    g["state"] = np.zeros_like(p["state"])
    dh = dc = np.zeros((2, count, hidden), np.float32)
    turned = p["state"].transpose(0, 2, 1)
    for t in range(width - 1, -1, -1):
        i, f, o, new, before, squashed, h_before = keep["trail"][t]
        dh = dh + above[:, :, t]
        dc = dc + dh * o * (1 - squashed * squashed)
        z = np.concatenate((dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new * new)), axis=2)
        dz[:, :, t] = z
        g["state"] += h_before.transpose(0, 2, 1) @ z
        dh, dc = z @ turned, dc * f
    wide = dz.reshape(2, count * width, -1)
    g["inputs"], g["bias"] = keep["both"].reshape(2, count * width, -1).transpose(0, 2, 1) @ wide, wide.sum(1, keepdims=True)
    dx = (wide @ p["inputs"].transpose(0, 2, 1)).reshape(2, count, width, -1)
    g["letters"] = np.zeros_like(p["letters"])
    np.add.at(g["letters"], ids.ravel(), (dx[0] + dx[1][:, ::-1]).reshape(count * width, -1))
    return float((total - right).mean()), g


def fit(ids: np.ndarray, tags: np.ndarray, kinds: int, plan: Training = Training()) -> dict[str, np.ndarray]:
    """Parameters learned from windows of symbols and their tags by Adam; reruns give the same."""
    p = start_parameters(kinds, plan)
    if not len(ids):
        return p
    draw, mean, square = np.random.default_rng(plan.seed), {k: 0.0 for k in p}, {k: 0.0 for k in p}
    for step in range(1, plan.steps + 1):
        at = draw.integers(0, len(ids), plan.batch)
        _, g = gradients(p, ids[at], tags[at])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = plan.rate * min(1.0, 2 * (1 - step / (plan.steps + 1)))
        for k in p:
            x = g[k] / max(1.0, norm / 5)
            mean[k], square[k] = 0.9 * mean[k] + 0.1 * x, 0.99 * square[k] + 0.01 * x * x
            p[k] = (p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def decode(p: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """The likeliest tag sequence of each window."""
    score = emissions(p, ids)
    count, width, kinds = score.shape
    best, came = p["first"] + score[:, 0], np.empty((count, width, kinds), np.int8)
    for t in range(1, width):
        reach = best[:, :, None] + p["moves"]
        came[:, t] = reach.argmax(1)
        best = reach.max(1) + score[:, t]
    out = np.empty((count, width), np.int64)
    out[:, -1] = (best + p["last"]).argmax(1)
    for t in range(width - 1, 0, -1):
        out[:, t - 1] = came[np.arange(count), t, out[:, t]]
    return out
