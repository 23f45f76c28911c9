"""A bidirectional LSTM in numpy that labels every block of a page as article or not.

A block's vector is the sum of its path tokens' vectors, the mean of its hashed
words' vectors and a few numbers of its shape; all vectors are learned with the
network.  Sequences of different lengths share a batch: beyond its end a sequence
keeps its state, so both directions start from nothing at its own ends.
"""

from __future__ import annotations

import io

import numpy as np

#: Slots of hashed path tokens and words, and the sizes of their vectors; numbers of a block's shape; state of each direction.
PATHS, PATH_SIZE, WORDS, WORD_SIZE, SHAPE, STATE = 2048, 20, 2048, 8, 7, 20

#: A page: path tokens and words of its blocks (flat, with the number of each block), and shapes.
Page = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def start(seed: int = 1) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    size = PATH_SIZE + WORD_SIZE + SHAPE
    p = {"path": r.normal(0, 0.15, (PATHS, PATH_SIZE)), "word": r.normal(0, 0.1, (WORDS, WORD_SIZE)), "out": r.normal(0, 0.2, 2 * STATE + size), "bias": np.zeros(1)}
    for way in "fb":
        p |= {f"w{way}": r.normal(0, size**-0.5, (size, 4 * STATE)), f"u{way}": r.normal(0, STATE**-0.5, (STATE, 4 * STATE)), f"b{way}": np.repeat([0.0, 1.0, 0.0, 0.0], STATE)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sums(vectors: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(vectors[ids], np.cumsum(counts) - counts)


def _vectors(p: dict, page: Page) -> np.ndarray:
    paths, n_paths, words, n_words, shape = page
    return np.concatenate([_sums(p["path"], paths, n_paths), _sums(p["word"], words, n_words) / n_words[:, None], shape], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(p: dict, x: np.ndarray, mask: np.ndarray, way: str, keep: bool):
    """States of one direction for x (time, page, vector), and what the gradient needs."""
    steps, pages, _ = x.shape
    z, u = x @ p[f"w{way}"] + p[f"b{way}"], p[f"u{way}"]
    h = c = np.zeros((pages, STATE), np.float32)
    out, kept = np.zeros((steps, pages, STATE), np.float32), []
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        a = z[t] + h @ u
        gates, new = _sigmoid(a[:, : 3 * STATE]), np.tanh(a[:, 3 * STATE :])
        i, f, o = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
        c_new = f * c + i * new
        squashed, m = np.tanh(c_new), mask[t][:, None]
        if keep:
            kept.append((t, h, c, gates, new, squashed))
        h, c = np.where(m, o * squashed, h), np.where(m, c_new, c)
        out[t] = h
    return out, kept


def _back(p: dict, x: np.ndarray, mask: np.ndarray, way: str, d_out: np.ndarray, kept: list, grad: dict) -> np.ndarray:
    """Adds one direction's gradients to ``grad``; returns that of x."""
    d_z, u = np.zeros((*x.shape[:2], 4 * STATE), np.float32), p[f"u{way}"]
    d_h = d_c = np.zeros((x.shape[1], STATE), np.float32)
    d_u = np.zeros_like(u)
    for t, h, c, gates, new, squashed in reversed(kept):
        m = mask[t][:, None]
        i, f, o = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
        total = d_out[t] + d_h
        own, own_c = np.where(m, total, 0), np.where(m, d_c, 0)
        own_c = own_c + own * o * (1 - squashed * squashed)
        d_a = np.concatenate([own_c * new * i * (1 - i), own_c * c * f * (1 - f), own * squashed * o * (1 - o), own_c * i * (1 - new * new)], axis=1)
        d_z[t] = d_a
        d_u += h.T @ d_a
        d_h, d_c = np.where(m, d_a @ u.T, total), np.where(m, own_c * f, d_c)
    grad[f"u{way}"] = d_u
    grad[f"w{way}"] = x.reshape(-1, x.shape[2]).T @ d_z.reshape(-1, 4 * STATE)
    grad[f"b{way}"] = d_z.sum(axis=(0, 1))
    return d_z @ p[f"w{way}"].T


def _together(p: dict, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    found = [_vectors(p, page) for page in pages]
    x = np.zeros((max(map(len, found)), len(found), found[0].shape[1]), np.float32)
    mask = np.zeros(x.shape[:2], bool)
    for k, v in enumerate(found):
        x[: len(v), k], mask[: len(v), k] = v, True
    return x, mask


def scores(p: dict, pages: list[Page]) -> list[np.ndarray]:
    """For each page the chance of each block to be of the article."""
    x, mask = _together(p, pages)
    both = np.concatenate([_run(p, x, mask, "f", False)[0], _run(p, x, mask, "b", False)[0], x], axis=2)
    chance = _sigmoid(both @ p["out"] + p["bias"])
    return [chance[mask[:, k], k] for k in range(len(pages))]


def _gradients(p: dict, pages: list[Page], labels: list[np.ndarray]) -> tuple[dict, float]:
    x, mask = _together(p, pages)
    forward, kept_f = _run(p, x, mask, "f", True)
    backward, kept_b = _run(p, x, mask, "b", True)
    both = np.concatenate([forward, backward, x], axis=2)
    want = np.zeros(mask.shape, np.float32)
    for k, y in enumerate(labels):
        want[: len(y), k] = y
    chance = _sigmoid(both @ p["out"] + p["bias"])
    d = np.where(mask, chance - want, 0) / mask.sum()
    loss = float(-np.log(np.where(want > 0.5, chance, 1 - chance)[mask] + 1e-7).mean())
    grad = {"out": both.reshape(-1, both.shape[2]).T @ d.reshape(-1), "bias": d.sum(keepdims=True).reshape(1)}
    d_both = d[:, :, None] * p["out"]
    d_x = d_both[:, :, 2 * STATE :] + _back(p, x, mask, "f", d_both[:, :, :STATE], kept_f, grad) + _back(p, x, mask, "b", d_both[:, :, STATE : 2 * STATE], kept_b, grad)
    grad |= {"path": np.zeros_like(p["path"]), "word": np.zeros_like(p["word"])}
    for k, (paths, n_paths, words, n_words, _) in enumerate(pages):
        own = d_x[mask[:, k], k]
        np.add.at(grad["path"], paths, np.repeat(own[:, :PATH_SIZE], n_paths, axis=0))
        np.add.at(grad["word"], words, np.repeat(own[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] / n_words[:, None], n_words, axis=0))
    return grad, loss


def fit(pages: list[Page], labels: list[np.ndarray], epochs: int = 8, at_once: int = 24, rate: float = 0.02, seed: int = 1) -> dict[str, np.ndarray]:
    """The network after ``epochs`` passes over the pages (Adam, with a rate that falls to nothing)."""
    p, r = start(seed), np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    by_length = np.argsort([len(y) for y in labels], kind="stable")
    parts = [by_length[i : i + at_once] for i in range(0, len(by_length), at_once)]
    for _ in range(epochs):
        for at in r.permutation(len(parts)):
            grad, _ = _gradients(p, [pages[i] for i in parts[at]], [labels[i] for i in parts[at]])
            step += 1
            now = rate * (1 - step / (epochs * len(parts) + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            scale = min(1.0, 5 / (sum(float((g * g).sum()) for g in grad.values()) ** 0.5 + 1e-9))
            for k, g in grad.items():
                g = g * scale
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] -= (now * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return p


def packed(p: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return dict(found)
