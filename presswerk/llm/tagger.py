"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is outside; 1 + 2k begins and 2 + 2k continues kind k.
LABELS = 1 + 2 * len(KINDS)
_SINGLE = " .-+()@_%,:;/\n\"'=<>[]#$*&|!?"
#: 0 pads; then lower case, upper case, digit, other; then each of _SINGLE.
SYMBOLS = 5 + len(_SINGLE)
NEVER = -1e4


def _code_table() -> np.ndarray:
    table = np.full(0x250, 4, np.uint8)
    for c in range(0x250):
        s = chr(c)
        table[c] = 5 + _SINGLE.index(s) if s in _SINGLE else 3 if "0" <= s <= "9" else 1 if s.islower() else 2 if s.isupper() else 4
    return table


_TABLE = _code_table()


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _TABLE[np.minimum(points, 0x24F)] if len(points) else np.zeros(0, np.uint8)


def allowed() -> np.ndarray:
    """0 where a label may follow another, NEVER where not: a kind is continued only after the same kind."""
    t = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        t[:, inside] = NEVER
        t[inside - 1, inside] = t[inside, inside] = 0
    return t


_START = np.array([0.0] + [0.0, NEVER] * len(KINDS))


def _logsum(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    def __init__(self, hidden: int = 20, seed: int = 11):
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (SYMBOLS, 4 * h))
            self.p["h" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            bias = np.zeros(4 * h)
            bias[h : 2 * h] = 1
            self.p["c" + d] = bias
        self.p["out"], self.p["bias"], self.p["move"] = rng.normal(0, 0.3, (2 * h, LABELS)), np.zeros(LABELS), np.zeros((LABELS, LABELS))

    # -- network ---------------------------------------------------------
    def _lstm(self, ids, d, keep=None):
        """Hidden states (T, N, h) of a time-major batch of symbols."""
        p, h = self.p, self.hidden
        state = cell = np.zeros((ids.shape[1], h), p["x" + d].dtype)
        out = np.empty((*ids.shape, h), p["x" + d].dtype)
        for t in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
            z = p["x" + d][ids[t]] + state @ p["h" + d] + p["c" + d]
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            before, prior = cell, state
            cell = f * cell + i * g
            tc = np.tanh(cell)
            state = o * tc
            out[t] = state
            if keep is not None:
                keep.append((t, i, f, o, g, before, tc, prior))
        return out

    def _lstm_back(self, ids, d, steps, dout, grad):
        p, h = self.p, self.hidden
        dstate = dcell = np.zeros((ids.shape[1], h))
        for t, i, f, o, g, before, tc, prior in reversed(steps):
            dh = dout[t] + dstate
            dc = dcell + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            np.add.at(grad["x" + d], ids[t], dz)
            grad["h" + d] += prior.T @ dz
            grad["c" + d] += dz.sum(axis=0)
            dstate, dcell = dz @ p["h" + d].T, dc * f

    def emissions(self, ids):
        both = np.concatenate([self._lstm(ids, "f"), self._lstm(ids, "b")], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    # -- training --------------------------------------------------------
    def _step(self, ids, tags):
        """Mean loss of a time-major batch and the gradients."""
        p, (length, n) = self.p, ids.shape
        kept = {"f": [], "b": []}
        hf, hb = self._lstm(ids, "f", kept["f"]), self._lstm(ids, "b", kept["b"])
        both = np.concatenate([hf, hb], axis=2)
        e = both @ p["out"] + p["bias"]
        move = p["move"] + allowed()
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + _START
        for t in range(1, length):
            alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + move, 1)
        for t in range(length - 2, -1, -1):
            beta[t] = _logsum(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsum(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None])
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        at, rows = np.arange(length)[:, None], np.arange(n)[None, :]
        score = e[at, rows, tags].sum(axis=0)
        for t in range(1, length):
            grad["move"] += np.exp(alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
            np.add.at(grad["move"], (tags[t - 1], tags[t]), -1)
            score += move[tags[t - 1], tags[t]]
        de[at, rows, tags] -= 1
        grad["out"], grad["bias"] = np.einsum("tnh,tnl->hl", both, de), de.sum(axis=(0, 1))
        dboth = de @ p["out"].T
        for d, part in (("f", dboth[:, :, : self.hidden]), ("b", dboth[:, :, self.hidden :])):
            self._lstm_back(ids, d, kept[d], part, grad)
        return float((z - score).mean()), {k: v / n for k, v in grad.items()}

    def train(self, ids: np.ndarray, tags: np.ndarray, *, epochs: int, batch: int = 64, rate: float = 0.02, seed: int = 5) -> list[float]:
        """ids and tags: (windows, T).  Adam with a falling rate; the same input gives the same model."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        total = epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            order, lost = rng.permutation(len(ids)), []
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                loss, grad = self._step(ids[rows].T, tags[rows].T)
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                now, cut = rate * (1 - step / (total + 1)), min(1.0, 5 / max(size, 1e-9))
                for name, g in grad.items():
                    g = g * cut
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.p[name] -= now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
                lost.append(loss)
            losses.append(float(np.mean(lost)))
        return losses

    def frozen(self) -> Tagger:
        """A copy in single precision."""
        out = Tagger(self.hidden)
        out.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        return out

    # -- decoding --------------------------------------------------------
    def moves(self) -> np.ndarray:
        return self.p["move"] + allowed()

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best label sequences (T, N) for emissions (T, N, LABELS) of sequences of falling lengths; 0 behind their ends."""
        move = self.moves().astype(e.dtype)
        steps, n = e.shape[:2]
        back, out = np.zeros(e.shape, np.int8), np.zeros((steps, n), np.int8)
        best = e[0] + _START.astype(e.dtype)
        for t in range(1, steps):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            paths = best[:live, :, None] + move
            back[t, :live] = paths.argmax(axis=1)
            best[:live] = paths.max(axis=1) + e[t, :live]
        now, rows = best.argmax(axis=1), np.arange(n)
        for t in range(steps - 1, -1, -1):
            live = rows[: int(np.searchsorted(-lengths, -t, side="left"))]
            out[t, live] = now[live]
            now[live] = back[t, live, now[live]]
        return out
