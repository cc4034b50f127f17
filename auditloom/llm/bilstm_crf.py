"""A character-level bidirectional LSTM with a CRF on top, in numpy.

Both directions run as one array, whose first axis is the direction; the
backward one reads the window reversed. All windows have the same length.
Input and forget gate are coupled: they add up to one, so that the state is a mean
of values between -1 and 1 and is given out as it is. Gates are hard sigmoids,
and x / sqrt(1 + x * x) stands for the tanh: numpy's tanh and exp take most of
the time of a step where the machine has no AVX-512.
"""

from __future__ import annotations

import numpy as np


#: A gate is this much of its sum and a half, between 0 and 1.
SLOPE = 0.2


def scaled(h_size: int) -> tuple[np.ndarray, np.ndarray]:
    """What the sums of forget and output gate, and of the new state, are multiplied by, and what is added then."""
    return np.repeat(np.float32([SLOPE, 1]), [2 * h_size, h_size]), np.repeat(np.float32([0.5, 0]), [2 * h_size, h_size])


def squash(x: np.ndarray, room: np.ndarray) -> None:
    """x / sqrt(1 + x * x), in place; room is overwritten."""
    np.multiply(x, x, out=room)
    room += 1
    np.sqrt(room, out=room)
    x /= room


def squash_slope(y: np.ndarray) -> np.ndarray:
    """The derivative of squash where it has given y."""
    left = 1 - y * y
    return left * np.sqrt(left)


class BiLstmCrf:
    """Learned arrays: E embeddings, W U b of both LSTMs, V c of the output layer, A transitions, S first labels."""

    def __init__(self, characters: int, labels: int, embedding: int = 12, hidden: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.hidden = hidden
        self.p = {
            "E": draw(characters, embedding) * 2,
            "W": draw(2, embedding, 3 * hidden),
            "U": draw(2, hidden, 3 * hidden),
            "b": np.zeros((2, 1, 3 * hidden), np.float32),
            "V": draw(2 * hidden, labels),
            "c": np.zeros(labels, np.float32),
            "A": np.zeros((labels, labels), np.float32),
            "S": np.zeros(labels, np.float32),
        }
        self.p["b"][:, :, :hidden] = 1.0  # remember at first
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = 0

    def emissions(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(windows, length, labels) from (windows, length) of character numbers; keep gets what the gradients need."""
        p, h_size = self.p, self.hidden
        n, length = x.shape
        # Time comes first, so that each step reads what lies together.
        scale, offset = scaled(h_size)
        order = np.stack([x.T, x.T[::-1]], axis=1)
        both = p["E"][order]  # length, 2, n, embedding
        gates = np.matmul(both, p["W"] * scale) + (p["b"] * scale + offset)
        u = p["U"] * scale
        h = np.zeros((length + 1, 2, n, h_size), np.float32)
        c = np.zeros_like(h)
        room = np.empty_like(h[0])
        for t in range(length):
            z = gates[t]
            z += np.matmul(h[t], u)
            own = z[:, :, : 2 * h_size]
            np.clip(own, 0, 1, out=own)
            f, o, g = (z[:, :, k * h_size : (k + 1) * h_size] for k in range(3))
            squash(g, room)
            np.subtract(c[t], g, out=c[t + 1])
            c[t + 1] *= f
            c[t + 1] += g
            np.multiply(o, c[t + 1], out=h[t + 1])
        joined = np.concatenate([h[1:, 0], h[:0:-1, 1]], axis=-1).transpose(1, 0, 2)
        if keep is not None:
            keep += [order, both, gates, h, c, joined]
        return joined @ p["V"] + p["c"]

    def crf(self, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Mean negative log-likelihood of the labels y, and its gradients by emissions, transitions and first labels.

        Forward and backward sums are kept as shares that add up to one at each place.
        """
        n, length, labels = e.shape
        A, S = self.p["A"].astype(np.float64), self.p["S"].astype(np.float64)
        top = e.max(axis=2, keepdims=True)
        weight = np.exp((e - top).astype(np.float64)).transpose(1, 0, 2)
        through = np.exp(A)
        alpha, beta, scale = np.empty_like(weight), np.ones_like(weight), np.empty((length, n, 1))
        own = np.exp(S) * weight[0]
        for t in range(length):
            if t:
                own = (own @ through) * weight[t]
            scale[t] = own.sum(1, keepdims=True)
            own = alpha[t] = own / scale[t]
        weight /= scale
        for t in range(length - 1, 0, -1):
            weight[t] *= beta[t]
            beta[t - 1] = weight[t] @ through.T
        whole = np.log(scale).sum(0)[:, 0] + top.sum((1, 2))
        rows, times = np.arange(n)[:, None], np.arange(length)
        score = e[rows, times, y].sum(1) + S[y[:, 0]] + A[y[:, :-1], y[:, 1:]].sum(1)
        de = (alpha * beta).transpose(1, 0, 2).astype(e.dtype)
        dA = through * (alpha[:-1].reshape(-1, labels).T @ weight[1:].reshape(-1, labels))
        np.subtract.at(dA, (y[:, :-1], y[:, 1:]), 1)
        de[rows, times, y] -= 1
        return float((whole - score).mean()), de / n, dA / n, de[:, 0].sum(0) / n

    def step(self, x: np.ndarray, y: np.ndarray, rate: float = 0.01) -> float:
        """One step of Adam on a batch; gives the loss before it."""
        p, h_size, keep = self.p, self.hidden, []
        e = self.emissions(x, keep)
        loss, de, dA, dS = self.crf(e, y)
        order, both, gates, h, c, joined = keep
        n, length = x.shape
        g = {"A": dA, "S": dS, "V": joined.reshape(-1, 2 * h_size).T @ de.reshape(-1, de.shape[-1]), "c": de.sum((0, 1))}
        dj = (de @ p["V"].T).transpose(1, 0, 2)
        dout = np.stack([dj[:, :, :h_size], dj[::-1, :, h_size:]], axis=1)
        f, o, new = (gates[..., k * h_size : (k + 1) * h_size] for k in range(3))
        # By what a change of the state, or for the second gate of the output, reaches the sums of the gates.
        slope = lambda gate: np.float32(SLOPE) * ((gate > 0) & (gate < 1))
        by = np.stack([(c[:-1] - new) * slope(f), c[1:] * slope(o), (1 - f) * squash_slope(new)], axis=3)
        dz = np.empty_like(by)
        dh, dc = np.zeros((2, n, h_size), np.float32), np.zeros((2, n, h_size), np.float32)
        back = p["U"].transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            dh = dh + dout[t]
            dc += dh * o[t]
            np.multiply(by[t], dc[:, :, None], out=dz[t])
            np.multiply(by[t, :, :, 1], dh, out=dz[t, :, :, 1])
            dh = np.matmul(dz[t].reshape(2, n, -1), back)
            dc *= f[t]
        flat = dz.transpose(1, 0, 2, 3, 4).reshape(2, length * n, -1)
        of_direction = lambda v: v.transpose(1, 3, 0, 2).reshape(2, v.shape[-1], length * n)
        g["U"] = np.matmul(of_direction(h[:-1]), flat)
        g["W"] = np.matmul(of_direction(both), flat)
        g["b"] = flat.sum(1, keepdims=True)
        dx = np.matmul(flat, p["W"].transpose(0, 2, 1)).reshape(2, length, n, -1)
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], order, dx.transpose(1, 0, 2, 3))
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        self.steps += 1
        for k, v in g.items():
            v = v * min(1.0, 5.0 / (norm + 1e-9))
            self.m[k] = 0.9 * self.m[k] + 0.1 * v
            self.v[k] = 0.999 * self.v[k] + 0.001 * v * v
            p[k] -= (rate * (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[k] / (1 - 0.999**self.steps)) + 1e-8)).astype(np.float32)
        return loss

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The emissions as (length, labels, windows), for reading alone: nothing is kept from step to step but the last state.

        States, embeddings and a one for the biases stand in one array, and the output layer below
        the gates, so that each step is one product, which gives the scores of the step before too;
        windows are the last axis, so that the gates are whole stretches of memory.
        """
        p, h_size = self.p, self.hidden
        n, length = x.shape
        scale, offset = scaled(h_size)
        gates = np.concatenate([p["U"] * scale, p["W"] * scale, p["b"] * scale + offset], axis=1)
        out = np.zeros((2, gates.shape[1], len(p["c"])))
        out[:, :h_size] = p["V"].reshape(2, h_size, -1)
        out[0, -1] = p["c"]
        weights = np.concatenate([gates, out], axis=2).transpose(0, 2, 1).astype(np.float32)
        read = np.concatenate([p["E"], np.ones((len(p["E"]), 1))], axis=1).astype(np.float32)[x.T].transpose(0, 2, 1)
        state = np.zeros((2, h_size + read.shape[1], n), np.float32)
        z, c = np.empty((2, weights.shape[1], n), np.float32), np.zeros((2, h_size, n), np.float32)
        room = np.empty_like(c)
        found = np.zeros((length, len(p["c"]), n), np.float32)
        f, o, g = (z[:, k * h_size : (k + 1) * h_size] for k in range(3))
        own, before, h = z[:, : 2 * h_size], z[:, 3 * h_size :], state[:, :h_size]
        for t in range(length):
            state[0, h_size:], state[1, h_size:] = read[t], read[length - 1 - t]
            np.matmul(weights, state, out=z)
            if t:
                found[t - 1] += before[0]
                found[length - t] += before[1]
            np.clip(own, 0, 1, out=own)
            squash(g, room)
            c -= g
            c *= f
            c += g
            np.multiply(o, c, out=h)
        last = np.matmul(weights[:, 3 * h_size :], state)
        found[-1] += last[0]
        found[0] += last[1]
        return found

    def decode(self, x: np.ndarray, at_once: int = 256) -> np.ndarray:
        """The likeliest labels (Viterbi) of each window.

        What a run of other labels is worth more than 0 is at most what its first place is, coming
        from 0, and each further place with the best transition to it; every place counts the way
        back to 0, less what the label before would pay for that. A window where no sum of these
        reaches 0 has label 0 throughout, and nothing is searched for in it.
        """
        A, S = self.p["A"].astype(np.float32), self.p["S"].astype(np.float32)
        back = A[:, 0] - A[0, 0]
        onward = ((A - back[:, None]).max(0) - A[0, 0] + back)[1:, None]
        first, start = (A[0] - A[0, 0] + back)[1:, None], (S - S[0] + back)[1:, None]
        # At the end there is no way back to pay.
        free = np.maximum(-back[1:].min(), 0)
        y, rest, left = np.zeros(x.shape, np.int8), [], []
        for at in range(0, len(x), at_once):
            e = self.scores(x[at : at + at_once])
            enters, goes = np.empty((2, len(e), e.shape[2]), np.float32)
            for t in range(0, len(e), 16):
                others, zero = e[t : t + 16, 1:], e[t : t + 16, 0]
                for worth, out in ((first, enters), (onward, goes)):
                    np.subtract((others + worth).max(1), zero, out=out[t : t + 16])
            enters[0] = (e[0, 1:] + start).max(0) - e[0, 0]
            run = enters[0].copy()
            most = run.copy()
            for t in range(1, len(e)):
                run += goes[t]
                np.maximum(run, enters[t], out=run)
                np.maximum(most, run, out=most)
            # Sums are rounded: what is nearly enough is searched too.
            own = np.flatnonzero(np.maximum(most, run + free) >= -1e-3)
            rest.append(own + at)
            left.append(e[:, :, own])
        if sum(map(len, rest)):
            y[np.concatenate(rest)] = self.searched(np.concatenate(left, axis=2))
        return y

    def searched(self, e: np.ndarray) -> np.ndarray:
        """The likeliest labels by (length, labels, windows) of emissions; of equal ones the first."""
        length, _, n = e.shape
        A, best = self.p["A"].astype(np.float32), np.empty(e.shape, np.float32)
        best[0] = self.p["S"][:, None] + e[0]
        for t in range(1, length):
            np.maximum.reduce(best[t - 1][:, None] + A[:, :, None], axis=0, out=best[t])
            best[t] += e[t]
        y = np.empty((n, length), np.int8)
        y[:, -1] = best[-1].argmax(0)
        for t in range(length - 1, 0, -1):
            y[:, t - 1] = (best[t - 1] + A[:, y[:, t]]).argmax(0)
        return y
