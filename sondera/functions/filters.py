"""Recursive filters as linear systems: Butterworth sections, states, and what a stretch of samples does to a state.

A filter is a state-space system (a, b, c, d): the state moves on by
s' = a s + b x, the output is c s + d x. A stretch of n samples maps the state
before it to a^n s + v, where v is the state it leaves from rest. A second pass
back over the output maps the state on the right to a^n r + q + g(n) s, where q
is what the stretch leaves there from rest on both sides, and g(n), which holds
for all stretches of n samples, is what the ringing of s leaves. So (n, v, q) is
all that the rest of a record has to know of a stretch, gaps included, and two
stretches in a row are one stretch again.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 128  # samples that one step of the recursion takes


def sections(fs: float, low: float | None, high: float | None, order: int) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of a digital Butterworth high-pass (``low`` only), low-pass (``high`` only) or band-pass.

    The analogue poles lie on the unit circle; they are moved to the (pre-warped) band and then to the z plane by the bilinear transform.
    The magnitude is 1 at the middle of the band.
    """
    if not low and not high:
        raise ValueError("a filter needs a corner")
    if any(f is not None and not 0 <= f < fs / 2 for f in (low, high)):
        raise ValueError("corners are to lie between zero and half the sampling rate")
    proto = np.exp(0.5j * np.pi * (1 + (2 * np.arange(order) + 1) / order))  # left half plane
    warp = lambda f: np.tan(np.pi * f / fs)
    if low and high:
        w0, width = np.sqrt(warp(low) * warp(high)), warp(high) - warp(low)
        half = proto * width / 2
        root = np.sqrt(half * half - w0 * w0)
        poles, zeros, middle = np.r_[half + root, half - root], np.r_[np.ones(order), -np.ones(order)], np.arctan(w0)
    elif high:
        poles, zeros, middle = proto * warp(high), -np.ones(order), 0.0
    else:
        poles, zeros, middle = warp(low) / proto, np.ones(order), np.pi / 2
    z = (1 + poles) / (1 - poles)
    upper = sorted(z[z.imag > 1e-12], key=lambda p: (abs(p), p.real))
    real = sorted(z[np.abs(z.imag) <= 1e-12].real)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(p + q), p * q) for p, q in zip(real[0::2], real[1::2], strict=False)]
    if len(real) % 2:
        pairs.append((-real[-1], 0.0))
    zeros = sorted(zeros)  # -1 first; a section takes one from each end
    out = []
    for a1, a2 in pairs:
        own = [zeros.pop(0)] + ([zeros.pop()] if a2 or len(zeros) >= len(pairs) - len(out) else [])
        b = np.poly(own)
        out.append([*b, *[0.0] * (3 - len(b)), a1, a2])
    sos = np.array(out)
    at = np.exp(-2j * middle * np.arange(3))
    for row in sos:
        row[:3] /= abs((row[:3] @ at) / (np.r_[1.0, row[3:]] @ at))
    return sos


def response(sos: np.ndarray, f: np.ndarray, fs: float) -> np.ndarray:
    z = np.exp(-2j * np.pi * np.asarray(f)[:, None] / fs * np.arange(3))
    return np.prod([(z @ row[:3]) / (z @ np.r_[1.0, row[3:]]) for row in sos], axis=0)


class System:
    """The sections in a row, as one linear system with what its passes need."""

    def __init__(self, sos: np.ndarray):
        a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
        for b0, b1, b2, a1, a2 in sos:
            a2x2, own = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
            a = np.block([[a, np.zeros((len(a), 2))], [np.outer(own, c), a2x2]])
            b, c, d = np.r_[b, own * d], np.r_[b0 * c, 1.0, 0.0], b0 * d
        self.a, self.b, self.c, self.d, self.size = a, b, c, d, len(b)
        powers = [np.eye(self.size)]
        for _ in range(BLOCK):
            powers.append(a @ powers[-1])
        self.block = powers[-1]
        self.seen = np.stack([c @ p for p in powers[:-1]])  # output by sample of a block: what the state gives
        pulse = np.r_[d, self.seen[:-1] @ b]
        i = np.arange(BLOCK)
        self.own = np.where(i[:, None] >= i, pulse[np.abs(i[:, None] - i)], 0.0)  # and what the block's samples give
        self.left = np.stack([p @ b for p in powers[:-1]][::-1])  # state that each sample of a block leaves
        self.powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Output and last state."""
        n, s = len(x), np.zeros(self.size) if state is None else state
        blocks, rest = divmod(n, BLOCK)
        rows = np.zeros((blocks + 1, BLOCK))
        rows.ravel()[:n] = x
        moved, states = rows @ self.left, np.empty((blocks + 1, self.size))
        for k in range(blocks):
            states[k] = s
            s = self.block @ s + moved[k]
        states[blocks] = s
        y = (rows @ self.own.T + states @ self.seen.T).ravel()[:n]
        return y, self.over(rest)[0] @ s + x[n - rest :] @ self.left[BLOCK - rest :]

    def over(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(a^n, g(n)) of ``n`` samples, by doubling."""
        if n not in self.powers:
            if len(self.powers) > 4096:
                self.powers.clear()
            p, g = np.eye(self.size), np.zeros((self.size, self.size))
            for bit in bin(n)[2:] if n else "":
                g, p = g + p @ g @ p, p @ p
                if bit == "1":
                    g, p = g + p @ np.outer(self.b, self.c) @ p, self.a @ p
            self.powers[n] = p, g
        return self.powers[n]

    def stretch(self, x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """(n, v, q) of samples."""
        y, v = self.run(x)
        return len(x), v, self.run(y[::-1])[1]

    def joined(self, left: tuple, gap: int, right: tuple) -> tuple[int, np.ndarray, np.ndarray]:
        """Two stretches with ``gap`` zeros between them, as one."""
        (n, v, q), (m, w, r) = left, right
        (pn, _), (pm, gm), (pg, gg) = self.over(n), self.over(m), self.over(gap)
        return n + gap + m, pm @ (pg @ v) + w, q + pn @ (gg @ v + pg @ (r + gm @ (pg @ v)))

    def states(self, starts: np.ndarray, stretches: list[tuple], before: np.ndarray, after: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """States before each of several stretches (in order) on the way there, and after each on the way back.

        ``before``: the state before the first of them; ``after``: the way back's state after the last.
        """
        n = [s[0] for s in stretches]
        gaps = [int(b - a - m) for a, b, m in zip(starts, starts[1:], n, strict=False)]
        there, ends = [before], []
        for k, (m, v, _) in enumerate(stretches):
            ends.append(self.over(m)[0] @ there[-1] + v)
            if k < len(gaps):
                there.append(self.over(gaps[k])[0] @ ends[-1])
        back = [after]
        for k in range(len(stretches) - 1, 0, -1):
            (p, g), (pg, gg) = self.over(n[k]), self.over(gaps[k - 1])
            back.append(pg @ (p @ back[-1] + stretches[k][2] + g @ there[k]) + gg @ ends[k - 1])
        return there, back[::-1]

    def there_and_back(self, x: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        y, _ = self.run(x, before)
        return self.run(y[::-1], after)[0][::-1]


@lru_cache(maxsize=32)
def butterworth(fs: float, low: float | None, high: float | None, order: int) -> System:
    return System(sections(fs, low, high, order))
