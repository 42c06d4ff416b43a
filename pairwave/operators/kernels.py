"""NumPy kernels for long signals, used on Arrow batches inside tasks."""

from __future__ import annotations

import math
from functools import lru_cache
from threading import get_ident

import numpy as np


def convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The first len(x) samples of x * h, by FFT."""
    if not len(x) or not len(h):
        return np.zeros(len(x))
    n = 1 << (len(x) + len(h) - 2).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x)]


def convolve_many(xs: list[np.ndarray], h: np.ndarray) -> list[np.ndarray]:
    """convolve() of many signals with one response: those of equal length go through one transform together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(xs)
    for length in {len(x) for x in xs}:
        same = [i for i, x in enumerate(xs) if len(x) == length]
        n = 1 << max(0, length + len(h) - 2).bit_length()
        if length and len(h):
            made = np.fft.irfft(np.fft.rfft(np.stack([xs[i] for i in same]), n, axis=1) * np.fft.rfft(h, n), n, axis=1)[:, :length]
        else:
            made = np.zeros((len(same), length))
        for i, y in zip(same, made, strict=True):
            out[i] = y
    return out


def resample(x: np.ndarray, source: int, target: int, zeros: int = 16) -> np.ndarray:
    """x at another rate: ceil(n * up / down) samples by a Kaiser-windowed sinc. An output sample needs only the taps that meet input samples."""
    if source == target or not len(x):
        return x.copy()
    g = math.gcd(source, target)
    up, down = target // g, source // g
    half = zeros * max(up, down)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 8.0)
    taps *= up / taps.sum()
    n = -(-len(x) * up // down)
    out = np.empty(n)
    reach = half // up + 1
    padded = np.concatenate((np.zeros(reach), x, np.zeros(reach + 1)))
    for at in range(0, n, 1 << 14):
        place = np.arange(at, min(at + (1 << 14), n)) * down
        middle = place // up
        offsets = np.arange(-reach, reach + 1)
        tap = place[:, None] - (middle[:, None] + offsets) * up + half
        weight = np.where((tap >= 0) & (tap < len(taps)), taps[np.clip(tap, 0, len(taps) - 1)], 0.0)
        inside = (middle[:, None] + offsets >= 0) & (middle[:, None] + offsets < len(x))
        out[at : at + len(place)] = (padded[np.clip(middle[:, None] + offsets + reach, 0, len(padded) - 1)] * weight * inside).sum(axis=1)
    return out


#: Samples of a transform, in which a span of a response is filtered; how far one image's part may be off; pieces that a span's images are
#: taken from in turn: a sum that waits for the one before it is slow.
SPAN, OFF, APART = 4096, 1e-12, 16


@lru_cache(64)
def fractional_taps(half: int, degrees: int) -> np.ndarray:
    """(degrees, 2 * half + 1): the windowed sinc at each tap less f, as the polynomial in f - 1/2 through Chebyshev's nodes, low powers first."""
    nodes = np.cos(np.pi * (np.arange(degrees) + 0.5) / degrees)
    t = np.arange(-half, half + 1) - (nodes[:, None] + 1) / 2
    values = np.sinc(t) * (0.5 + 0.5 * np.cos(np.pi * t / (half + 1)))
    basis = np.cos(np.pi * np.outer(np.arange(degrees), np.arange(degrees) + 0.5) / degrees) * 2 / degrees
    basis[0] /= 2
    powers = np.zeros((degrees, degrees))
    for k in range(degrees):
        powers[: k + 1, k] = np.polynomial.chebyshev.cheb2poly([0] * k + [1])
    return 2.0 ** np.arange(degrees)[:, None] * (powers @ (basis @ values))


@lru_cache(64)
def tap_spectra(half: int, degrees: int) -> np.ndarray:
    return np.fft.rfft(fractional_taps(half, degrees), SPAN, axis=1)


#: By number of degrees, what they leave out of an image of gain 1: the sinc is entire, and at a tap a fraction spans half a turn of it.
LEFT_OUT = [2 * 0.81**k / math.factorial(k) for k in range(24)]


@lru_cache(64)
def lattice(order: int) -> tuple[np.ndarray, ...]:
    """Where the images are. Along an axis: signs of the source's place, lengths of the room added, numbers of reflections. Of two axes: the
    pairs that are within the order by their numbers of reflections, these, and how many of them each image of the other axis can be with."""
    r = np.arange(-(order // 2) - 1, order // 2 + 2)
    sign, lengths, n = np.array([(1 - 2 * p, 2 * m, abs(m - p) + abs(m)) for m in r for p in (0, 1) if abs(m - p) + abs(m) <= order]).T
    numbers = np.add.outer(n, n).ravel()
    by = np.argsort(numbers, kind="stable")
    by = by[: np.searchsorted(numbers[by], order, "right")]
    return sign, lengths, n, by, numbers[by], np.searchsorted(numbers[by], order - n, "right")


def squares(dim, source, mic, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of the images along the first axis, and of the pairs of the others."""
    sign, lengths, _, by, _, _ = lattice(order)
    x, y, z = ((sign * s + lengths * d - c) ** 2 for s, d, c in zip(source, dim, mic, strict=True))
    return x, np.add.outer(y, z).ravel()[by]


def images(dim, source, mic, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and numbers of reflections of all image sources up to the order."""
    x, yz = squares(dim, source, mic, order)
    _, _, n, _, numbers, ends = lattice(order)
    return np.sqrt(np.concatenate([yz[:e] + d for d, e in zip(x, ends, strict=True)])), np.concatenate([numbers[:e] + k for k, e in zip(n, ends, strict=True)])


@lru_cache(8)
def scratch(thread: int, half: int, n: int) -> tuple[np.ndarray, ...]:
    """Arrays for n images and for a span, kept for the thread's next response: fresh memory costs more than what is worked out in it."""
    return np.empty((4, n)), np.empty(n, np.int64), np.zeros((len(LEFT_OUT), SPAN)), np.empty((len(LEFT_OUT), SPAN // 2 + 1), complex)


def impulse_response(dim, source, mic, absorption: float, order: int, rate: int, sound: float = 343.0, half: int = 40) -> np.ndarray:
    """Shoebox room response by the image-source method (Allen and Berkley 1979), with fractional delays by windowed sincs.

    At each tap a windowed sinc is a polynomial of the fraction. Images are sorted by delay; those of a span of the response are summed by
    whole delay, once for each power that its loudest image needs, and the sums are filtered by the taps of their power."""
    x, yz = squares(dim, source, mic, order)
    _, _, n, _, numbers, ends = lattice(order)
    last = int(math.sqrt((np.maximum.accumulate(yz)[ends - 1] + x).max()) / sound * rate)
    total, low = int(ends.sum()), (1 << order.bit_length()) - 1
    (delays, held, parts, floors), whole, sums, spectra = scratch(get_ident(), half, 1 << (total - 1).bit_length())
    delays = delays[:total]
    x, yz, nearest = x * (rate / sound) ** 2, yz * (rate / sound) ** 2, 1e-3 * rate / sound
    at = 0
    for e, d, k in zip(ends.tolist(), x.tolist(), n.tolist(), strict=True):
        t = delays[at : at + e]
        np.sqrt(np.add(yz[:e], d, t), t)
        # the number of reflections goes with a delay as its last bits, some 1e-14 of it
        bits = t.view(np.int64)
        bits &= ~low
        bits |= numbers[:e] + k
        at += e
    delays.sort()
    step = SPAN - 2 * half
    spans = (last + 1) // step + 1  # what is rounded up is in one too
    bounds = np.searchsorted(delays, np.arange(spans + 1) * step).tolist()
    beta = math.sqrt(max(0.0, 1.0 - absorption)) ** np.arange(low + 1) * (rate / sound / (4 * math.pi))
    lines = np.zeros((spans, SPAN // 2 + 1), complex)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if a == b:
            continue
        t, p, floor, w = (r[: b - a] for r in (held, parts, floors, whole))
        even = (b - a) // APART * APART
        t[:even].reshape(-1, APART)[:] = delays[a : a + even].reshape(APART, -1).T
        t[even:] = delays[a + even : b]
        np.take(beta, np.bitwise_and(t.view(np.int64), low, w), out=p, mode="clip")
        p /= np.maximum(t, nearest, floor)
        t -= np.floor(t, floor)
        t -= 0.5
        floor -= i * step
        w[:] = floor
        peak = float(p.max())
        degrees = next(k for k, left in enumerate(LEFT_OUT) if left * peak <= OFF) or 1
        for k in range(degrees):
            if k:
                p *= t
            sums[k, :step] = np.bincount(w, p, step)
        made = np.fft.rfft(sums[:degrees], out=spectra[:degrees])
        made *= tap_spectra(half, degrees)
        made.sum(axis=0, out=lines[i])
    out = np.zeros(spans * step + 2 * half)
    for i, line in enumerate(np.fft.irfft(lines, SPAN, axis=1)):
        out[i * step : i * step + SPAN] += line
    return out[half : last + 2 * half + 2]
