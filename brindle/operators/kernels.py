"""Whole-volume kernels in NumPy: one row is one volume, moved in Arrow batches.

A volume is a flat array in C order of (x, y, z) with its shape. Each kernel is a function of arrays; `per_volume` runs
one over a DataFrame, with a status column in place of a failing task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


#: Bytes of volumes whose results are handed on together.
FRAME_BYTES = 16 << 20


def per_volume(df: DataFrame, keys: list[str], column: str, shape: tuple[int, ...], kernel: Callable[..., dict], schema: str, named: bool = False) -> DataFrame:
    """keys and the kernel's fields for each row; status is ok or the error's name, and the fields are null where it failed. A frame of
    results holds as many volumes as have FRAME_BYTES together, of one at least. named: the kernel also gets the row's first key."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, FRAME_BYTES // (8 * int(np.prod(shape))))
        for batch in batches:
            for at in range(0, len(batch), step):
                x, rows = batch.iloc[at : at + step], []
                for key, values in zip(x[keys[0]], x[column]):
                    try:
                        a = np.asarray(values, dtype=np.float64).reshape(shape)
                        rows.append({**(kernel(a, key) if named else kernel(a)), "status": "ok"})
                    except Exception as e:  # a bad volume must not end the job
                        rows.append({"status": type(e).__name__})
                yield pd.concat([x[keys].reset_index(drop=True), pd.DataFrame(rows, columns=[*names, "status"])], axis=1)

    return df.select(*keys, column).mapInPandas(run, f"{types}, {schema}, status string")


def radius_grid(shape: tuple[int, ...]) -> np.ndarray:
    axes = np.meshgrid(*[np.fft.fftfreq(n) for n in shape], indexing="ij")
    return np.sqrt(sum(a * a for a in axes))


def hf_energy(a: np.ndarray, cutoff: float = 0.25) -> float:
    """Share of the power of the mean-free volume beyond the cutoff frequency."""
    power = np.abs(np.fft.fftn(a - a.mean())) ** 2
    total = power.sum()
    return float(power[radius_grid(a.shape) > cutoff].sum() / total) if total > 0 else 0.0


def band_power(a: np.ndarray, low: float, high: float) -> float:
    r = radius_grid(a.shape)
    return float((np.abs(np.fft.fftn(a - a.mean())) ** 2)[(r >= low) & (r < high)].sum())


def _binned(where: np.ndarray, power: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of bins of equal width from 0 to the largest place, and the mean power in each, 0 for an empty one."""
    edges = np.linspace(0, where.max(), bins + 1)
    which = np.minimum(np.searchsorted(edges, where, "right") - 1, bins - 1)
    n = np.bincount(which, minlength=bins)
    return (edges[1:] + edges[:-1]) / 2, np.bincount(which, weights=power, minlength=bins) / np.maximum(n, 1)


def radial_spectrum(a: np.ndarray, bins: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Bin centres and mean power by distance from frequency 0, of the mean-free volume."""
    return _binned(radius_grid(a.shape).ravel(), (np.abs(np.fft.fftn(a - a.mean())) ** 2).ravel(), bins)


def axis_spectrum(a: np.ndarray, axis: int, bins: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies from 0 on and the power of the mean-free volume along one axis, its mean over the others; with bins, as radial_spectrum."""
    f = np.fft.fftfreq(a.shape[axis])
    power = np.moveaxis(np.abs(np.fft.fft(a - a.mean(), axis=axis)) ** 2, axis, 0).reshape(len(f), -1).mean(1)
    keep = np.flatnonzero(f >= 0)
    return _binned(f[keep], power[keep], bins) if bins else (f[keep], power[keep])


def axis_f99(a: np.ndarray, axis: int, level: float = 0.99) -> float:
    """The frequency up to which an axis holds that share of its power without DC; NaN for under three frequencies or no power."""
    f, p = axis_spectrum(a, axis)
    p[0] = 0
    if len(f) < 3 or p.sum() <= 0:
        return float("nan")
    return float(np.interp(level, np.cumsum(p) / p.sum(), f))


def blur(a: np.ndarray, sigma: float = 1.5, truncate: float = 3.5) -> np.ndarray:
    """Separable Gaussian with edges repeated."""
    n = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in range(a.ndim):
        padded = np.pad(a, [(n, n) if k == axis else (0, 0) for k in range(a.ndim)], mode="edge")
        a = sum(w[i] * np.take(padded, range(i, i + a.shape[axis]), axis=axis) for i in range(2 * n + 1))
    return a


def ssim(a: np.ndarray, b: np.ndarray, span: float = 1.0, mask: np.ndarray | None = None) -> float:
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    m = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    if mask is None:
        return float(m.mean())
    return float(m[mask].mean()) if mask.any() else float("nan")


def sharpness(a: np.ndarray) -> float:
    return float(np.sqrt(sum(g * g for g in np.gradient(a))).mean())


def _shifted(m: np.ndarray, fill: bool, diagonal: bool) -> Iterator[np.ndarray]:
    p = np.pad(m, 1, constant_values=fill)
    for d in np.ndindex(*(3,) * m.ndim):
        if diagonal or sum(k != 1 for k in d) <= 1:
            yield p[tuple(slice(k, k + n) for k, n in zip(d, m.shape))]


def _flood(seed: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """What of inside is joined to the seed through faces."""
    now = seed & inside
    while True:
        grown = np.logical_or.reduce(list(_shifted(now, False, False))) & inside
        if (grown == now).all():
            return now
        now = grown


def foreground(a: np.ndarray, percentile: float = 55) -> np.ndarray:
    """Above the percentile, closed by a cube of three (beyond the border lies background), holes filled, the largest part joined through faces."""
    m = a > np.percentile(a, percentile)
    m = np.logical_or.reduce(list(_shifted(m, False, True)))
    m = np.logical_and.reduce(list(_shifted(m, False, True)))
    border = np.ones_like(m)
    border[tuple(slice(1, -1) for _ in m.shape)] = False
    m = ~_flood(border & ~m, ~m)
    best, left = np.zeros_like(m), m.copy()
    while left.any():
        seed = np.zeros_like(m)
        seed[tuple(np.argwhere(left)[0])] = True
        part = _flood(seed, left)
        best = part if part.sum() > best.sum() else best
        left &= ~part
    return best


def kept_band(n: int, kept: int) -> slice:
    return slice((n - kept) // 2, (n - kept) // 2 + kept)


#: Standard deviations in a full width at half maximum.
FWHM = 2 * np.sqrt(2 * np.log(2))


def coarse_size(n: int, factor: float) -> int:
    """The even size of an axis on a grid coarser by factor."""
    m = int(np.rint(n / factor))
    return m - m % 2


def even_padding(n: int, factor: float) -> tuple[int, int]:
    """Samples to add before and after, so that an axis is a multiple of twice the rounded factor."""
    short = -n % (2 * max(1, int(np.rint(factor))))
    return short // 2, short - short // 2


def axis_window(f: np.ndarray, kept: float, mode: str, apod: float, slab: bool, slab_fwhm: float) -> np.ndarray:
    """The window of one axis at frequencies f, of which the share kept stays: a Tukey of taper apod, or the spectrum of a Gaussian
    whose width at half maximum is a coarse voxel (slab_fwhm of them across a slab)."""
    r = np.abs(f) / (kept / 2 + 1e-12)
    if mode == "gaussian" or slab:
        width = (slab_fwhm if slab and mode != "gaussian" else 1.0) / kept / FWHM
        w = np.exp(-2 * (np.pi * width * f) ** 2)
    else:
        w = 0.5 + 0.5 * np.cos(np.pi * np.clip((r - 1 + apod) / max(apod, 1e-300), 0, 1)) if apod > 0 else np.ones_like(r)
    return np.where(np.abs(f) <= kept / 2 + 1e-12, w, 0.0)


def kspace_window(shape: tuple[int, ...], kept: tuple[float, ...], mode: str = "fermi", apod: float | None = None, slice_axis: int = 2, slab_fwhm: float = 1.2, p1: float = 0.9, p2: float = 0.1) -> np.ndarray:
    """The weights of centred k-space for a coarser acquisition. fermi: a radial roll-off at p1 of the coarse Nyquist frequency, p2 wide.
    Others are products over the axes: kspace (a box, or a Tukey of apod), kspace_hann (a Hann), gaussian, and slab (a Gaussian across the slices, a box within)."""
    if mode not in ("fermi", "kspace", "kspace_hann", "gaussian", "slab"):
        raise ValueError(f"unknown mode {mode}")
    axes = [(np.arange(n) - n // 2) / n for n in shape]
    if mode == "fermi":
        squares = np.meshgrid(*[(f / (k / 2 + 1e-12)) ** 2 for f, k in zip(axes, kept)], indexing="ij")
        return 1 / (1 + np.exp((np.sqrt(sum(squares)) - p1) / p2))
    taper = min(float(mode == "kspace_hann") if apod is None else apod, 1.0)
    window = np.ones(())
    for k, (f, share) in enumerate(zip(axes, kept)):
        window = np.multiply.outer(window, axis_window(f, share, mode, taper, mode == "slab" and k == slice_axis, slab_fwhm))
    return window


def foreground_mean(a: np.ndarray, percentile: float = 60) -> float:
    """The mean of what exceeds the percentile, of all finite values where that is under 100 of them; 0 if none is finite."""
    a = a[np.isfinite(a)]
    if not a.size:
        return 0.0
    high = a[a > np.percentile(a, percentile)]
    return float((high if high.size >= 100 else a).mean())


def sigma_for_snr(a: np.ndarray, snr: float, gain: float = 1.0) -> float:
    """The noise that gives the foreground this signal-to-noise ratio, less by the gain of larger voxels."""
    return foreground_mean(a) / snr / gain if snr and snr > 0 else 0.0


def add_rician(a: np.ndarray, sigma: float, rng: np.random.Generator) -> np.ndarray:
    """The modulus of the volume with complex normal noise."""
    return np.hypot(a + rng.normal(0, sigma, a.shape), rng.normal(0, sigma, a.shape)) if sigma > 0 else a


def _centred(a: np.ndarray) -> np.ndarray:
    return np.fft.fftshift(np.fft.fftn(a))


def _from_centred(k: np.ndarray) -> np.ndarray:
    return np.fft.ifftn(np.fft.ifftshift(k)).real


def degrade(a: np.ndarray, factors: tuple[float, ...], mode: str = "fermi", apod: float | None = None, snr: float = 0.0, seed: int = 0, slice_axis: int = 2, slab_fwhm: float = 1.2, source: tuple[float, ...] = (1.0, 1.0, 1.0), target: tuple[float, ...] = (2.0, 2.0, 2.0), voxel_gain: bool = True, p1: float = 0.9, p2: float = 0.1) -> dict:
    """A coarser acquisition of a volume and its return to the fine grid, both by cropping and zero-filling k-space.

    The volume is padded by its edges to even multiples of the factors first. low is the coarse volume, up has the shape of a, info tells
    padded and coarse shape, padding, kept shares, mode and noise. snr > 0 adds Rician noise to low, seeded; voxel_gain lessens
    it by the ratio of target's voxel to source's. Windows: see kspace_window.
    """
    pads = [even_padding(n, f) for n, f in zip(a.shape, factors)]
    whole = np.pad(np.asarray(a, dtype=np.float64), pads, mode="edge")
    size = tuple(coarse_size(n, f) for n, f in zip(whole.shape, factors))
    kept = tuple(m / n for m, n in zip(size, whole.shape))
    box = tuple(kept_band(n, m) for n, m in zip(whole.shape, size))
    scale = float(np.prod(kept))
    low = np.abs(_from_centred((_centred(whole) * kspace_window(whole.shape, kept, mode, apod, slice_axis, slab_fwhm, p1, p2))[box])) * scale
    level, gain = foreground_mean(low), float(np.prod(target) / np.prod(source)) if voxel_gain else 1.0
    sigma = sigma_for_snr(low, snr, gain)
    low = add_rician(low, sigma, np.random.default_rng(seed))
    full = np.zeros(whole.shape, dtype=complex)
    full[box] = _centred(low)
    up = np.abs(_from_centred(full) / scale)[tuple(slice(before, before + n) for (before, _), n in zip(pads, a.shape))]
    info = {"padded_shape": list(whole.shape), "pad_before": [before for before, _ in pads], "lowres_shape": list(size), "keep_fraction": list(kept), "mode": mode, "foreground_mean": level, "noise_sigma": sigma}
    return {"low": low, "up": up, "info": info}


def degraded_row(a: np.ndarray, factors: tuple[float, ...]) -> dict:
    """What degrade gives, as the fields of a row."""
    x = degrade(a, factors)
    return {"low": x["low"].ravel().tolist(), "up": x["up"].ravel().tolist(), "info": x["info"]}


def tile_starts(n: int, tile: int, stride: int) -> list[int]:
    """Starts each stride, and one that ends at n."""
    return sorted({*range(0, max(n - tile, 0) + 1, stride), max(n - tile, 0)})


def blend(a: np.ndarray, tile: int | Sequence[int], stride: int | Sequence[int], model: Callable[[np.ndarray], np.ndarray] = lambda x: x, gaussian: bool = True) -> np.ndarray:
    """A volume put through a shape-preserving model tile by tile, overlaps weighted by a Gaussian or evenly."""
    tiles, strides = ([int(x) for x in np.broadcast_to(y, a.ndim)] for y in (tile, stride))
    w = np.ones(())
    for t in tiles:
        w = np.multiply.outer(w, np.exp(-0.5 * ((np.arange(t) - (t - 1) / 2) / (t / 6)) ** 2) if gaussian else np.ones(t))
    w = np.maximum(w, 1e-3)
    acc, weight = np.zeros(a.shape), np.zeros(a.shape)
    for starts in product(*map(tile_starts, a.shape, tiles, strides)):
        box = tuple(slice(s, s + t) for s, t in zip(starts, tiles))
        acc[box] += model(a[box]) * w
        weight[box] += w
    return acc / np.maximum(weight, 1e-8)


def blend_fitted(a: np.ndarray, tile: int, stride: int, model: Callable[[np.ndarray], np.ndarray] = lambda x: x, multiple: int = 4) -> np.ndarray:
    """blend for models that take multiples only: tiles shrink to the axes, which are padded by their last values and cut again."""
    tiles = [max(multiple, min(tile, -(-n // multiple) * multiple) // multiple * multiple) for n in a.shape]
    pads = [-(-max(n, t) // multiple) * multiple - n for n, t in zip(a.shape, tiles)]
    whole = np.pad(a, [(0, p) for p in pads], mode="edge")
    return blend(whole, tiles, stride, model)[tuple(slice(0, n) for n in a.shape)]


def percentile_norm(a: np.ndarray, low: float = 0.5, high: float = 99.5, of: np.ndarray | None = None) -> np.ndarray:
    """Scaled to 0 to 1 between two percentiles of a, or of another volume."""
    p, q = np.percentile(a if of is None else of, [low, high])
    return np.clip((a - p) / max(q - p, 1e-12), 0, 1)


def foreground_norm(a: np.ndarray, low: float = 1, high: float = 99, share: float = 0.02) -> np.ndarray:
    """percentile_norm by the values above a share of the largest, by all where there are none."""
    above = a[a > a.max() * share]
    return percentile_norm(a, low, high, above if above.size else a)


def edge_weighted_l1(a: np.ndarray, b: np.ndarray, alpha: float = 2.0) -> float:
    """Mean absolute difference, weighted up where b has edges; the weights' mean is 1."""
    g = np.sqrt(sum(np.diff(b, axis=k, prepend=np.take(b, [0], axis=k)) ** 2 for k in range(b.ndim)) + 1e-12)
    w = 1 + alpha * np.clip(g / (4 * g.mean()), 0, 1)
    return float((w / w.mean() * np.abs(a - b)).mean())
