"""Resampling, deformation, crops, augmentation and curve orders of volumes, in NumPy; `kernels.per_volume` runs them over rows.

What is drawn at random comes from `seeded`, so a repeated task draws the same again.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np

from . import kernels

#: Windows of the windowed sinc resamplers, as functions of distance over radius.
SINC_WINDOWS = {
    "hamming": lambda u: 0.54 + 0.46 * np.cos(np.pi * u),
    "cosine": lambda u: np.cos(np.pi * u / 2),
    "welch": lambda u: 1 - u * u,
    "lanczos": np.sinc,
    "blackman": lambda u: 0.42 + 0.5 * np.cos(np.pi * u) + 0.08 * np.cos(2 * np.pi * u),
}
METHODS = ("nearest", "linear", "bspline", "gaussian", *SINC_WINDOWS)
SINC_RADIUS, GAUSS_SIGMA = 4, 0.8


def seeded(seed: int, a: np.ndarray) -> np.random.Generator:
    """A generator that depends on the seed and the volume's values alone."""
    return np.random.default_rng([seed, zlib.crc32(np.ascontiguousarray(a).tobytes())])


def named_seed(*parts) -> int:
    """What sampling.stable_seed gives for the same parts: a seed from, say, a run's seed, a volume's name and the epoch."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def _cubic(d: np.ndarray) -> np.ndarray:
    """The cubic B-spline."""
    d = np.abs(d)
    return np.where(d < 1, 2 / 3 - d * d + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0))


def _mirrored(j: np.ndarray, n: int) -> np.ndarray:
    turn = max(2 * (n - 1), 1)
    j = np.mod(j, turn)
    return np.minimum(j, turn - j) if n > 1 else np.zeros_like(j)


def axis_weights(n: int, at: np.ndarray, method: str) -> np.ndarray:
    """(places, n): how samples 0 .. n - 1 add up to the value at each place; beyond the ends the last sample goes on."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    at = np.clip(at, 0, n - 1)
    if method == "nearest":
        return np.eye(n)[np.floor(at + 0.5).astype(int).clip(0, n - 1)]
    radius = {"linear": 1, "bspline": 2, "gaussian": 4}.get(method, SINC_RADIUS)
    taps = np.floor(at).astype(int)[:, None] + np.arange(1 - radius, radius + 1)
    d = at[:, None] - taps
    if method == "linear":
        w = np.maximum(0, 1 - np.abs(d))
    elif method == "bspline":
        w = _cubic(d)
    elif method == "gaussian":
        w = np.exp(-0.5 * (d / GAUSS_SIGMA) ** 2)
    else:
        w = np.where(np.abs(d) <= radius, np.sinc(d) * SINC_WINDOWS[method](d / radius), 0)
    out, rows = np.zeros((len(at), n)), np.repeat(np.arange(len(at)), taps.shape[1])
    where = _mirrored(taps, n) if method == "bspline" else taps.clip(0, n - 1)
    np.add.at(out, (rows, where.ravel()), w.ravel())
    if method == "bspline":  # the coefficients whose spline goes through the samples
        through, own = np.zeros((n, n)), np.arange(n)
        for t, share in ((-1, 1 / 6), (0, 2 / 3), (1, 1 / 6)):
            np.add.at(through, (own, _mirrored(own + t, n)), share)
        return np.linalg.solve(through.T, out.T).T
    return out / out.sum(1, keepdims=True)


def along_axes(a: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    for axis, w in enumerate(weights):
        a = np.moveaxis(np.tensordot(w, a, (1, axis)), 0, axis)
    return a


def resample(a: np.ndarray, spacing: tuple[float, ...], wanted: tuple[float, ...], method: str = "linear", centred: bool = False) -> np.ndarray:
    """A volume on a grid of another spacing. The first sample stays where it is and sizes are rounded up; if centred, the
    volume's centre stays and sizes are rounded."""
    weights = []
    for n, old, new in zip(a.shape, spacing, wanted):
        m = max(1, int(np.rint(n * old / new)) if centred else int(np.ceil(n * old / new - 1e-9)))
        at = (np.arange(m) - (m - 1) / 2) * new / old + (n - 1) / 2 if centred else np.arange(m) * new / old
        weights.append(axis_weights(n, at, method))
    return along_axes(a, weights)


def value_at(a: np.ndarray, at: np.ndarray, outside: float = 0.0) -> np.ndarray:
    """Linear interpolation at index positions (axes first), `outside` beyond the grid."""
    inside = np.logical_and.reduce([(p >= -1e-9) & (p <= n - 1 + 1e-9) for p, n in zip(at, a.shape)])
    low = [np.clip(np.floor(p), 0, max(n - 2, 0)).astype(int) for p, n in zip(at, a.shape)]
    part = [np.clip(p - l, 0, 1) for p, l in zip(at, low)]
    out = np.zeros(at.shape[1:])
    for corner in np.ndindex(*(2,) * a.ndim):
        share = np.prod([f if c else 1 - f for c, f in zip(corner, part)], axis=0)
        out += share * a[tuple(np.minimum(l + c, n - 1) for l, c, n in zip(low, corner, a.shape))]
    return np.where(inside, out, outside)


def grid(shape: tuple[int, ...]) -> np.ndarray:
    return np.stack(np.meshgrid(*[np.arange(n, dtype=float) for n in shape], indexing="ij"))


def rotation(degrees: tuple[float, float, float]) -> np.ndarray:
    """Turns about x, then y, then z."""
    turn = np.eye(3)
    for axis, angle in enumerate(np.deg2rad(degrees)):
        p, q = (axis + 1) % 3, (axis + 2) % 3
        m = np.eye(3)
        m[p, p] = m[q, q] = np.cos(angle)
        m[q, p], m[p, q] = np.sin(angle), -np.sin(angle)
        turn = m @ turn
    return turn


def rotate(a: np.ndarray, degrees: tuple[float, float, float]) -> np.ndarray:
    """Turned about its centre; 0 where nothing was."""
    middle = (np.array(a.shape, dtype=float) - 1)[:, None, None, None] / 2
    return value_at(a, np.tensordot(rotation(degrees).T, grid(a.shape) - middle, 1) + middle)


def translate(a: np.ndarray, offset: tuple[int, ...]) -> np.ndarray:
    """Moved by whole samples; 0 where nothing was."""
    out = np.zeros_like(a)
    to = tuple(slice(max(o, 0), max(n + min(o, 0), 0)) for o, n in zip(offset, a.shape))
    of = tuple(slice(max(-o, 0), max(n - max(o, 0), 0)) for o, n in zip(offset, a.shape))
    out[to] = a[of]
    return out


def regrid(affine: np.ndarray, old: tuple[int, ...], new: tuple[int, ...]) -> np.ndarray:
    """The 4 x 4 affine of a grid of another size over the same field of view, with the same centre."""
    out = np.array(affine, dtype=float)
    old_, new_ = np.array(old, dtype=float), np.array(new, dtype=float)
    out[:3, :3] = affine[:3, :3] * (old_ / new_)
    out[:3, 3] = affine[:3, 3] + affine[:3, :3] @ ((old_ - 1) / 2) - out[:3, :3] @ ((new_ - 1) / 2)
    return out


def crop_kspace(a: np.ndarray, spacing: tuple[float, ...]) -> np.ndarray:
    """Undoes zero filling: axes finer than the coarsest keep the middle of k-space, to an even size at the coarsest spacing."""
    top = max(spacing)
    new = [n if s >= top * (1 - 1e-3) else max(2, 2 * int(np.rint(n * s / top / 2))) for n, s in zip(a.shape, spacing)]
    if any(m > n for m, n in zip(new, a.shape)):
        raise ValueError(f"{new} exceeds {a.shape}")
    box = tuple(kernels.kept_band(n, m) for n, m in zip(a.shape, new))
    return np.abs(np.fft.ifftn(np.fft.ifftshift(np.fft.fftshift(np.fft.fftn(a))[box]))) * (np.prod(new) / a.size)


def deform(a: np.ndarray, rng: np.random.Generator, mesh: int = 10, size: float = 10.0) -> np.ndarray:
    """Moved by a cubic B-spline field over a mesh of control points with displacements up to `size` samples."""
    bases = [_cubic(np.arange(n)[:, None] * mesh / max(n, 1) - np.arange(-1, mesh + 2)) for n in a.shape]
    moved = [along_axes(rng.random((mesh + 3,) * a.ndim) * size, bases) for _ in a.shape]
    return value_at(a, grid(a.shape) + np.stack(moved))


def sobel(a: np.ndarray) -> np.ndarray:
    """Edge strength after smoothing, from -1 to 1; beyond the border lies -1."""
    padded = np.pad(a, 1, constant_values=-1)
    squares = 0.0
    for axis in range(a.ndim):
        g = padded
        for k in range(a.ndim):
            n = a.shape[k]
            x, y, z = (np.take(g, range(i, i + n), axis=k) for i in range(3))
            g = x - z if k == axis else x + 2 * y + z
        squares = squares + (g / 4) ** 2
    return 2 * np.tanh(np.sqrt(squares)) - 1


def laplacian(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1, mode="edge")
    middle = (slice(1, -1),) * a.ndim
    return sum(np.roll(p, s, axis)[middle] for axis in range(a.ndim) for s in (1, -1)) - 2 * a.ndim * a


def equalise(a: np.ndarray, alpha: float = 0.3, beta: float = 0.3, radius: int = 2) -> np.ndarray:
    """Adaptive contrast by a cumulation function over the neighbours (Stark, 2000); alpha 0 equalises, beta 1 and alpha 1 change nothing."""
    low, span = a.min(), max(float(np.ptp(a)), 1e-12)
    u = (a - low) / span - 0.5
    near = np.lib.stride_tricks.sliding_window_view(np.pad(u, radius, mode="reflect" if min(a.shape) > radius else "edge"), (2 * radius + 1,) * a.ndim)
    d = u[(...,) + (None,) * a.ndim] - near
    out = (np.sign(d) * np.abs(2 * d) ** alpha / 2 - beta * d).mean(axis=tuple(range(a.ndim, 2 * a.ndim))) + beta * u
    return (out + 0.5) * span + low


def brightness(a: np.ndarray, shift: float) -> np.ndarray:
    """Shifted, within the range that the volume had."""
    return np.clip(a + shift, a.min(), a.max())


def contrast(a: np.ndarray, percent: float) -> np.ndarray:
    """Differences from the whole part of the mean grown (or shrunk) by a percentage, within 0 to 255."""
    return np.clip(a + (a - int(a.mean())) * percent / 100, 0, 255)


def gamma(a: np.ndarray, power: float) -> np.ndarray:
    """A power of the volume's own range, which it keeps."""
    low, span = a.min(), np.ptp(a)
    return ((a - low) / span) ** power * span + low if span > 0 else a


def parts(mask: np.ndarray) -> list[np.ndarray]:
    """The parts of a mask that are joined through faces."""
    left, out = mask.copy(), []
    while left.any():
        seed = np.zeros_like(left)
        seed[tuple(np.argwhere(left)[0])] = True
        out.append(kernels._flood(seed, left))
        left &= ~out[-1]
    return out


def box_at(start: tuple[int, ...], size: tuple[int, ...]) -> tuple[slice, ...]:
    return tuple(slice(s, s + n) for s, n in zip(start, size))


def random_crop(label: np.ndarray, size: tuple[int, ...], rng: np.random.Generator, least: float = 0.1, tries: int = 25) -> tuple[tuple[int, ...], float]:
    """Start and foreground share of a box: the first drawn with a share of `least` or more above the label's median, else the best drawn."""
    size = tuple(min(s, n) for s, n in zip(size, label.shape))
    level, best = np.median(label), ((), -1.0)
    for _ in range(max(1, tries)):
        start = tuple(int(rng.integers(0, n - s + 1)) for s, n in zip(size, label.shape))
        share = float((label[box_at(start, size)] > level).mean())
        best = (start, share) if share > best[1] else best
        if share >= least:
            break
    return best


def confidence_crop(mask: np.ndarray, size: tuple[int, ...], rng: np.random.Generator, sigma: float = 2.5) -> tuple[int, ...]:
    """Start of a box about the centroid of a random part of the mask, moved by normal noise of sigma * size / 2; the noise is drawn
    from what keeps the box inside, so no draw is tried again. An empty mask counts as one at the box's own middle."""
    found = parts(mask)
    middle = np.argwhere(found[rng.integers(len(found))]).mean(0) if found else np.array(size) / 2
    out = []
    for c, s, n in zip(middle, size, mask.shape):
        if s > n:
            raise ValueError(f"a box of {s} exceeds {n}")
        starts = np.arange(n - s + 1)
        far = (starts - np.clip(np.rint(c) - s // 2, 0, n - s)) / max(sigma * s / 2, 1e-9)
        p = np.exp(-0.5 * far**2)
        out.append(int(rng.choice(starts, p=p / p.sum())))
    return tuple(out)


def crop_background(a: np.ndarray, size: tuple[int, int, int], level: float) -> np.ndarray:
    """A box of x and y about the centre of mass of what exceeds the level (else the middle), from z = 0."""
    hit = np.argwhere(a > level)
    middle = hit.mean(0) if len(hit) else np.array(a.shape) / 2
    start = [int(np.clip(np.rint(middle[k]) - size[k] // 2, 0, max(a.shape[k] - size[k], 0))) for k in range(2)]
    return a[box_at((*start, 0), size)]


def augment(a: np.ndarray, rng: np.random.Generator) -> tuple[str, np.ndarray]:
    """One of eight changes, each as likely: its name and the volume."""
    name = ("none", "noise", "blur", "rotate", "deform", "flip", "brightness", "contrast")[rng.integers(8)]
    if name == "noise":
        a = a + rng.normal(rng.uniform(0, 1), rng.uniform(0, 2), a.shape)
    elif name == "blur":
        a = kernels.blur(a, max(rng.uniform(0, 1.5), 1e-3))
    elif name == "rotate":
        a = rotate(a, (rng.integers(-40, 40), rng.integers(-40, 40), rng.integers(-180, 180)))
    elif name == "deform":
        a = deform(a, rng)
    elif name == "flip":
        a = np.flip(a, int(rng.integers(a.ndim)))
    elif name == "brightness":
        a = brightness(a, int(rng.integers(-20, 20)))
    elif name == "contrast":
        a = contrast(a, int(rng.integers(-20, 20)))
    return name, a


def augment_pair(a: np.ndarray, b: np.ndarray, rng: np.random.Generator, chance: float = 0.8, noise: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Input and target under the same flips of x and y, quarter turns (square planes), gamma and gain; Rician noise on the input alone."""
    if rng.random() > chance:
        return a, b
    for axis in (0, 1):
        if rng.random() < 0.5:
            a, b = np.flip(a, axis), np.flip(b, axis)
    if a.shape[0] == a.shape[1]:
        turns = int(rng.integers(4))
        a, b = np.rot90(a, turns), np.rot90(b, turns)
    power, gain = rng.uniform(0.9, 1.1), rng.uniform(0.95, 1.05)
    a, b = gamma(a, power) * gain, gamma(b, power) * gain
    sigma = rng.uniform(0, noise) * np.ptp(a)
    return np.hypot(a + rng.normal(0, sigma, a.shape), rng.normal(0, sigma, a.shape)) if sigma > 0 else a, b


def random_degrade(a: np.ndarray, rng: np.random.Generator, factors: tuple[float, ...] = (2, 2, 2), apod: tuple[float, float] = (0.0, 0.3), snr: tuple[float, float] = (20.0, 40.0), modes: tuple[str, ...] = ("kspace",)) -> np.ndarray:
    """The whole volume through the forward model with a drawn window, taper and noise level. Give each volume and epoch a generator of
    its own (named_seed), so that epochs differ and equal volumes too."""
    mode = modes[rng.integers(len(modes))]
    return kernels.degrade(a, factors, mode=mode, apod=rng.uniform(*apod), snr=rng.uniform(*snr), seed=int(rng.integers(2**31)))["up"]


def hilbert_rank(at: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on a Hilbert curve of 2^bits a side of each point (Skilling, "Programming the Hilbert curve", 2004)."""
    x = [np.array(v, dtype=np.int64) for v in at]
    for b in range(bits - 1, 0, -1):
        below = (1 << b) - 1
        for i in range(len(x)):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> b) & 1 == 1, flip ^ ((1 << b) - 1), flip)
    rank = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            rank = (rank << 1) | (((v ^ flip) >> b) & 1)
    return rank


def curve_order(shape: tuple[int, ...], kind: str) -> np.ndarray:
    """Flat indices (C order) in the order that a curve visits them, a permutation.

    hilbert: a Hilbert curve over the whole box. slices: one over each z slice, slice by slice. spiral: each slice from its border inwards,
    and the next one back outwards. hilbert and slices over sides that are no power of two take the part of the next larger curve that lies
    inside, so steps there may leap.
    """
    at = [v.ravel() for v in np.meshgrid(*[np.arange(n) for n in shape], indexing="ij")]
    bits = max(1, int(np.ceil(np.log2(max(max(shape), 2)))))
    if kind == "hilbert":
        return np.argsort(hilbert_rank(at, bits), kind="stable")
    if kind == "slices":
        return np.lexsort((hilbert_rank(at[:2], bits), at[2]))
    if kind != "spiral":
        raise ValueError(f"unknown kind {kind}")
    x, y, z = at
    ring = np.minimum(np.minimum(x, y), np.minimum(shape[0] - 1 - x, shape[1] - 1 - y))
    w, h = shape[0] - 1 - 2 * ring, shape[1] - 1 - 2 * ring
    u, v = x - ring, y - ring
    place = np.where(u == 0, v, np.where(v == h, h + u, np.where(u == w, h + w + (h - v), 2 * h + w + (w - u))))
    back = np.where(z % 2, -1, 1)  # odd slices go from the middle outwards
    return np.lexsort((place * back, ring * back, z))


def all_metrics(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> dict[str, float]:
    """Whole-volume psnr, mae and rmse, masked ssim, sharpness and high-frequency share of both, and with a mask also masked psnr and mae."""

    def errors(d: np.ndarray) -> tuple[float, float, float]:
        mse = float((d * d).mean()) if d.size else float("nan")
        return (float("inf") if mse <= 0 else -10 * float(np.log10(mse))), (float(np.abs(d).mean()) if d.size else float("nan")), float(np.sqrt(mse))

    out = dict(zip(("psnr", "mae", "rmse"), errors(a - b)))
    out |= {"ssim": kernels.ssim(a, b, mask=mask), "sharpness_pred": kernels.sharpness(a), "sharpness_target": kernels.sharpness(b), "hf_energy_pred": kernels.hf_energy(a), "hf_energy_target": kernels.hf_energy(b)}
    if mask is not None:
        out["psnr_masked"], out["mae_masked"], _ = errors((a - b)[mask])
    return out


def headroom(a: np.ndarray, factors: tuple[float, ...] = (2, 2, 2), mode: str = "kspace", snr: float = 0.0) -> dict[str, float]:
    """How well plain degrading keeps a volume: PSNR over the foreground, both on the volume's own range; and the foreground's share. NaN without foreground."""
    low, span = a.min(), max(float(np.ptp(a)), 1e-12)
    own, other = (a - low) / span, np.clip((kernels.degrade(a, factors, mode=mode, snr=snr)["up"] - low) / span, 0, 1)
    mask = kernels.foreground(own)
    if not mask.any():
        return {"db": float("nan"), "share": float("nan")}
    mse = float(((other - own)[mask] ** 2).mean())
    return {"db": float("inf") if mse <= 0 else -10 * float(np.log10(mse)), "share": float(mask.mean())}


def audit(a: np.ndarray, spacing: tuple[float, ...] = (1.0, 1.0, 1.0), cutoff: float = 0.25, masked: bool = True) -> dict:
    """What resolution a volume really has, within the box of its foreground and scaled by its largest magnitude: hf025 (power beyond
    cutoff), f99 of each axis, eff_mm (the voxel that the worst axis' f99 stands for), worst_axis, cliff (power just above the cutoff over
    that just below), shape and spacing as text."""
    if masked:
        mask = kernels.foreground((a - a.min()) / max(float(np.ptp(a)), 1e-12))
        if mask.any():
            a = a[tuple(slice(int(i.min()), int(i.max()) + 1) for i in np.nonzero(mask))]
    a = a / max(float(np.abs(a).max()), 1e-12)
    f99 = [kernels.axis_f99(a, k) for k in range(a.ndim)]
    known = [k for k, f in enumerate(f99) if not np.isnan(f)]
    worst = min(known, key=lambda k: f99[k]) if known else 0
    below, above = kernels.band_power(a, 0.2, cutoff), kernels.band_power(a, cutoff, 0.3)
    return {
        "hf025": kernels.hf_energy(a, cutoff), "f99": f99, "eff_mm": 0.5 / f99[worst] * spacing[worst] if known and f99[worst] > 0 else float("nan"), "worst_axis": "xyz"[worst],
        "cliff": above / below if below > 0 else float("nan"), "shape": "x".join(map(str, a.shape)), "spacing": ",".join(f"{s:.2f}" for s in spacing),
    }
