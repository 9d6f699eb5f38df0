import numpy as np
import pytest

from brindle.operators import transforms as T

A = np.random.default_rng(3).random((6, 8, 4))


@pytest.mark.parametrize("method", T.METHODS)
def test_resample(method):
    flat = T.resample(np.full((5, 6, 7), 2.5), (1, 1, 1), (0.4, 1.3, 2), method)
    assert flat.shape == (13, 5, 4) and np.allclose(flat, 2.5)
    if method != "gaussian":  # it smooths; the others go through the samples
        assert np.allclose(T.resample(A, (1, 1, 1), (1, 1, 1), method), A)
    assert T.resample(A[:1, :1, :1], (1, 1, 1), (1, 1, 1), method).shape == (1, 1, 1)
    with pytest.raises(ValueError):
        T.resample(A, (1, 1, 1), (1, 1, 1), "no such")


def test_linear_and_spline_follow_polynomials():
    x = np.arange(12.0)[:, None, None] * np.ones((1, 3, 3))
    assert np.allclose(T.resample(x, (1, 1, 1), (0.5, 1, 1))[:23, 0, 0], np.arange(23) / 2)
    fine = T.resample(np.sin(x / 3), (1, 1, 1), (0.5, 1, 1), "bspline")[4:18, 0, 0]
    assert np.allclose(fine, np.sin(np.arange(4, 18) / 6), atol=5e-3)


def test_geometry():
    cube = A[:4, :4, :4]
    assert np.allclose(T.rotate(cube, (0, 0, 0)), cube)
    assert np.allclose(T.rotate(cube, (0, 0, 90)), np.rot90(cube, 1, (0, 1)))
    assert np.allclose(T.translate(A, (1, -2, 0))[1:, :-2], A[:-1, 2:]) and not T.translate(A, (9, 0, 0)).any()
    assert np.allclose(T.deform(A, np.random.default_rng(0), size=0.0), A)
    m = T.regrid(np.diag([1.0, 2, 3, 1]), (4, 4, 4), (2, 4, 8))
    middle = lambda f, n: f[:3, :3] @ ((np.array(n) - 1) / 2) + f[:3, 3]
    assert np.allclose(middle(m, (2, 4, 8)), middle(np.diag([1.0, 2, 3, 1]), (4, 4, 4))) and np.allclose(np.diag(m), [2, 2, 1.5, 1])
    low = T.crop_kspace(np.full((8, 4, 4), 3.0), (0.5, 1, 1))
    assert low.shape == (4, 4, 4) and np.allclose(low, 3)
    assert np.allclose(T.crop_background(np.pad(np.ones((2, 2, 2)), 3), (2, 2, 5), 0.5)[:, :, 3:5], 1)


def test_filters():
    flat = np.full((5, 5, 5), 0.3)
    assert np.allclose(T.sobel(flat)[2, 2, 2], -1) and (T.sobel(A) <= 1).all()
    assert np.allclose(T.laplacian(flat), 0)
    assert np.allclose(T.equalise(A, 1.0, 1.0, 1), A)
    assert T.brightness(A, 5).max() == A.max() and np.ptp(T.gamma(A, 2.0)) == pytest.approx(np.ptp(A))
    assert np.allclose(T.contrast(np.array([[[0.0, 100.0, 200.0]]]), 10), [[[0, 100, 210]]])


def test_crops_stay_inside_and_repeat():
    for seed in range(40):
        start, share = T.random_crop(A, (3, 9, 2), T.seeded(seed, A))
        assert start == T.random_crop(A, (3, 9, 2), T.seeded(seed, A))[0] and 0 <= share <= 1
        assert all(0 <= s and s + min(k, n) <= n for s, k, n in zip(start, (3, 9, 2), A.shape))
        for mask in (A > 0.9, np.zeros(A.shape, dtype=bool)):
            start = T.confidence_crop(mask, (3, 8, 2), T.seeded(seed, A))
            assert all(0 <= s and s + k <= n for s, k, n in zip(start, (3, 8, 2), A.shape))
    with pytest.raises(ValueError):
        T.confidence_crop(A > 0.9, (7, 8, 2), T.seeded(0, A))


def test_augmentation():
    seen = {}
    for seed in range(80):
        name, out = T.augment(A, T.seeded(seed, A))
        seen[name] = out
        assert out.shape == A.shape and np.isfinite(out).all()
        a, b = T.augment_pair(A, A, T.seeded(seed, A), noise=0.0)
        assert np.allclose(a, b)
    assert len(seen) == 8 and not np.allclose(seen["flip"], A)
    assert T.random_degrade(A, T.seeded(1, A)).shape == A.shape


@pytest.mark.parametrize("kind", ["hilbert", "slices", "spiral"])
@pytest.mark.parametrize("shape", [(4, 4, 4), (8, 8, 8), (5, 3, 2), (1, 1, 1), (1, 6, 2), (3, 3, 3)])
def test_curves_visit_each_place_once(kind, shape):
    order = T.curve_order(shape, kind)
    assert sorted(order) == list(range(np.prod(shape)))
    if shape in ((4, 4, 4), (8, 8, 8)):
        at = np.stack(np.unravel_index(order, shape), 1)
        if kind != "hilbert":
            at = at.reshape(shape[2], -1, 3)[:, :, :2]
        assert (np.abs(np.diff(at, axis=-2)).sum(-1) == 1).all()


def test_metrics():
    got = T.all_metrics(A, A, A > 0.5)
    assert got["psnr"] == float("inf") and got["mae"] == 0 and got["ssim"] == pytest.approx(1) and got["mae_masked"] == 0
    assert np.isnan(T.all_metrics(A, A, A > 2)["mae_masked"])
    ball = np.exp(-((T.grid((12, 12, 12)) - 5.5) ** 2).sum(0) / 8)
    assert 0 < T.headroom(ball)["share"] < 1 and T.headroom(ball)["db"] > 25
