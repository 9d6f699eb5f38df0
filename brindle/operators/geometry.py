"""Orientation, padding and geometry of volumes."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: World axis and direction, in right-anterior-superior coordinates, that each letter's voxel index runs to.
LETTERS = {"R": (0, 1), "L": (0, -1), "A": (1, 1), "P": (1, -1), "S": (2, 1), "I": (2, -1)}


def spacing_of(affine: np.ndarray) -> np.ndarray:
    """Voxel sizes: the lengths of the affine's columns."""
    return np.sqrt((np.asarray(affine, dtype=float)[:3, :3] ** 2).sum(0))


def orientation(affine: np.ndarray) -> str:
    """A letter for each voxel axis: the world direction it runs to; of oblique axes the assignment with the largest cosines."""
    size = spacing_of(affine)
    cosines = np.asarray(affine, dtype=float)[:3, :3] / np.where(size > 0, size, 1)
    world = max(permutations(range(3)), key=lambda p: sum(abs(cosines[p[j], j]) for j in range(3)))
    by_place = {place: letter for letter, place in LETTERS.items()}
    return "".join(by_place[world[j], 1 if cosines[world[j], j] >= 0 else -1] for j in range(3))


def reorient(a: np.ndarray, affine: np.ndarray, wanted: str = "LPS") -> tuple[np.ndarray, np.ndarray]:
    """The volume with its axes put in the order and directions that wanted names, and its affine: each value keeps its place in the world."""
    have = [LETTERS[x] for x in orientation(affine)]
    step = np.zeros((4, 4))  # from new indices to old ones
    step[3, 3] = 1
    order, turned = [], []
    for new, (axis, way) in enumerate(LETTERS[x] for x in wanted):
        old = next(j for j, (other, _) in enumerate(have) if other == axis)
        order.append(old)
        if have[old][1] == way:
            step[old, new] = 1
        else:
            turned.append(new)
            step[old, new], step[old, 3] = -1, a.shape[old] - 1
    if sorted(order) != [0, 1, 2]:
        raise ValueError(f"not an orientation: {wanted}")
    return np.flip(np.transpose(a, order), turned), np.asarray(affine, dtype=float) @ step


def pad_to(a: np.ndarray, least: tuple[int, ...], multiple: int = 1) -> tuple[np.ndarray, tuple[int, ...]]:
    """The volume, grown by repeating its edges to at least so many voxels and to a multiple, and the offset at which it lies in it."""
    wanted = [-(-max(n, m) // multiple) * multiple for n, m in zip(a.shape, least)]
    before = [(w - n) // 2 for w, n in zip(wanted, a.shape)]
    return np.pad(a, [(b, w - n - b) for b, w, n in zip(before, wanted, a.shape)], mode="edge"), tuple(before)


def about_axis(axis: tuple[float, float, float], radians: float) -> np.ndarray:
    """The matrix of a turn about an axis (Rodrigues); an axis of no length gives the identity."""
    u = np.asarray(axis, dtype=float)
    if not u.any():
        return np.eye(3)
    x, y, z = u / np.sqrt(u @ u)
    cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(radians) * cross + (1 - np.cos(radians)) * cross @ cross


def aligned(volume: Column, reference: Column, fields: tuple[str, ...] = ("spacing", "origin")) -> Column:
    """The volume struct with the geometry fields of the reference struct; values stay."""
    for name in fields:
        volume = volume.withField(name, reference[name])
    return volume
