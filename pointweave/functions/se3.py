"""Rigid transforms, their tangent space, and expressions of them, in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def skew(v) -> np.ndarray:
    x, y, z = v
    return np.array([[0.0, -z, y], [z, 0.0, -x], [-y, x, 0.0]])


def so3_exp(w) -> np.ndarray:
    a = float(np.linalg.norm(w))
    k = skew(w)
    if a < 1e-9:
        return np.eye(3) + k + k @ k / 2
    return np.eye(3) + math.sin(a) / a * k + (1 - math.cos(a)) / a**2 * (k @ k)


def so3_log(r: np.ndarray) -> np.ndarray:
    cos = min(1.0, max(-1.0, (np.trace(r) - 1) / 2))
    angle = math.acos(cos)
    v = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    if angle < 1e-7:
        return v / 2
    if math.pi - angle < 1e-5:  # the axis from the symmetric part
        m = (r + np.eye(3)) / 2
        axis = m[:, int(np.argmax(np.diag(m)))]
        axis = axis / np.linalg.norm(axis)
        return angle * axis * (1 if axis @ v >= 0 else -1)
    return angle / (2 * math.sin(angle)) * v


@dataclass(frozen=True)
class Pose:
    """p in the frame becomes rotation @ p + translation."""

    rotation: np.ndarray
    translation: np.ndarray

    @staticmethod
    def identity() -> Pose:
        return Pose(np.eye(3), np.zeros(3))

    @staticmethod
    def of(x: float = 0, y: float = 0, z: float = 0, yaw: float = 0, pitch: float = 0, roll: float = 0) -> Pose:
        """From a place and angles in radians: Rz(yaw) Ry(pitch) Rx(roll)."""
        cy, sy, cp, sp, cr, sr = math.cos(yaw), math.sin(yaw), math.cos(pitch), math.sin(pitch), math.cos(roll), math.sin(roll)
        r = np.array([[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]])
        return Pose(r, np.array([x, y, z], float))

    @staticmethod
    def parse(text: str) -> Pose:
        """From ``[x y z yaw pitch roll]`` with angles in degrees."""
        v = [float(t) for t in text.strip().strip("[]").replace(",", " ").split()]
        if len(v) != 6:
            raise ValueError(f"a pose has six numbers, not {text!r}")
        return Pose.of(*v[:3], *np.radians(v[3:]))

    def ypr(self) -> tuple[float, float, float]:
        r = self.rotation
        pitch = math.asin(max(-1.0, min(1.0, -r[2, 0])))
        return math.atan2(r[1, 0], r[0, 0]), pitch, math.atan2(r[2, 1], r[2, 2])

    def values(self) -> list[float]:
        return [*map(float, self.translation), *self.ypr()]

    def __matmul__(self, other: Pose) -> Pose:
        return Pose(self.rotation @ other.rotation, self.rotation @ other.translation + self.translation)

    def inverse(self) -> Pose:
        return Pose(self.rotation.T, -self.rotation.T @ self.translation)

    def apply(self, points: np.ndarray) -> np.ndarray:
        return points @ self.rotation.T + self.translation

    def retract(self, d: np.ndarray) -> Pose:
        """Pose times the exponential of (translation part, rotation part)."""
        return self @ se3_exp(d)


def _left(w: np.ndarray) -> np.ndarray:
    a = float(np.linalg.norm(w))
    k = skew(w)
    if a < 1e-7:
        return np.eye(3) + k / 2 + k @ k / 6
    return np.eye(3) + (1 - math.cos(a)) / a**2 * k + (a - math.sin(a)) / a**3 * (k @ k)


def se3_exp(d) -> Pose:
    d = np.asarray(d, float)
    return Pose(so3_exp(d[3:]), _left(d[3:]) @ d[:3])


def se3_log(p: Pose) -> np.ndarray:
    """(translation part, rotation part)."""
    w = so3_log(p.rotation)
    return np.concatenate([np.linalg.solve(_left(w), p.translation), w])


def ypr_jacobian(p: Pose, step: float = 1e-6) -> np.ndarray:
    """Of (x, y, z, yaw, pitch, roll) by the right tangent."""
    cols = []
    for i in range(6):
        d = np.zeros(6)
        d[i] = step
        cols.append((np.array(p.retract(d).values()) - np.array(p.retract(-d).values())) / (2 * step))
    return np.array(cols).T
