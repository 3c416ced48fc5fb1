"""Vectors, matrices and cameras on the driver; they become literals of a plan."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np


def unit(v) -> np.ndarray:
    v = np.asarray(v, float)
    return v / np.linalg.norm(v)


def angle(a, b) -> float:
    return math.atan2(float(np.linalg.norm(np.cross(a, b))), float(np.dot(a, b)))


def rotation(axis, radians: float) -> np.ndarray:
    """Of a right-handed turn about an axis through the origin, 4 by 4."""
    x, y, z = unit(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    out = np.eye(4)
    out[:3, :3] = np.eye(3) + math.sin(radians) * k + (1 - math.cos(radians)) * k @ k
    return out


def translation(v) -> np.ndarray:
    out = np.eye(4)
    out[:3, 3] = v
    return out


def scaling(v) -> np.ndarray:
    return np.diag([*np.broadcast_to(v, 3), 1.0])


def shear(xy=0.0, xz=0.0, yx=0.0, yz=0.0, zx=0.0, zy=0.0) -> np.ndarray:
    return np.array([[1, xy, xz, 0], [yx, 1, yz, 0], [zx, zy, 1, 0], [0, 0, 0, 1.0]])


def inverse(m: np.ndarray) -> np.ndarray:
    if abs(np.linalg.det(m)) <= 1e-10:
        raise ValueError("the transform has no inverse")
    return np.linalg.inv(m)


def perspective(fov: float, aspect: float, near: float, far: float) -> np.ndarray:
    """4 by 4: what lies in the frustum comes into the cube of -1..1; ``fov`` in degrees is upright, the view along -z."""
    f = 1 / math.tan(math.radians(fov) / 2)
    return np.array([[f / aspect, 0, 0, 0], [0, f, 0, 0], [0, 0, (far + near) / (near - far), 2 * far * near / (near - far)], [0, 0, -1, 0]])


def orthographic(left: float, right: float, bottom: float, top: float, near: float, far: float) -> np.ndarray:
    """4 by 4: what lies in the box comes into the cube of -1..1, the view along -z."""
    w, h, d = right - left, top - bottom, far - near
    return np.array([[2 / w, 0, 0, -(right + left) / w], [0, 2 / h, 0, -(top + bottom) / h], [0, 0, -2 / d, -(far + near) / d], [0, 0, 0, 1]])


def applied(m: np.ndarray, point) -> np.ndarray:
    """A point through a 4 by 4 matrix, divided by its last coordinate."""
    v = m @ np.array([*point, 1.0])
    return v[:3] / v[3]


@dataclass(frozen=True)
class Camera:
    """Where a frame is seen from. The scene lies at negative z after the transform."""

    position: tuple[float, float, float]
    lookat: tuple[float, float, float]
    sky: tuple[float, float, float] = (0.0, 0.0, 1.0)
    center: tuple[float, float, float] | None = None
    fov: float = 45.0
    xres: int = 800
    yres: int | None = None
    perspective: bool = True
    zmin: float = 0.0
    zmax: float = 1e23
    minrad: float = 1.0

    @property
    def height(self) -> int:
        return self.yres or self.xres

    @property
    def basis(self) -> np.ndarray:
        """Rows: right, up, backward."""
        z = unit(np.subtract(self.center or self.position, self.lookat))
        x = unit(np.cross(self.sky, z))
        return np.array([x, np.cross(z, x), z])

    @property
    def matrix(self) -> np.ndarray:
        """3 by 4: turn after moving the camera to the origin."""
        b = self.basis
        return np.hstack([b, -(b @ np.asarray(self.position, float))[:, None]])

    @property
    def shift(self) -> tuple[float, float]:
        """Pixels by which an off-axis image is moved."""
        if self.center is None:
            return 0.0, 0.0
        b, d = self.basis, np.subtract(self.center, self.position)
        f = 0.5 * self.xres / (math.tan(math.radians(self.fov) / 2) * math.dist(self.center, self.lookat))
        return -float(b[0] @ d) * f, -float(b[1] @ d) * f

    def orbit(self, axis, radians: float) -> Camera:
        turned = rotation(axis, radians)[:3, :3] @ np.subtract(self.position, self.lookat)
        return replace(self, position=tuple(np.add(self.lookat, turned)))

    def rotate(self, axis, radians: float) -> Camera:
        turned = rotation(axis, radians)[:3, :3] @ np.subtract(self.lookat, self.position)
        return replace(self, lookat=tuple(np.add(self.position, turned)))

    def pan(self, right: float, up: float) -> Camera:
        b = self.basis
        by = right * b[0] + up * b[1]
        return replace(self, position=tuple(np.add(self.position, by)), lookat=tuple(np.add(self.lookat, by)))

    def target(self, point) -> Camera:
        return replace(self, lookat=tuple(map(float, point)))


def stereo(camera: Camera, degrees: float) -> dict[str, Camera]:
    """Right and left eye, ``degrees`` apart as seen from the point looked at; the axis stays that of the one camera."""
    view = np.subtract(camera.lookat, camera.position)
    right = unit(np.cross(view, camera.sky)) * np.linalg.norm(view) * math.radians(degrees) / 2
    return {name: replace(camera, position=tuple(np.add(camera.position, s * right)), center=camera.position) for name, s in (("right_", 1), ("left_", -1))}


#: The directions of a panorama's faces, and what is up in each.
FACES = [((1, 0, 0), (0, 0, 1)), ((0, 1, 0), (0, 0, 1)), ((-1, 0, 0), (0, 0, 1)), ((0, -1, 0), (0, 0, 1)), ((0, 0, 1), (-1, 0, 0)), ((0, 0, -1), (1, 0, 0))]


def panorama(camera: Camera) -> dict[str, Camera]:
    """Six faces of a cube around the camera."""
    return {f"{i}_": replace(camera, lookat=tuple(np.add(camera.position, d).tolist()), sky=tuple(map(float, s)), fov=90.0) for i, (d, s) in enumerate(FACES, 1)}


def cosmic_step(a1: float, a2: float, *, omega=0.3, lam=0.7, hubble=0.7, v_unit=1e5, l_unit=3.085678e21) -> tuple[float, float, float]:
    """Time between two scale factors, and the factors that turn velocities into lengths over it."""
    parsec = 3.0856780e24

    def t(a: float) -> float:
        x = math.sqrt(lam / omega * a**3)
        return math.log(x + math.sqrt(x * x + 1)) / 1.5 / math.sqrt(lam) / hubble / 1e7 * parsec

    dt = (t(a2) - t(a1)) * hubble
    return dt, v_unit / l_unit / math.sqrt(a1) * dt, v_unit / l_unit / math.sqrt(a2) * dt
