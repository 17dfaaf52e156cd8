"""Pixel kernels on NumPy arrays (H x W x 3 of uint8, masks H x W of bool or [0, 1]); every random step takes a generator."""

from __future__ import annotations

import io
import math
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from patchmill.errors import ConfigError, DataError


class Later:
    """A picture, or its noise, that is worked out when it is asked for."""

    __slots__ = ("_make", "_pixels", "shape")

    def __init__(self, shape: tuple[int, ...], make: Callable[[], np.ndarray]):
        self.shape, self._make, self._pixels = shape, make, None

    def now(self) -> np.ndarray:
        if self._make is not None:
            self._pixels, self._make = self._make(), None
        return self._pixels


def now(img: np.ndarray | Later) -> np.ndarray:
    return img.now() if isinstance(img, Later) else img


class Draws:
    """A generator that puts off the noise of pictures that come later until something else is drawn, or they are asked for; so all draws stay the same, and noise that nothing depends on is not drawn."""

    def __init__(self, rng: np.random.Generator):
        self._rng, self._due = rng, None

    def __getattr__(self, name: str):
        if self._due is not None:
            self._due.now()
            self._due = None
        return getattr(self._rng, name)

    def noise(self, shape: tuple[int, ...], draw: Callable[[np.random.Generator], np.ndarray]) -> Later:
        if self._due is not None:
            self._due.now()
        self._due = Later(shape, lambda: draw(self._rng))
        return self._due


def drawn(img: np.ndarray | Later, rng: np.random.Generator | Draws, draw: Callable[[np.random.Generator], np.ndarray]) -> np.ndarray | Later:
    """Noise of a picture's shape, later where both the picture and the draws can wait."""
    return rng.noise(img.shape, draw) if isinstance(img, Later) and isinstance(rng, Draws) else draw(rng)


def then(img: np.ndarray | Later, step: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | Later:
    """What a step that draws nothing and keeps the shape makes of a picture, later where the picture comes later."""
    return Later(img.shape, lambda: step(img.now())) if isinstance(img, Later) else step(img)


@dataclass(frozen=True)
class Blob:
    """Distribution of soft rotated ellipses."""

    area: tuple[float, float] = (0.10, 0.40)
    aspect: tuple[float, float] = (1.0, 2.5)
    softness: float = 3.0
    lobes: int = 0
    amplitude: float = 0.0

    def __post_init__(self) -> None:
        if not 0 < self.area[0] <= self.area[1] < 1 or not 1 <= self.aspect[0] <= self.aspect[1] or self.softness <= 0 or self.lobes < 0 or not 0 <= self.amplitude < 1:
            raise ConfigError(f"not a blob distribution: {self}")


@lru_cache(64)
def _line(size: int) -> np.ndarray:
    return np.arange(size, dtype=float)


@lru_cache(64)
def _cells(size: int) -> np.ndarray:
    return np.stack(np.meshgrid(np.arange(size), np.arange(size), indexing="xy"), -1)


def _ellipse(size: int, rng: np.random.Generator, blob: Blob) -> tuple[float, float, float, float, list[float]]:
    """(long half axis, short one, cosine, sine, centre) of an ellipse of sampled area share, axis ratio and angle that lies inside the image."""
    uniform = rng.uniform
    share, ratio, turn = uniform(*blob.area), uniform(*blob.aspect), uniform(0, math.pi)
    short = math.sqrt(share * size * size / (math.pi * ratio))
    long, c, s = ratio * short, math.cos(turn), math.sin(turn)
    x, y = long * c, short * s
    reach = min(math.sqrt(x * x + y * y), size / 2 - 1)
    x, y = long * s, short * c
    down = min(math.sqrt(x * x + y * y), size / 2 - 1)
    return long, short, c, s, [uniform(reach, size - reach), uniform(down, size - down)]


def blob_mask(size: int, rng: np.random.Generator, blob: Blob = Blob()) -> np.ndarray:
    """A soft mask of an ellipse of sampled area share, axis ratio and angle that lies inside the image."""
    return _soft(size, blob, *_ellipse(size, rng, blob))


def _soft(size: int, blob: Blob, long: float, short: float, c: float, s: float, centre: list[float]) -> np.ndarray:
    local = (_cells(size) - centre) @ np.array([[c, s], [-s, c]]).T
    x, y = local[..., 0] / long, local[..., 1] / short
    dist = np.sqrt(x * x + y * y)
    if blob.lobes and blob.amplitude:
        dist = dist * (1 + blob.amplitude * np.sin(blob.lobes * np.arctan2(local[..., 1], local[..., 0])))
    return (1 / (1 + np.exp(-np.clip((1 - dist) * short / blob.softness, -60, 60)))).astype(np.float32)


def blob_cells(size: int, rng: np.random.Generator, blob: Blob = Blob()) -> np.ndarray:
    """The cells where blob_mask is a half or more, by the sign of the ellipse's equation; where a cell is so close to the bound that rounding could tell, by the mask itself."""
    long, short, c, s, centre = e = _ellipse(size, rng, blob)
    u, v = (_line(size) - x for x in centre)
    a, b = 1 / (long * long), 1 / (short * short)
    rows, cols = np.empty((size, 3)), np.empty((3, size))
    rows[:, 0], rows[:, 1], rows[:, 2] = v * v, v, 1
    cols[0], cols[1], cols[2] = s * s * a + c * c * b, (2 * c * s * (a - b)) * u, (c * c * a + s * s * b) * u * u - 1
    f = rows @ cols
    near = 1e-5 * (1 + blob.softness / short)
    inside = f <= -near
    if (blob.lobes and blob.amplitude) or np.count_nonzero(inside) != np.count_nonzero(f < near):
        return _soft(size, blob, *e) >= 0.5
    return inside


def as_alpha(mask: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A mask of any kind as weights in [0, 1]."""
    a = np.asarray(mask, dtype=np.float32)
    if a.shape != tuple(shape):
        raise DataError(f"mask of {a.shape} for an image of {tuple(shape)}")
    return np.clip(a / 255 if a.max(initial=0) > 1 else a, 0, 1)


def blend(back: np.ndarray | Later, front: np.ndarray | Later, alpha: np.ndarray) -> np.ndarray | Later:
    """front over back by alpha, cut off to whole values."""
    if isinstance(back, Later) or isinstance(front, Later):
        return Later(back.shape, lambda: blend(now(back), now(front), alpha))
    if alpha.dtype == bool and alpha.shape == back.shape[:2] and back.dtype == front.dtype == np.uint8:
        return np.where(alpha[..., None], front, back)
    a = as_alpha(alpha, back.shape[:2])[..., None]
    return np.clip(back * (1 - a) + front * a, 0, 255).astype(np.uint8)


def degrade_region(img: np.ndarray, mask: np.ndarray, how: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The whole image is degraded, and the region of it kept."""
    return blend(img, how(img), mask)


@lru_cache(4096)
def _places(n: int, m: int) -> tuple[np.ndarray, ...]:
    """For n cells over m: the nearest, the one before and after, and the weights of these two."""
    a = (np.arange(n) + 0.5) * m / n - 0.5
    lo = np.clip(np.floor(a), 0, m - 1).astype(int)
    w = np.clip(a - lo, 0, 1)
    return np.clip(np.floor(a + 0.5), 0, m - 1).astype(int), lo, np.minimum(lo + 1, m - 1), 1 - w, w


def resize(img: np.ndarray, size: tuple[int, int], nearest: bool = False) -> np.ndarray:
    """Image or mask at (rows, columns), sampled at cell centres."""
    if nearest:
        rows, cols = (_places(n, m)[0] for n, m in zip(size, img.shape[:2], strict=True))
        return img.take(rows, 0).take(cols, 1)
    return resize_each(img[None], size)[0]


def resize_each(imgs: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """resize of images of one shape, along the first axis."""
    out = imgs.astype(np.float64)
    for axis, (n, m) in enumerate(zip(size, imgs.shape[1:3], strict=True), 1):
        _, lo, hi, v, w = _places(n, m)
        w, v = (x.reshape([-1 if k == axis else 1 for k in range(out.ndim)]) for x in (w, v))
        before, after = out.take(lo, axis), out.take(hi, axis)
        before *= v
        after *= w
        out = np.add(before, after, out=before)
    return np.rint(out, out=out).astype(imgs.dtype) if imgs.dtype == np.uint8 else out  # weighted means of bytes, so within their range


def gauss_noise(img: np.ndarray | Later, rng: np.random.Generator, std: float) -> np.ndarray | Later:
    noise = drawn(img, rng, lambda g: g.standard_normal(img.shape))
    return then(img, lambda a: (np.clip(a / 255.0 + std * now(noise), 0, 1) * 255).astype(np.uint8))


def shot_noise(img: np.ndarray | Later, rng: np.random.Generator | Draws, peak: float) -> np.ndarray | Later:
    """How much is drawn for a value depends on it, so where something is drawn later on, the picture must be worked out before."""
    p = max(float(peak), 8.0)
    return drawn(img, rng, lambda g: (np.minimum(g.poisson(now(img) / 255.0 * p) / p, 1) * 255).astype(np.uint8))


def down_up(img: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    h, w = img.shape[:2]
    return resize(resize(img, (max(8, int(h * scale)), max(8, int(w * scale)))), (h, w))


def blur(img: np.ndarray, rng: np.random.Generator, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return img.copy()
    r = max(1, math.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = img.astype(np.float64)
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in range(out.ndim)]
        p = np.pad(out, pad, mode="edge")
        out = sum(w * p.take(range(i, i + out.shape[axis]), axis) for i, w in enumerate(k))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


# The standard quantisation tables of brightness and colour at quality 50, row by row.
BRIGHT = """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"""
COLOUR = """17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"""
_K = np.arange(8)
DCT = np.where(_K[:, None] == 0, math.sqrt(1 / 8), 0.5) * np.cos((2 * _K + 1) * _K[:, None] * math.pi / 16)
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
FROM_YCC = np.linalg.inv(TO_YCC)


@lru_cache(256)
def _table(t: str, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(t.split(), dtype=int).reshape(8, 8) * scale + 50) // 100, 1, 255)


def _blocks(plane: np.ndarray) -> np.ndarray:
    """The blocks of 8 x 8 of a plane less 128, side by side."""
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") if h % 8 or w % 8 else plane
    return (p - 128.0).reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)


def _coded(planes: list[np.ndarray], tables: list[np.ndarray]) -> list[np.ndarray]:
    """Planes after their blocks of 8 x 8 were transformed, rounded by the table of each and transformed back; the blocks of all planes meet in one product."""
    own = [_blocks(p) for p in planes]
    b = np.concatenate(own)
    both = lambda m, x: (m @ np.ascontiguousarray((m @ np.ascontiguousarray(x.transpose(1, 0, 2)).reshape(8, -1)).reshape(8, -1, 8).transpose(2, 1, 0)).reshape(8, -1)).reshape(8, -1, 8).transpose(1, 2, 0)  # noqa: E731  # m @ x @ m.T
    t = np.repeat(np.stack(tables).astype(float), [len(x) for x in own], 0)
    f = both(DCT, b) / t
    b = both(DCT.T, np.rint(f, out=f) * t)
    out, at = [], 0
    for p, x in zip(planes, own, strict=True):
        h, w = p.shape
        y = b[at : at + len(x)].reshape(-(-h // 8), -(-w // 8), 8, 8).swapaxes(1, 2).reshape(-(-h // 8) * 8, -1)[:h, :w]
        out.append(np.clip(np.rint(y + 128.0), 0, 255))
        at += len(x)
    return out


def jpeg(img: np.ndarray, rng: np.random.Generator, quality: int) -> np.ndarray:
    """What a JPEG round trip at a quality leaves: colours halved in both directions, blocks rounded. Its coding of bits loses nothing, so it isn't carried out."""
    q = min(max(int(quality), 1), 100)
    h, w = img.shape[:2]
    ycc = img.reshape(-1, 3).astype(np.float64) @ TO_YCC.T
    ycc[:, 1:] += 128.0
    ycc = ycc.reshape(h, w, 3)
    planes = [ycc[..., 0]]
    for c in (1, 2):
        p = np.pad(ycc[..., c], ((0, h % 2), (0, w % 2)), mode="edge") if h % 2 or w % 2 else ycc[..., c]
        planes.append(p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean((1, 3)))
    y = np.empty((h, w, 3))
    y[..., 0], *halves = _coded(planes, [_table(BRIGHT, q), *[_table(COLOUR, q)] * 2])
    for c, half in enumerate(halves, 1):
        y[..., c] = np.repeat(np.repeat(half, 2, 0), 2, 1)[:h, :w] - 128.0
    out = y.reshape(-1, 3) @ FROM_YCC.T
    return np.clip(np.rint(out, out=out), 0, 255, out=out).astype(np.uint8).reshape(h, w, 3)


# Fixed value: the first bytes of a PNG file.
PNG_MAGIC = bytes.fromhex("89504e470d0a1a0a")


def png_bytes(img: np.ndarray, level: int = 6) -> bytes:
    """A PNG of an image (H x W x 3) or a mask (H x W), of 8 bits a value; level 0 stores them as they are."""
    a = np.asarray(img, dtype=np.uint8)
    rows = np.concatenate([np.zeros((len(a), 1), np.uint8), a.reshape(len(a), -1)], 1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """The pixels of a PNG of 8 bits a value without interlacing: H x W for grey ones, else H x W x 3; DataError for all else."""
    if data[:8] != PNG_MAGIC:
        raise DataError("no PNG")
    at, parts, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise DataError(f"a PNG breaks off at byte {at}")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
    else:
        raise DataError("a PNG has no end")
    if head is None or head[2] != 8 or head[6] != 0 or head[3] not in (0, 2, 3, 4, 6):
        raise DataError(f"a PNG of kind {head}")
    w, h, k = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
        lines = raw.reshape(h, 1 + w * k)
    except (zlib.error, ValueError) as e:
        raise DataError(f"a PNG cannot be read: {e}") from e
    if lines[:, 0].any():
        out = np.zeros((h, w * k), np.uint8)
        up = np.zeros(w * k, np.uint8)
        for y in range(h):
            up = out[y] = _unfilter(int(lines[y, 0]), lines[y, 1:], up, k)
    else:
        out = lines[:, 1:].copy()
    px = out.reshape(h, w, k)
    if head[3] == 3:
        return palette[px[..., 0]]
    return px[..., 0] if k < 3 else px[..., :3]


def _unfilter(kind: int, line: np.ndarray, up: np.ndarray, k: int) -> np.ndarray:
    """A line of a PNG from its differences to the pixels left of it, above it or both."""
    if kind == 0:
        return line
    if kind == 2:
        return line + up
    if kind == 1:
        return np.cumsum(line.reshape(-1, k), 0, dtype=np.uint8).ravel()
    if kind not in (3, 4):
        raise DataError(f"a PNG line of kind {kind}")
    out = [0] * len(line)
    for i, (x, b) in enumerate(zip(line.tolist(), up.tolist(), strict=True)):
        a = out[i - k] if i >= k else 0
        if kind == 3:
            p = (a + b) // 2
        else:
            c = int(up[i - k]) if i >= k else 0
            d = (abs(b - c), abs(a - c), abs(a + b - 2 * c))
            p = (a, b, c)[d.index(min(d))]
        out[i] = (x + p) & 255
    return np.array(out, np.uint8)


def read_pixels(path: str) -> np.ndarray:
    """The pixels of a file; PNG is read here, other formats by Pillow where it is there. DataError where a file is missing or cannot be decoded."""
    try:
        if "://" in path:
            from pyarrow import fs

            f, at = fs.FileSystem.from_uri(path)
            with f.open_input_file(at) as r:
                data = r.read()
        else:
            with open(path.removeprefix("file:"), "rb") as r:
                data = r.read()
    except (OSError, ValueError) as e:
        raise DataError(f"cannot open {path}: {e}") from e
    return decoded(data, path)


def decoded(data: bytes, name: str) -> np.ndarray:
    """The pixels of the bytes of a file of that name, as read_pixels has them."""
    if data[:8] == PNG_MAGIC:
        return png_pixels(data)
    try:
        from PIL import Image

        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except ImportError as e:
        raise DataError(f"{name}: formats other than PNG need Pillow") from e
    except Exception as e:  # whatever a decoder makes of broken bytes
        raise DataError(f"cannot decode {name}: {e}") from e


@dataclass(frozen=True)
class Grid:
    """A square picture of whole patches."""

    side: int
    patch: int

    def __post_init__(self) -> None:
        if self.side <= 0 or self.patch <= 0 or self.side % self.patch:
            raise ConfigError(f"a side of {self.side} is no whole number of patches of {self.patch}")

    @property
    def per_side(self) -> int:
        return self.side // self.patch

    @property
    def patches(self) -> int:
        return self.per_side**2


def square_grid(n: int) -> tuple[int, int] | None:
    """(rows, columns) of n patches in a square, None where n is no square."""
    s = math.isqrt(max(n, 0))
    return (s, s) if s and s * s == n else None


def fit(img: np.ndarray, grid: Grid, *, mask: bool = False) -> np.ndarray:
    """img at the grid's size, stretched; masks keep their values."""
    return resize(img, (grid.side, grid.side), nearest=mask)


def centre_crop(img: np.ndarray, grid: Grid) -> np.ndarray:
    """The square in the middle, at the grid's size."""
    h, w = img.shape[:2]
    s = min(h, w)
    t, l = round((h - s) / 2), round((w - s) / 2)
    return fit(img[t : t + s, l : l + s], grid)


def random_window(h: int, w: int, rng: np.random.Generator, scale=(0.3, 1.0), ratio=(0.75, 4 / 3), tries: int = 10) -> tuple[int, int, int, int]:
    """(top, left, height, width) of a window of random area share and side ratio; where none fits, the largest in the middle of a ratio within bounds."""
    for _ in range(tries):
        area, r = rng.uniform(*scale) * h * w, math.exp(rng.uniform(math.log(ratio[0]), math.log(ratio[1])))
        ww, hh = round(math.sqrt(area * r)), round(math.sqrt(area / r))
        if 0 < ww <= w and 0 < hh <= h:
            return int(rng.integers(0, h - hh + 1)), int(rng.integers(0, w - ww + 1)), hh, ww
    r = min(max(w / h, ratio[0]), ratio[1])
    hh, ww = (h, min(w, round(h * r))) if w / h > r else (min(h, round(w / r)), w)
    return (h - hh) // 2, (w - ww) // 2, hh, ww


def natural_crop(mask: np.ndarray, cover: float, rng: np.random.Generator) -> tuple[int, int, int, float] | None:
    """(top, left, side, coverage) of a square sized so that the mask would fill a share of it, anywhere that it touches the mask's box; None for an empty mask."""
    at = np.argwhere(mask)
    if not len(at):
        return None
    full = np.array(mask.shape)
    side = max(8, min(round(math.sqrt(len(at) / max(cover, 1e-6))), *full))
    last = np.maximum(full - side, 0)
    lo = np.clip(at.min(0) - side + 1, 0, last)
    hi = np.clip(at.max(0), 0, last)
    t, l = (int(rng.integers(min(a, b), max(a, b) + 1)) for a, b in zip(lo, hi, strict=True))
    return t, l, int(side), float(mask[t : t + side, l : l + side].sum()) / side**2


def place(cells: np.ndarray, box: tuple[int, int, int, int], h: int, w: int) -> np.ndarray:
    """A mask of h x w that is empty but for the box (x0, y0, x1, y1), which the cells fill, each the pixels nearest to it."""
    x0, y0, x1, y1 = box
    out = np.zeros((h, w), bool)
    out[y0:y1, x0:x1] = resize(np.asarray(cells, bool), (y1 - y0, x1 - x0), nearest=True)
    return out


def minority_box(labels: np.ndarray, side: int, pad: float) -> tuple[tuple[int, int, int, int] | None, float]:
    """((r0, r1, c0, c1), share) of the smaller of two clusters on a grid, ends exclusive, padded by a share of its sides; None where it is empty, 1 where equal."""
    g = np.asarray(labels).reshape(side, side)
    m = g == (1 if (g == 1).sum() <= (g != 1).sum() else 0)
    at = np.argwhere(m)
    if not len(at):
        return None, 0.0
    lo, hi = at.min(0), at.max(0) + 1
    d = np.maximum(1, np.rint((hi - lo) * pad)).astype(int)
    lo, hi = np.maximum(lo - d, 0), np.minimum(hi + d, side)
    return (int(lo[0]), int(hi[0]), int(lo[1]), int(hi[1])), float(m.mean())


def place_fine(pred: np.ndarray, box: tuple[int, int, int, int], grid: Grid) -> np.ndarray:
    """A second look's patches at the place of their box (r0, r1, c0, c1) in the grid, as pixels of the whole."""
    r0, r1, c0, c1 = (v * grid.patch for v in box)
    cells = np.asarray(pred, bool).reshape(grid.per_side, grid.per_side)
    return place(resize(cells, (grid.side, grid.side), nearest=True), (c0, r0, c1, r1), grid.side, grid.side)


def invariance_pair(img: np.ndarray, rng: np.random.Generator, families: tuple[str, ...], steps: int = 2) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """(clean, corrupted, operations): a picture and what distinct corruptions leave of it."""
    out, ops = img, []
    for c in draw_distinct(rng, steps, families):
        out = c.apply(out, rng)
        ops.append(c.op())
    return img.copy(), out, ops


def flip(img: np.ndarray | Later, mask: np.ndarray | None = None):
    return then(img, lambda a: a[:, ::-1].copy()), None if mask is None else mask[:, ::-1].copy()


def ramp(x: float, worst: float, best: float) -> float:
    """0 at best, 1 at worst and beyond."""
    return float(min(1.0, max(0.0, (x - best) / (worst - best)))) if worst != best else 0.0


@dataclass(frozen=True)
class Family:
    """A corruption: its kernel, how its parameters are drawn, its severity, whether the kernel draws."""

    run: Callable
    draw: Callable[[np.random.Generator], dict]
    severity: Callable[[dict], float]
    noise: bool = False


FAMILIES: dict[str, Family] = {
    "clean": Family(lambda i, g: i.copy(), lambda g: {}, lambda p: 0.0),
    "gaussian": Family(gauss_noise, lambda g: {"std": g.uniform(0.02, 0.12)}, lambda p: ramp(p["std"], 0.30, 0.0), True),
    "poisson": Family(shot_noise, lambda g: {"peak": g.uniform(8, 96)}, lambda p: ramp(p["peak"], 8, 96), True),
    "resize": Family(down_up, lambda g: {"scale": g.uniform(0.35, 0.85)}, lambda p: ramp(p["scale"], 0.0, 1.0)),
    "blur": Family(blur, lambda g: {"sigma": g.uniform(0.0, 3.0)}, lambda p: ramp(p["sigma"], 3.0, 0.0)),
    "jpeg": Family(jpeg, lambda g: {"quality": int(g.integers(35, 66))}, lambda p: ramp(p["quality"], 35, 100)),
    "double_jpeg": Family(lambda i, g, q1, q2: jpeg(jpeg(i, g, q1), g, q2), lambda g: _two(g), lambda p: ramp(min(p["q1"], p["q2"]), 35, 100)),
}


def _two(g: np.random.Generator) -> dict:
    q1 = int(g.integers(82, 97))
    return {"q1": q1, "q2": min(q1, int(g.integers(35, 86)))}


@dataclass(frozen=True)
class Corruption:
    family: str
    params: dict = field(default_factory=dict)

    def apply(self, img: np.ndarray | Later, rng: np.random.Generator) -> np.ndarray | Later:
        if self.family not in FAMILIES:
            raise KeyError(f"unknown corruption {self.family!r}")
        f = FAMILIES[self.family]
        return f.run(img, rng, **self.params) if f.noise else then(img, lambda a: f.run(a, rng, **self.params))

    def op(self) -> dict:
        """The record kept with a sample: name, parameters, severity."""
        return {"name": self.family, "params": {k: float(v) for k, v in self.params.items()}, "severity": FAMILIES[self.family].severity(self.params)}


def draw_corruption(rng: np.random.Generator, families: tuple[str, ...], clean: bool = False) -> Corruption:
    own = [*families, *["clean"] * clean]
    f = own[int(rng.integers(len(own)))]  # as choice draws
    if f not in FAMILIES:
        raise KeyError(f"unknown corruption {f!r}")
    return Corruption(f, FAMILIES[f].draw(rng))


def draw_distinct(rng: np.random.Generator, n: int, families: tuple[str, ...], tries: int = 16) -> list[Corruption]:
    """n corruptions that differ from one another in family or parameters, as far as tries allow."""
    out: list[Corruption] = []
    for _ in range(n):
        c = draw_corruption(rng, families)
        for _ in range(tries):
            if c not in out:
                break
            c = draw_corruption(rng, families)
        out.append(c)
    return out


def light_chain(img: np.ndarray, rng: np.random.Generator, steps: list[tuple[str, float, tuple[float, float]]]) -> tuple[np.ndarray, list[dict]]:
    """Independent steps (family, probability, range of its one parameter) in a fixed order; severities run over each range."""
    name = {"gaussian": "std", "poisson": "peak", "resize": "scale", "blur": "sigma", "jpeg": "quality"}
    ops = []
    for family, p, (lo, hi) in steps:
        if rng.random() < p:
            v = rng.uniform(lo, hi)
            img = Corruption(family, {name[family]: v}).apply(img, rng)
            worst, best = (lo, hi) if family in ("poisson", "resize", "jpeg") else (hi, lo)
            ops.append({"name": family, "params": {name[family]: float(v)}, "severity": ramp(v, worst, best)})
    return img, ops


# What each kind of degradation example does: (dominant corruption over: none, all or a large blob; target over a small blob or none).
VARIANTS = {"clean_plus_small": ("none", True), "global_plus_small": ("all", True), "large_plus_small": ("large", True), "global_negative": ("all", False)}


@lru_cache(64)
def _rising(probs: tuple[float, ...]) -> np.ndarray:
    c = (np.array(probs) / sum(probs)).cumsum()
    return c / c[-1]


def degradation_example(img: np.ndarray | Later, rng: np.random.Generator, *, families: tuple[str, ...], probs: tuple[float, ...] = (0.35, 0.25, 0.25, 0.15), small=(0.05, 0.25), large=(0.45, 0.80), clean_target: float = 0.2, overlap: float = 0.08, tries: int = 24) -> tuple[np.ndarray | Later, np.ndarray, dict, list[dict]]:
    """(image, target mask, facts, operations) of a multi-region example: a dominant corruption and a target corruption elsewhere or on top."""
    size = img.shape[0]
    variant = [*VARIANTS][int(_rising(tuple(probs)).searchsorted(rng.random(), side="right"))]  # as choice draws
    where, has_target = VARIANTS[variant]
    dominant = draw_corruption(rng, families) if where != "none" else Corruption("clean")
    target = Corruption("clean")
    if has_target:
        others = tuple(f for f in families if f != dominant.family) or families
        target = draw_corruption(rng, others)
        if where == "all" and rng.random() < clean_target:
            target = Corruption("clean")
    big = np.zeros((size, size), bool)
    if where == "large":
        big = blob_cells(size, rng, Blob(area=large))
    elif where == "all":
        big[:] = True
    spot = np.zeros((size, size), bool)
    for _ in range(tries if has_target else 0):
        spot = blob_cells(size, rng, Blob(area=small))
        if where != "large" or np.count_nonzero(spot & big) / max(1, min(np.count_nonzero(spot), np.count_nonzero(big))) <= overlap:
            break
    out = blend(img, dominant.apply(img, rng), big) if where != "none" else then(img, np.copy)
    if has_target:
        out = blend(out, target.apply(img, rng), spot)
    share = float(spot.mean())
    context = 1.0 - share if where == "none" else float(big.mean())
    treated = int(has_target and target.family != "clean") + int(where != "none" and has_target)
    facts = {
        "variant": variant, "dominant_family": dominant.family, "target_family": target.family if has_target else "none",
        "degrade_type": target.family if target.family != "clean" else dominant.family, "num_regimes": {"none": 2, "all": 2 if has_target else 1, "large": 3}[where],
        "num_treated_regions": treated, "target_area_frac": share, "dominant_area_frac": context,
        "is_global_negative": int(not has_target), "is_multi_region": int(where == "large" or (where == "all" and target.family != "clean" and has_target)), "has_large_context": int(context > 0.5),
    }
    return out, spot, facts, [c.op() for c in (dominant, target) if c.family != "clean"]


def grow(seeds: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Cells of where that 4-connected paths through it join to a seed."""
    now = seeds & where
    while True:
        p = np.pad(now, 1)
        new = (p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]) & where
        if (new == now).all():
            return now
        now = new


def otsu(v: np.ndarray) -> float:
    """The cut of greatest variance between sides."""
    v = np.sort(np.asarray(v, float))
    if len(v) < 2:
        return float(v[-1] + 1) if len(v) else math.inf
    i = np.arange(1, len(v))
    c = v.cumsum()
    k = int(np.argmax(i * (len(v) - i) * (c[:-1] / i - (c[-1] - c[:-1]) / (len(v) - i)) ** 2))
    return float(v[k] + v[k + 1]) / 2


def hysteresis(att: np.ndarray, mads: float = 1.0) -> np.ndarray:
    """Cells above a strong threshold, and weaker ones joined to them; the weak threshold stays above the background's spread."""
    strong = otsu(att.ravel())
    if not (att >= strong).any():
        return np.zeros(att.shape, bool)
    below = att[att < strong]
    med = float(np.median(att))
    floor = med + mads * float(np.median(np.abs(att - med)))
    weak = min(max(otsu(below) if len(below) >= 3 else strong, floor), strong)
    return grow(att >= strong, att >= weak)


def blobs(hot: np.ndarray, least: int = 4) -> list[tuple[int, int, int, int, np.ndarray]]:
    """(r0, r1, c0, c1, cells) of 8-connected regions of at least ``least`` cells, in the order of their first cell."""
    left, out = {(int(r), int(c)) for r, c in np.argwhere(hot)}, []
    for start in sorted(left):
        if start not in left:
            continue
        stack, cells = [start], []
        left.discard(start)
        while stack:
            r, c = stack.pop()
            cells.append((r, c))
            for n in ((r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if n in left:
                    left.discard(n)
                    stack.append(n)
        if len(cells) >= least:
            a = np.array(sorted(cells))
            out.append((*map(int, (a[:, 0].min(), a[:, 0].max(), a[:, 1].min(), a[:, 1].max())), a))
    return out


def zoom_boxes(att: np.ndarray, hot: np.ndarray, most: int = 3, merge: float = 0.3) -> list[tuple[int, int, int, int]]:
    """Boxes of regions, merged while any two overlap by more than ``merge``, the heaviest by attention first; all hot cells as one box where no region is large enough."""
    own = blobs(hot)
    if not own:
        at = np.argwhere(hot)
        return [] if not len(at) else [(int(at[:, 0].min()), int(at[:, 0].max()), int(at[:, 1].min()), int(at[:, 1].max()))]
    boxes = [(b[:4], {tuple(x) for x in b[4].tolist()}) for b in own]

    def overlap(a, b) -> float:
        h, w = min(a[1], b[1]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[2], b[2]) + 1
        inter = max(h, 0) * max(w, 0)
        area = lambda x: (x[1] - x[0] + 1) * (x[3] - x[2] + 1)
        return inter / (area(a) + area(b) - inter)

    while True:
        pair = next(((i, j) for i in range(len(boxes)) for j in range(i + 1, len(boxes)) if overlap(boxes[i][0], boxes[j][0]) > merge), None)
        if pair is None:
            break
        (a, x), (b, y) = boxes[pair[0]], boxes[pair[1]]
        boxes[pair[0]] = ((min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])), x | y)
        del boxes[pair[1]]
    mass = [sum(att[c] for c in cells) for _, cells in boxes]
    return [boxes[i][0] for i in sorted(range(len(boxes)), key=lambda i: -mass[i])[:most]]


def oracle_crop(mask: np.ndarray, rng: np.random.Generator, cover=(0.10, 0.40), jitter: float = 0.25) -> tuple[int, int, int, float] | None:
    """(top, left, side, coverage) of a square around the mask sized for a coverage, the mask's box always inside; None for an empty mask."""
    at = np.argwhere(mask)
    if not len(at):
        return None
    full = np.array(mask.shape)
    lo, hi = at.min(0), at.max(0) + 1
    side = int(round(max(math.sqrt(len(at) / max(rng.uniform(*cover), 1e-6)), *(hi - lo))))
    side = max(8, min(side, *full))
    j = round(jitter * side)
    corner = np.rint(at.mean(0) - side / 2).astype(int) + np.rint(rng.uniform(-j, j, 2)).astype(int)
    corner = np.maximum(np.maximum(0, hi - side), np.minimum(corner, np.minimum(lo, full - side)))
    t, l = map(int, corner)
    return t, l, side, float(mask[t : t + side, l : l + side].mean())


def paired_crop(mask: np.ndarray, rng: np.random.Generator, scale=(0.3, 1.0), least: float = 0.0, tries: int = 24) -> tuple[int, int, int, bool]:
    """(top, left, side, found) of a random square whose mask share is at least ``least``; the centre square where none is found."""
    h, w = mask.shape
    for _ in range(tries):
        side = max(1, int(round(math.sqrt(rng.uniform(*scale)) * min(h, w))))
        t, l = int(rng.integers(0, h - side + 1)), int(rng.integers(0, w - side + 1))
        if mask[t : t + side, l : l + side].mean() >= least:
            return t, l, side, True
    s = min(h, w)
    return (h - s) // 2, (w - s) // 2, s, False


def heat(grid: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Values from least to greatest as colours, cells replicated."""
    g = np.asarray(grid, float)
    span = g.max() - g.min()
    v = (g - g.min()) / span if span > 0 else np.zeros_like(g)
    rgb = np.clip(1.5 - np.abs(4 * v[..., None] - np.array([3.0, 2.0, 1.0])), 0, 1)
    return resize((rgb * 255).astype(np.uint8), size, nearest=True)


def tint(base: np.ndarray, labels: np.ndarray, colours: dict[int, tuple[int, int, int]], alpha: float = 0.45) -> np.ndarray:
    """Cells of each label in its colour over the image."""
    lab, out = resize(labels, base.shape[:2], nearest=True), base
    for k, c in colours.items():
        out = blend(out, np.broadcast_to(np.array(c, np.uint8), base.shape), (lab == k) * float(alpha))
    return out
