"""Synthetic underwater degradation of pictures, one operation at a time.

A picture is linear light from 0 to 1. Every operation is a function of the light, of what is known of
the scene (how far each pixel is, what the water is like, where lamps shine) and of a generator of its
own, seeded by the picture's seed and the operation's name. So which other operations are on does not
change what one draws, and a sweep over severities degrades one and the same scene.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from .kernels import cosine_basis, resize

OPERATIONS = ("attenuation", "light", "backscatter", "particles", "low_light", "white_balance", "blur", "noise", "compression")

#: Attenuation per metre (least and most, for red, green, blue), veiling colour, and share.
WATERS = {
    "train": {
        "ocean": ((0.30, 0.04, 0.02), (0.60, 0.12, 0.08), (0.02, 0.18, 0.35), 0.35),
        "coastal": ((0.40, 0.10, 0.15), (0.90, 0.30, 0.40), (0.04, 0.24, 0.22), 0.35),
        "lake": ((0.50, 0.30, 0.80), (1.20, 0.70, 2.00), (0.16, 0.20, 0.06), 0.30),
    },
    "eval": {
        "open_ocean_deep": ((0.45, 0.05, 0.03), (0.55, 0.07, 0.04), (0.01, 0.10, 0.25), 0.5),
        "turbid_river": ((0.9, 0.8, 1.5), (1.4, 1.1, 2.5), (0.20, 0.17, 0.08), 0.5),
    },
}
#: How likely each operation is where it is drawn.
CHANCES = {"attenuation": 0.9, "backscatter": 0.8, "light": 0.35, "low_light": 0.4, "white_balance": 0.3, "particles": 0.5, "blur": 0.4, "noise": 0.6, "compression": 0.3}
#: The groups of a robustness sweep.
GROUPS = {
    "haze": ("attenuation", "backscatter"),
    "low_light": ("low_light", "noise"),
    "noise": ("noise",),
    "particles": ("particles",),
    "blur": ("blur",),
    "compression": ("compression",),
    "light": ("light", "attenuation", "backscatter"),
}
#: The standard quantisation tables of luminance and chrominance.
LUMA = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]).reshape(8, 8)
CHROMA = np.array([17, 18, 24, 47, 18, 21, 26, 66, 24, 26, 56, 99, 47, 66, 99, 99]).reshape(4, 4)


@dataclass
class Scene:
    """What the operations of one picture share. Sizes are those of a picture of 224 pixels."""

    height: int
    width: int
    severity: float
    seed: int
    variant: str = "train"

    def rng(self, name: str) -> np.random.Generator:
        return np.random.default_rng([self.seed & 0xFFFFFFFF, zlib.crc32(name.encode())])

    @cached_property
    def unit(self) -> float:
        return max(self.height, self.width) / 224

    @cached_property
    def distance(self) -> np.ndarray:
        """Metres to what each pixel shows: a mean, a slope from top to bottom and soft bumps."""
        r = self.rng("distance")
        bumps = resize(r.random((4, 4)), self.height, self.width) - 0.5
        slope = r.uniform(-0.6, 0.6) * np.linspace(-0.5, 0.5, self.height)[:, None]
        return np.maximum((0.5 + 7.5 * self.severity * r.random()) * (1 + 0.6 * self.severity * bumps + slope), 0.1)

    @cached_property
    def water(self) -> tuple[np.ndarray, np.ndarray]:
        """(attenuation, veiling colour) of the three channels."""
        r, kinds = self.rng("water"), list(WATERS[self.variant].values())
        low, high, veil, _ = kinds[r.choice(len(kinds), p=np.array([k[3] for k in kinds]) / sum(k[3] for k in kinds))]
        return r.uniform(low, high), np.array(veil) * r.uniform(0.7, 1.3, 3)

    @cached_property
    def lamps(self) -> np.ndarray:
        """One or two cones of light over a floor that a severe scene has little of."""
        r = self.rng("lamps")
        y, x = np.linspace(0, 1, self.height)[:, None], np.linspace(0, 1, self.width)[None]
        cones = 0.0
        for _ in range(1 + (r.random() < 0.4)):
            cx, cy, radius = r.uniform((0.25, 0.15, 0.25), (0.75, 0.65, 0.7))
            cones = cones + np.exp(-((x - cx) ** 2 + ((y - cy) * self.height / self.width) ** 2) / radius**2)
        floor = 0.02 + 0.25 * (1 - self.severity)
        return (floor + (1 - floor) * np.clip(cones, 0, 1))[..., None]

    @cached_property
    def dark(self) -> bool:
        """Whether a lit scene has next to no other light."""
        return self.rng("depth").random() < 0.5

    def ambient(self, lit: bool) -> float:
        return self.rng("ambient").uniform(*((0.0, 0.08) if lit and self.dark else (0.4, 1.0)))


def spread(picture: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """`picture` with every point spread as `kernel`, edges mirrored; by Fourier transforms."""
    pad = len(kernel) // 2
    wide = np.pad(picture, ((pad, pad), (pad, pad), (0, 0)), mode="symmetric")
    full = [n + len(kernel) - 1 for n in wide.shape[:2]]
    made = np.fft.irfft2(np.fft.rfft2(wide, full, (0, 1)) * np.fft.rfft2(kernel, full)[..., None], full, (0, 1))
    return made[2 * pad : 2 * pad + picture.shape[0], 2 * pad : 2 * pad + picture.shape[1]]


def grid(size: float) -> tuple[np.ndarray, np.ndarray]:
    half = max(1, int(size) // 2)
    return np.mgrid[-half : half + 1, -half : half + 1].astype(float)[::-1]


def oval(size: float, sigma: float, long: float = 1.0, angle: float = 0.0) -> np.ndarray:
    """A Gaussian of a sum of 1, `long` times as wide along `angle`."""
    x, y = grid(size)
    along, across = x * np.cos(angle) + y * np.sin(angle), y * np.cos(angle) - x * np.sin(angle)
    k = np.exp(-((along / max(sigma * long, 0.3)) ** 2 + (across / max(sigma, 0.3)) ** 2) / 2)
    return k / k.sum()


def disk(size: float, radius: float, rim: float = 0.0) -> np.ndarray:
    """A soft disk of a sum of 1, with a brighter rim."""
    off = np.hypot(*grid(size)) - max(radius, 0.5)
    k = (1 + rim * np.exp(-2 * off**2)) / (1 + np.exp(3 * off))
    return k / k.sum()


def attenuation(light: np.ndarray, s: Scene, on: frozenset[str]) -> np.ndarray:
    return light * np.exp(-s.water[0] * s.distance[..., None])


def lamp_light(light: np.ndarray, s: Scene, on: frozenset[str]) -> np.ndarray:
    return light * s.lamps


def backscatter(light: np.ndarray, s: Scene, on: frozenset[str]) -> np.ndarray:
    beta, veil = s.water
    scattered = beta * s.rng("backscatter").uniform(0.8, 1.2, 3)
    shine = s.ambient("light" in on) + (0.35 * s.lamps if "light" in on else 0.0)
    return light + (0.6 + 0.8 * s.severity) * shine * veil * -np.expm1(-scattered * s.distance[..., None])


def particles(light: np.ndarray, s: Scene, on: frozenset[str]) -> np.ndarray:
    r, pixels = s.rng("particles"), s.height * s.width
    count = r.binomial(pixels, min(1.0, (0.0003 + 0.004 * s.severity * r.random()) / s.unit**2))
    field = np.bincount(r.integers(0, pixels, count), r.uniform(0.2, 1.0, count) ** 2, pixels).reshape(s.height, s.width, 1)
    if s.variant == "train":
        field = 6 * spread(field, oval(8 * s.unit + 1, r.uniform(0.5, 2.0) * s.unit, 1 + 3 * r.random() * (r.random() < 0.3), r.uniform(0, np.pi)))
    else:
        field = 4 * spread(field, disk(8 * s.unit + 1, r.uniform(1.0, 3.0) * s.unit, 0.5))
    shine = s.lamps if "light" in on else 0.4 + 0.6 * s.ambient(False)
    return light + field * shine * np.array([0.9, 1.0, 1.0])


def low_light(light: np.ndarray, s: Scene, on: frozenset[str]) -> np.ndarray:
    return light * (1 - s.severity * (1 - np.exp(s.rng("exposure").uniform(np.log(0.03), np.log(0.5)))))


def white_balance(light: np.ndarray, s: Scene, on: frozenset[str]) -> np.ndarray:
    return light * np.exp(0.15 * s.severity * s.rng("gains").standard_normal(3))


def blur(light: np.ndarray, s: Scene, on: frozenset[str]) -> np.ndarray:
    r, size = s.rng("blur"), 11 * s.unit
    kind, much = r.integers(3), s.severity * r.random()
    kernels: tuple[Callable[[], np.ndarray], ...] = (
        lambda: oval(size, (0.4 + 2.0 * much) * s.unit),
        lambda: disk(size, (0.5 + 3.0 * much) * s.unit),
        lambda: oval(size, (1.0 + 7.0 * much) * s.unit / 2.5, 6.0, r.uniform(0, np.pi)),
    )
    return spread(light, kernels[kind]())


def noise(light: np.ndarray, s: Scene, on: frozenset[str]) -> np.ndarray:
    """Of photons, fewer where it is dark, mostly alike in all channels, and of reading them."""
    r, signal = s.rng("noise"), np.maximum(light, 0)
    photons = np.exp(r.uniform(np.log(150.0), np.log(3000.0))) * (1.3 - s.severity)
    read = 0.002 + 0.010 * s.severity * r.random()
    if s.variant == "train":
        shot = np.sqrt(signal / photons) * (0.85 * r.standard_normal((s.height, s.width, 1)) + 0.45 * r.standard_normal(light.shape))
    else:
        shot = (0.5 * read + 0.02 * s.severity) * r.standard_normal(light.shape)
    return signal + shot + read * r.standard_normal((s.height, s.width, 1))


LIT = {"attenuation": attenuation, "light": lamp_light, "backscatter": backscatter, "particles": particles, "low_light": low_light, "white_balance": white_balance, "blur": blur, "noise": noise}

#: Red, green, blue to luminance and the two differences of colour.
YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def compressed(picture: np.ndarray, quality: float) -> np.ndarray:
    """A picture of 0 to 1 as a block-transform code of this quality would give it back."""
    h, w = picture.shape[:2]
    wide = np.pad(picture * 255, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    planes = np.einsum("hwc,dc->dhw", wide, YCC) - np.array([128.0, 0.0, 0.0])[:, None, None]
    halved = planes[1:].reshape(2, wide.shape[0] // 2, 2, wide.shape[1] // 2, 2).mean((2, 4))
    planes[1:] = halved.repeat(2, 1).repeat(2, 2)
    table = np.full((3, 8, 8), 99.0)
    table[0], table[1:, :4, :4] = LUMA, CHROMA
    step = np.maximum(table * (50 / quality if quality < 50 else 2 - quality / 50), 1)[:, None, :, None, :]
    basis = cosine_basis(8)
    blocks = planes.reshape(3, wide.shape[0] // 8, 8, wide.shape[1] // 8, 8)
    coded = np.round(np.einsum("ij,cajbk,lk->caibl", basis, blocks, basis) / step) * step
    back = np.einsum("ij,caibl,lk->cajbk", basis, coded, basis).reshape(planes.shape) + np.array([128.0, 0.0, 0.0])[:, None, None]
    return (np.einsum("dhw,cd->hwc", back, np.linalg.inv(YCC))[:h, :w] / 255).clip(0, 1)


def degrade(image: np.ndarray, operations: Iterable[str], severity: float, seed: int, variant: str = "eval") -> np.ndarray:
    """A picture of 0 to 255 under `operations`, in their physical order. A picture that is dark already
    is not darkened further."""
    on = frozenset(operations)
    if unknown := on - set(OPERATIONS):
        raise ValueError(f"no operation {', '.join(sorted(unknown))}; there are {', '.join(OPERATIONS)}")
    x = np.asarray(image, dtype=np.float64) / 255
    s = Scene(*x.shape[:2], float(severity), seed, variant)
    light = x**2.2
    for name, apply in LIT.items():
        if name in on and not (name == "low_light" and (x @ np.array([0.2126, 0.7152, 0.0722])).mean() <= 0.08):
            light = apply(light, s, on)
    out = np.round(light.clip(0, 1) ** (1 / 2.2) * 255) / 255
    if "compression" in on:
        quality = s.rng("compression").uniform(15, 70) * (1.3 - 0.6 * s.severity)
        out = compressed(out, float(np.clip(quality, 5, 95)))
    return (out * 255).round().astype(np.uint8)


def drawn(seed: int, chance: float = 0.8, severity: tuple[float, float] = (0.2, 1.0)) -> tuple[tuple[str, ...], float]:
    """The operations and the severity that a training picture gets; none with 1 - chance."""
    rng = np.random.default_rng([seed & 0xFFFFFFFF, 1])
    on = tuple(name for name, p in CHANCES.items() if rng.random() < p)
    return (on if rng.random() < chance else ()), float(rng.uniform(*severity))


def views(image: np.ndarray, mode: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(what a model sees, what it is to predict): both clear, both degraded alike, the first alone, or
    each degraded by itself."""
    one = lambda k: degrade(image, *drawn(k), k, "train")
    made = {"none": lambda: (image, image), "shared": lambda: (one(seed),) * 2, "context_only": lambda: (one(seed), image), "independent": lambda: (one(seed), one(seed + 1))}
    if mode not in made:
        raise ValueError(f"no mode {mode}; there are {', '.join(made)}")
    return made[mode]()
