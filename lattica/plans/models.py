"""Models: what moves each field. Right-hand sides are numpy over padded slabs of one block."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from lattica.operators import stencils
from lattica.operators.boundary import Extrapolate, Faces, Mirror
from lattica.plans.schema import TIME, Layout, StateBuilder, jump, wiener


@dataclass(frozen=True)
class Context:
    """Where a right-hand side is evaluated: spacing, time and cell centres (one array a dimension)."""

    spacing: tuple[float, ...]
    t: float
    centers: tuple[np.ndarray, ...]


class Model:
    """Fields, boundary rules and vector fields; override what a model needs."""

    drivers: tuple[str, ...] = ()

    def layout(self) -> Layout:
        builder = StateBuilder()
        self.register(builder)
        layout = builder.layout()
        layout.check(self.drivers)
        return layout

    def register(self, builder: StateBuilder) -> None:
        raise NotImplementedError

    def faces(self, name: str, t: float) -> Faces:
        return Mirror()

    def drift(self, slab: dict[str, np.ndarray], core: dict[str, np.ndarray], at: Context) -> dict[str, np.ndarray]:
        """Tendencies; ``slab`` has each field with one ghost layer a unit of its ghost width, ``core``
        without."""
        return {}

    def amplitude(self, driver: str, core: dict[str, np.ndarray], at: Context) -> dict[str, np.ndarray]:
        return {}

    def intensity(self, driver: str, core: dict[str, np.ndarray], at: Context) -> np.ndarray:
        raise NotImplementedError

    def project(self, core: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return core

    def stable_dt(self, spacing) -> float | None:
        return None


@dataclass
class Heat(Model):
    """du/dt = kappa lap(u)."""

    kappa: float = 0.7
    dim: int = 2
    rule: Faces = None

    def register(self, builder):
        builder.register("u", 1)

    def faces(self, name, t):
        return self.rule

    def drift(self, slab, core, at):
        return {"u": self.kappa * stencils.laplacian(slab["u"], at.spacing)}

    def stable_dt(self, spacing):
        return 0.8 / (2 * self.dim) * min(spacing) ** 2 / self.kappa


A1, A2 = 0.8836, 0.6267


@dataclass
class ModelC(Model):
    """Phase field of dendritic growth: an order parameter phi and a temperature u; ``oriented`` adds
    each grain's angle as a static field theta0, ``noise`` an additive noise on phi."""

    eps4: float = 0.06
    coupling: float = 3.19
    noise: float = 0.0
    oriented: bool = False
    tol: float = 1e-8

    def __post_init__(self):
        self.drivers = (wiener(0),) if self.noise else ()
        self.shape = stencils.Anisotropy(self.eps4, self.tol)

    @property
    def diffusivity(self) -> float:
        return A2 * self.coupling

    def register(self, builder):
        builder.register("phi", 1, (TIME, wiener(0)))
        builder.register("u", 1)
        if self.oriented:
            builder.register_static("theta0")

    def drift(self, slab, core, at):
        phi, u = core["phi"], core["u"]
        angle = core.get("theta0") if self.oriented else None
        flux = self.shape.divergence(slab["phi"], at.spacing, angle)
        a = self.shape.center(slab["phi"], angle)
        well = 1.0 - phi * phi
        d_phi = (flux - (phi * phi * phi - phi) - self.coupling * u * (well * well)) / (a * a)
        return {"phi": d_phi, "u": self.diffusivity * stencils.laplacian(slab["u"], at.spacing) + 0.5 * d_phi}

    def amplitude(self, driver, core, at):
        return {"phi": np.full_like(core["phi"], self.noise)}

    def stable_dt(self, spacing):
        return 0.2 * min(spacing) ** 2 / self.diffusivity


def grain_fields(grains, u0: float):
    """(phi, u, theta0) as functions of cell centres for grains (center, radius, orientation): phi is
    the greatest of the grains' profiles, floored at -1, u is -u0, theta0 the nearest grain's angle
    (the first of equals, 0 without grains)."""

    def far(center, at):
        return sum((x - c) ** 2 for c, x in zip(center, at, strict=True))

    def phi(*at):
        out = np.full(np.shape(at[0]), -1.0)
        for center, radius, _ in grains:
            out = np.maximum(out, -np.tanh((np.sqrt(far(center, at)) - radius) / math.sqrt(2)))
        return out

    def theta0(*at):
        best, angle = np.full(np.shape(at[0]), np.inf), np.zeros(np.shape(at[0]))
        for center, _, orientation in grains:
            d = far(center, at)
            angle = np.where(d < best, orientation, angle)
            best = np.minimum(best, d)
        return angle

    return {"phi": phi, "u": lambda *at: np.full(np.shape(at[0]), -u0), "theta0": theta0}


@dataclass(frozen=True)
class Side:
    """Order flow of one side of a market."""

    rate: float
    decay: float
    half_spread: float

    def fills(self, depth):
        depth = np.asarray(depth, float)
        return np.where(np.isinf(depth), 0.0, self.rate * np.exp(-self.decay * np.where(np.isinf(depth), 0.0, depth)))


@dataclass
class MarketMaker(Model):
    """Value of quoting at each inventory q, over a variance axis."""

    mu: float = 0.01
    psi: float = 0.1
    alpha: float = 0.01
    k: float = 1.0
    theta: float = 1.0
    sigma: float = 0.1
    sell: Side = Side(2.0, 2.0, 0.004)
    buy: Side = Side(1.0, 2.0, 0.004)
    q_min: int = -5
    q_max: int = 5
    min_spread: float = 1e-4
    nu_min: float = 0.001
    nu_max: float = 2.0

    @property
    def num_levels(self) -> int:
        return self.q_max - self.q_min + 1

    def name(self, q: int) -> str:
        return f"u_{q - self.q_min}"

    def register(self, builder):
        for q in range(self.q_min, self.q_max + 1):
            builder.register(self.name(q), 1)

    def faces(self, name, t):
        return Extrapolate()

    def drift(self, slab, core, at):
        nu, h = at.centers[0], at.spacing[0]
        pull = self.k * (self.theta - nu)
        out = {}
        for q in range(self.q_min, self.q_max + 1):
            u, wide = core[self.name(q)], slab[self.name(q)]
            curve = (wide[2:] + wide[:-2] - 2 * wide[1:-1]) / (h * h)
            rate = 0.5 * self.sigma**2 * nu * curve + pull * stencils.upwind(wide, pull, h) + self.mu * q - self.psi * self.sigma**2 * nu * q * q
            s, b = self.sell, self.buy
            if q > self.q_min:
                rate = rate + s.rate * (q * s.half_spread + np.exp(-s.decay * (self.alpha * (1 - 2 * q) + s.half_spread - core[self.name(q - 1)] + u)) / s.decay)
            else:
                rate = rate + s.rate * q * s.half_spread
            if q < self.q_max:
                rate = rate + b.rate * (-q * b.half_spread + np.exp(-b.decay * (self.alpha * (1 + 2 * q) + b.half_spread - core[self.name(q + 1)] + u)) / b.decay)
            else:
                rate = rate - b.rate * q * b.half_spread
            out[self.name(q)] = rate
        return out

    def depths(self, values: dict[int, float], q: int) -> tuple[float, float]:
        """Optimal (bid, ask) depths at inventory q: floored, infinite at a bound."""
        u, (s, b) = values[q], (self.sell, self.buy)
        bid = math.inf if q >= self.q_max else max(1 / b.decay + b.half_spread + self.alpha * (1 + 2 * q) - values[q + 1] + u, self.min_spread)
        ask = math.inf if q <= self.q_min else max(1 / s.decay + s.half_spread + self.alpha * (1 - 2 * q) - values[q - 1] + u, self.min_spread)
        return bid, ask

    def stable_dt(self, spacing):
        h = spacing[0]
        worst = max(self.sigma**2 * nu / (h * h) + abs(self.k * (self.theta - nu)) / h for nu in (self.nu_min, self.nu_max, min(max(self.theta, self.nu_min), self.nu_max)))
        return 0.8 / worst


@dataclass
class StochasticVol(Model):
    """Square-root variance nu and a mid price."""

    mu: float = 0.0
    k: float = 1.0
    theta: float = 1.0
    sigma: float = 0.1
    drivers: tuple[str, ...] = field(default=(wiener(0), wiener(1)))

    def register(self, builder):
        builder.register("nu", 0, (TIME, wiener(0)))
        builder.register("mid", 0, (TIME, wiener(1)))

    def drift(self, slab, core, at):
        return {"nu": self.k * (self.theta - np.maximum(core["nu"], 0)), "mid": np.full_like(core["mid"], self.mu)}

    def amplitude(self, driver, core, at):
        root = np.sqrt(np.maximum(core["nu"], 0))
        return {"nu": self.sigma * root} if driver == wiener(0) else {"mid": root}

    def project(self, core):
        return core | {"nu": np.maximum(core["nu"], 0)}


@dataclass
class JumpDiffusion(Model):
    """A drifting walk w, and on each fire of the jump count + 1 and jsum + payoff."""

    mu: float = 0.1
    sigma: float = 0.5
    payoff: float = 2.0
    drivers: tuple[str, ...] = field(default=(wiener(0), jump(0)))

    def register(self, builder):
        builder.register("w", 0, (TIME, wiener(0)))
        builder.register("count", 0, (jump(0),))
        builder.register("jsum", 0, (jump(0),))
        builder.register_static("lam")

    def drift(self, slab, core, at):
        return {"w": np.full_like(core["w"], self.mu)}

    def amplitude(self, driver, core, at):
        if driver == wiener(0):
            return {"w": np.full_like(core["w"], self.sigma)}
        return {"count": np.ones_like(core["count"]), "jsum": np.full_like(core["jsum"], self.payoff)}

    def intensity(self, driver, core, at):
        return core["lam"]


@dataclass
class CubicDecay(Model):
    """du/dt = -u^3."""

    def register(self, builder):
        builder.register("u")

    def drift(self, slab, core, at):
        return {"u": -(core["u"] ** 3)}


@dataclass
class ClampedDecay(Model):
    """dv/dt = -rate, never below floor."""

    rate: float = 1.0
    floor: float = 0.0

    def register(self, builder):
        builder.register("v")

    def drift(self, slab, core, at):
        return {"v": np.full_like(core["v"], -self.rate)}

    def project(self, core):
        return core | {"v": np.maximum(core["v"], self.floor)}
