"""Time integrators over the slabs of one block."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from lattica.functions import rng
from lattica.plans.schema import stream_of


class Integrator:
    stages = 1
    seed = 0
    noisy = False

    def check(self, model) -> None:
        if model.drivers and not self.noisy:
            raise ValueError(f"{type(self).__name__} takes no stochastic drivers")

    def step(self, place, core, t: float, dt: float):
        raise NotImplementedError


@dataclass(frozen=True)
class ForwardEuler(Integrator):
    def step(self, place, core, t, dt):
        rate = place.drift(core, t)
        return core | {k: core[k] + dt * v for k, v in rate.items()}


@dataclass(frozen=True)
class RungeKutta4(Integrator):
    """Ghosts are filled again at every stage; the final sum adds the stages in order."""

    stages = 4

    def step(self, place, core, t, dt):
        def moved(rate, h):
            return core | {k: core[k] + h * v for k, v in rate.items()}

        k1 = place.drift(core, t)
        k2 = place.drift(moved(k1, 0.5 * dt), t + 0.5 * dt)
        k3 = place.drift(moved(k2, 0.5 * dt), t + 0.5 * dt)
        k4 = place.drift(moved(k3, dt), t + dt)
        out = dict(core)
        for weight, rate in ((dt / 6, k1), (dt / 3, k2), (dt / 3, k3), (dt / 6, k4)):
            for k, v in rate.items():
                out[k] = out[k] + weight * v
        return out


@dataclass(frozen=True)
class EulerMaruyama(Integrator):
    """Drift and all amplitudes from the state before the step, then drivers in their order. A draw is
    shared by all fields that its driver moves."""

    seed: int = 0
    noisy = True

    def step(self, place, core, t, dt):
        out = ForwardEuler().step(place, core, t, dt)
        for driver in place.model.drivers:
            amplitude = place.amplitude(driver, core, t)
            keys = rng.cell_keys(self.seed, t, stream_of(driver), place.block, place.cell)
            if driver.startswith("wiener"):
                draw = math.sqrt(dt) * rng.standard_normal(keys)
                out = out | {k: out[k] + np.where(v == 0, 0.0, v * draw) for k, v in amplitude.items()}
            else:
                rate = place.model.intensity(driver, core, place.at(t))
                fire = (rate > 0) & (rng.unit_open(keys) < -np.expm1(-rate * dt))
                out = out | {k: out[k] + np.where(fire, v, 0.0) for k, v in amplitude.items()}
        return out


def suggested_dt(model, grid) -> float | None:
    return model.stable_dt(grid.finest_spacing)


def substeps(coarse_dt: float, fine_dt: float) -> int:
    """Fine steps a coarse step, halves rounded up."""
    return max(1, math.floor(coarse_dt / fine_dt + 0.5))
