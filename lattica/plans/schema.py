"""Declared fields and the drivers that move them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from lattica.functions import rng

TIME = "time"


def wiener(j: int = 0) -> str:
    return f"wiener:{j}"


def jump(j: int = 0) -> str:
    return f"jump:{j}"


def stream_of(driver: str) -> int:
    kind, _, index = driver.partition(":")
    return {"time": 0, "wiener": rng.stream_tag(rng.WIENER, int(index or 0)), "jump": rng.stream_tag(rng.JUMP, int(index or 0))}[kind]


@dataclass(frozen=True)
class FieldSpec:
    name: str
    ghost: int = 0
    drivers: frozenset[str] = frozenset({TIME})

    @property
    def static(self) -> bool:
        return not self.drivers

    def driven_by(self, driver: str) -> bool:
        return driver in self.drivers


@dataclass
class StateBuilder:
    """Collects the fields of a model before any data exist."""

    fields: list[FieldSpec] = field(default_factory=list)

    def register(self, name: str, ghost: int = 0, drivers=(TIME,)) -> str:
        if any(f.name == name for f in self.fields):
            raise ValueError(f"field {name} is registered twice")
        self.fields.append(FieldSpec(name, ghost, frozenset(drivers)))
        return name

    def register_static(self, name: str, ghost: int = 0) -> str:
        return self.register(name, ghost, ())

    def layout(self) -> Layout:
        return Layout(tuple(self.fields))


@dataclass(frozen=True)
class Layout:
    fields: tuple[FieldSpec, ...]

    def __getitem__(self, name: str) -> FieldSpec:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def dynamic(self) -> list[str]:
        return [f.name for f in self.fields if not f.static]

    def moved_by(self, driver: str) -> list[str]:
        return [f.name for f in self.fields if f.driven_by(driver)]

    @property
    def ghost(self) -> int:
        return max((f.ghost for f in self.fields), default=0)

    @property
    def ghost_widths(self) -> list[int]:
        """The different widths that are filled, in order."""
        return sorted({f.ghost for f in self.fields if f.ghost})

    def check(self, drivers) -> None:
        """Wieners come first, then jumps; each needs a field that it moves."""
        kinds = [d.partition(":")[0] for d in drivers]
        if kinds != sorted(kinds, key=["wiener", "jump"].index):
            raise ValueError("Wiener drivers stand before jump drivers")
        for d in drivers:
            if not self.moved_by(d):
                raise ValueError(f"no field is registered for driver {d}")

    def block_schema(self) -> StructType:
        cols = [StructField(f.name, ArrayType(DoubleType()), True, {"ghost": f.ghost, "drivers": sorted(f.drivers)}) for f in self.fields]
        return StructType([StructField("block_id", LongType(), False), *cols])


def only_moved(state: DataFrame, layout: Layout, driver: str) -> DataFrame:
    """The columns that a driver moves, and the block id."""
    return state.select("block_id", *layout.moved_by(driver))
