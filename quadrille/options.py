"""Stream options: types, their compatibility, table sizes, and how unset ones are chosen."""

from __future__ import annotations

from dataclasses import dataclass, replace

# fixed values of the format
PHYSICAL = {"UNSPECIFIED": 0, "TRIPLES": 1, "QUADS": 2, "GRAPHS": 3}
LOGICAL = {"UNSPECIFIED": 0, "FLAT_TRIPLES": 1, "FLAT_QUADS": 2, "GRAPHS": 3, "DATASETS": 4, "SUBJECT_GRAPHS": 13, "NAMED_GRAPHS": 14, "TIMESTAMPED_NAMED_GRAPHS": 114}
TRIPLE_LOGICAL = ("FLAT_TRIPLES", "GRAPHS", "SUBJECT_GRAPHS")
FLAT = ("FLAT_TRIPLES", "FLAT_QUADS")
MIN_NAMES = 8
MAX_LOOKUP = 4096
VERSIONS = (1, 2)
DEFAULT_FRAME_SIZE = 250
PRESETS = {"default": (4000, 150, 32), "small": (128, 32, 32), "no_prefix": (128, 0, 32), "tiny": (16, 8, 32)}


class ConformanceError(ValueError):
    """Input or options that the format does not allow."""


def code(table: dict[str, int], value: str | int) -> int:
    if isinstance(value, str) and not value.lstrip("-").isdigit():
        if value.upper() not in table:
            raise NotImplementedError(f"unsupported stream type {value}")
        return table[value.upper()]
    if int(value) not in table.values():
        raise NotImplementedError(f"unsupported stream type {value}")
    return int(value)


def name(table: dict[str, int], value: int) -> str:
    return next((k for k, v in table.items() if v == value), f"UNKNOWN_{value}")


def compatible(physical: int, logical: int) -> bool:
    if not physical or not logical:
        return True
    return (physical == PHYSICAL["TRIPLES"]) == (name(LOGICAL, logical) in TRIPLE_LOGICAL)


def is_flat(logical: int) -> bool:
    return name(LOGICAL, logical) in FLAT


def framing_for(logical: int) -> str:
    """How frames are cut: by rows, or at the end of a graph or dataset."""
    kinds = {1: "rows", 2: "rows", 3: "graph", 4: "dataset"}
    base = logical % 10
    if base not in kinds:
        raise NotImplementedError(f"no framing for logical type {name(LOGICAL, logical)}")
    return kinds[base]


def version_for(namespaces: bool) -> int:
    return 2 if namespaces else 1


@dataclass(frozen=True)
class Options:
    stream_name: str = ""
    physical: int = 0
    logical: int = 0
    generalized: bool = False
    star: bool = False
    names: int = 4000
    prefixes: int = 150
    datatypes: int = 32
    version: int = 1

    def check(self) -> Options:
        if self.names < MIN_NAMES:
            raise ConformanceError(f"the name table needs at least {MIN_NAMES} entries")
        if max(self.names, self.prefixes, self.datatypes) > MAX_LOOKUP:
            raise ConformanceError(f"tables hold at most {MAX_LOOKUP} entries")
        if not VERSIONS[0] <= self.version <= VERSIONS[1]:
            raise ConformanceError(f"version {self.version} is not supported")
        if not compatible(self.physical, self.logical):
            raise ConformanceError(f"{name(PHYSICAL, self.physical)} cannot carry {name(LOGICAL, self.logical)}")
        return self

    @staticmethod
    def of(physical: str | int = "TRIPLES", logical: str | int = 0, preset: str = "default", *, namespaces: bool = False, stream_name: str = "", generalized: bool = True, star: bool = True, **sizes: int) -> Options:
        names, prefixes, datatypes = PRESETS[preset]
        made = Options(stream_name, code(PHYSICAL, physical), code(LOGICAL, logical), generalized, star, names, prefixes, datatypes, version_for(namespaces))
        return replace(made, **sizes).check()


def guess(has_graphs: bool) -> tuple[str, str]:
    """(physical, logical) for statements without options."""
    return ("QUADS", "FLAT_QUADS") if has_graphs else ("TRIPLES", "FLAT_TRIPLES")


def guess_physical(logical: int, has_graphs: bool) -> str:
    return "QUADS" if has_graphs and logical % 10 != LOGICAL["GRAPHS"] else "TRIPLES"


def check_strict(logical: int, mode: str) -> None:
    """A strict flat scan takes flat streams alone, a strict grouped scan specified ones that are not flat."""
    if mode == "flat" and not is_flat(logical):
        raise ConformanceError(f"expected FLAT logical type, got {name(LOGICAL, logical)}")
    if mode == "grouped" and (is_flat(logical) or not logical):
        raise ConformanceError(f"expected GROUPED logical type, got {name(LOGICAL, logical)}")
