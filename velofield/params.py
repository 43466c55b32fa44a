"""Parameters of the pipelines: frozen dataclasses that go to and from dictionaries, JSON and XML; unknown names raise."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from xml.etree import ElementTree


@dataclass(frozen=True)
class Grid:
    overlap: float = 0.5


@dataclass(frozen=True)
class FirstPass:
    shape_crop_im0: int | tuple[int, int] = 48
    shape_crop_im1: int | tuple[int, int] | None = None
    displacement_max: float | str | None = None
    method_correl: str = "fft"
    method_subpix: str = "2d_gaussian2"
    nsubpix: int | None = None
    nb_peaks_to_search: int = 1
    particle_radius: int = 3
    grid: Grid = field(default_factory=Grid)


@dataclass(frozen=True)
class Fix:
    correl_min: float = 0.2
    threshold_diff_neighbour: float | None = 10
    displacement_max: float | None = None


@dataclass(frozen=True)
class Multipass:
    number: int = 1
    coeff_zoom: int | tuple[int, ...] = 2
    use_tps: bool | str = "last"
    subdom_size: int = 200
    smoothing_coef: float = 5.0
    threshold_tps: float = 1.5


@dataclass(frozen=True)
class Series:
    path: str = ""
    str_subset: str = "pairs"
    ind_start: int | str = "first"
    ind_stop: int | None = None
    ind_step: int = 1


@dataclass(frozen=True)
class Saving:
    path: str | None = None
    how: str = "new_dir"
    postfix: str = "piv"


@dataclass(frozen=True)
class Features:
    max_corners: int = 70_000
    quality_level: float = 0.09
    min_distance: float = 4
    block_size: int = 16


@dataclass(frozen=True)
class Flow:
    win_size: int = 32
    max_level: int = 3
    max_count: int = 50
    epsilon: float = 0.03
    threshold_diff_ab_ba: float = 1.0
    displacement_min: float = 0.0
    displacement_max: float = float("inf")
    features: Features = field(default_factory=Features)


@dataclass(frozen=True)
class Surface:
    xmin: int = 475
    xmax: int = 640
    ymin: int = 50
    ymax: int = 700
    distance_lens: float = 0.36
    distance_object: float = 1.293
    pix_size: float = 2.4e-4
    startref_frame: int = 0
    lastref_frame: int = 49
    sur: int = 16
    k_x: float = 40.625
    k_y: float = 0.0
    slicer: int = 4
    red_factor: int = 1
    borders: int = 1
    correct_height: bool = False
    offset: float = 0.0


@dataclass(frozen=True)
class Piv:
    series: Series = field(default_factory=Series)
    piv0: FirstPass = field(default_factory=FirstPass)
    fix: Fix = field(default_factory=Fix)
    multipass: Multipass = field(default_factory=Multipass)
    saving: Saving = field(default_factory=Saving)
    mask: str | None = None


def from_dict(kind: type, values: dict):
    """Make a parameter tree from nested dictionaries; missing names keep their defaults, unknown ones raise."""
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise AttributeError(f"{kind.__name__} has no {', '.join(unknown)}")
    made = kind()
    given = {}
    for name, value in values.items():
        default = getattr(made, name)
        given[name] = from_dict(type(default), value) if is_dataclass(default) and isinstance(value, dict) else tuple(value) if isinstance(value, list) else value
    return kind(**{f: given.get(f, getattr(made, f)) for f in known})


def to_json(params) -> str:
    return json.dumps(asdict(params))


def from_json(kind: type, text: str):
    return from_dict(kind, json.loads(text))


def to_xml(params) -> str:
    """A tree whose elements are the nested parameters and whose attributes are values as JSON."""

    def element(name: str, values: dict) -> ElementTree.Element:
        made = ElementTree.Element(name)
        for key, value in values.items():
            if isinstance(value, dict):
                made.append(element(key, value))
            else:
                made.set(key, json.dumps(value))
        return made

    return ElementTree.tostring(element("params", asdict(params)), encoding="unicode")


def from_xml(kind: type, text: str):
    def values(element: ElementTree.Element) -> dict:
        return {k: json.loads(v) for k, v in element.attrib.items()} | {c.tag: values(c) for c in element}

    return from_dict(kind, values(ElementTree.fromstring(text)))
