"""Kinds of chunks by name: their flags, place in a file and parser. Users add kinds of their own."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chunks as ch

#: Where ancillary chunks stand.
PLACES = ("after_IHDR", "after_PLTE", "after_IDAT")


@dataclass(frozen=True)
class ChunkKind:
    """parse: a column of the chunk's data to a column of what it says. position: one of PLACES; None goes after the pixel data."""

    name: str
    parse: Callable[[Column], Column]
    ancillary: bool = True
    public: bool = True
    safe: bool = False
    position: str | None = None

    def __post_init__(self) -> None:
        """The letters' case must tell the flags."""
        if not re.fullmatch("[A-Za-z]{4}", self.name):
            raise ValueError(f"{self.name!r} isn't four letters")
        if self.position not in (None, *PLACES):
            raise ValueError(f"a position is one of {PLACES}")
        told = [c.islower() for c in self.name]
        for what, is_lower, wanted in zip(("first", "second", "third", "fourth"), told, (self.ancillary, not self.public, False, self.safe)):
            if is_lower != wanted:
                raise ValueError(f"the {what} letter of {self.name} must be {'lower' if wanted else 'upper'} case")


def conflict(kind: Column, ancillary: Column, public: Column, safe: Column) -> Column:
    """What the letters of names of a table say against the flags beside them, at the first such letter; null if they agree. A null name is none."""
    wanted = (("first", ancillary), ("second", ~public), ("third", F.lit(False)), ("fourth", safe))
    out = F.lit(None).cast("string")
    for k, (what, lower) in reversed(list(enumerate(wanted, 1))):
        told = F.concat(F.lit(f"the {what} letter of "), kind, F.lit(" must be "), F.when(lower, "lower").otherwise("upper"), F.lit(" case"))
        out = F.when(F.regexp_like(F.substring(kind, k, 1), F.lit("[a-z]")) != lower, told).otherwise(out)
    four = F.coalesce(F.regexp_like(kind, F.lit("^[A-Za-z]{4}$")), F.lit(False))
    return F.when(four, out).otherwise(F.concat(F.coalesce(kind, F.lit("null")), F.lit(" isn't four letters")))


_KINDS: dict[str, ChunkKind] = {}


def register(*kinds: ChunkKind) -> None:
    """Later kinds of a name replace earlier ones."""
    _KINDS.update({k.name: k for k in kinds})


def registered() -> dict[str, ChunkKind]:
    return dict(_KINDS)


def kind_of(name: str) -> ChunkKind | None:
    return _KINDS.get(name)


def parsed(name: str, data: Column) -> Column:
    """What the data of a registered kind says."""
    if name not in _KINDS:
        raise KeyError(f"no kind {name} is registered")
    return _KINDS[name].parse(data)


def position(kind: Column) -> Column:
    """The place of each kind's chunks in a file; unknown ones go after the pixel data."""
    out = F.lit("after_IDAT")
    for place in PLACES[:2]:
        out = F.when(kind.isin(*(k.name for k in _KINDS.values() if k.position == place)), place).otherwise(out)
    return out


_raw = lambda data: data
register(
    ChunkKind("IHDR", _raw, ancillary=False), ChunkKind("PLTE", ch.bytes_array, ancillary=False), ChunkKind("IDAT", _raw, ancillary=False), ChunkKind("IEND", _raw, ancillary=False),
    ChunkKind("tEXt", ch.parse_text_chunk, safe=True), ChunkKind("zTXt", ch.parse_ztext_chunk, safe=True), ChunkKind("iTXt", ch.parse_itext_chunk, safe=True), ChunkKind("tIME", ch.parse_time_chunk),
    ChunkKind("gAMA", ch.parse_gamma_chunk, position="after_IHDR"), ChunkKind("cHRM", ch.parse_chroma_chunk, position="after_IHDR"), ChunkKind("sBIT", ch.bytes_array, position="after_IHDR"),
    ChunkKind("hIST", lambda d: ch.bytes_array(d, 2), position="after_PLTE"), ChunkKind("pHYs", ch.parse_phys_chunk, safe=True, position="after_IHDR"), ChunkKind("oFFs", ch.parse_offs_chunk, safe=True, position="after_IHDR"),
    ChunkKind("bKGD", ch.background, position="after_PLTE"), ChunkKind("tRNS", ch.background, position="after_PLTE"), ChunkKind("eXIf", _raw, safe=True),
    ChunkKind("acTL", ch.parse_animation_control_chunk, public=False, position="after_IHDR"), ChunkKind("fcTL", ch.parse_frame_control_chunk, public=False), ChunkKind("fdAT", lambda d: F.struct(ch.read_uint(d, 0, 4).alias("seq"), F.substr(d, F.lit(5)).alias("stream")), public=False),
)
