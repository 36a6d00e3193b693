"""Requests for statistics, compiled to aggregate columns with the names of the results.

Names: S_mean; S_lo_hi (cutpoints); S_atrb (transitions); S_pN; S_lohz_hihz; S_topfreq_i, S_topmag_i; S_lo_hi_bouts_sum and
S_lo_hi_bouts_num, with _mtN before the last part for bouts of N seconds or more; S_sdN.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERIC = ("mean", "sum", "std", "min", "max", "n", "missing")
#: Rendered where a window has no valid sample.
EMPTY = -1


@dataclass(frozen=True)
class Generic:
    names: tuple[str, ...] = ("mean",)

    def __post_init__(self):
        if unknown := set(self.names) - set(GENERIC):
            raise ValueError(f"unknown statistics: {sorted(unknown)}")


@dataclass(frozen=True)
class Cutpoints:
    """Counts of samples in closed ranges, which may overlap."""

    ranges: tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class Bigrams:
    """Counts of transitions between neighbouring valid samples of a window."""

    values: tuple[float, ...]


@dataclass(frozen=True)
class Percentiles:
    """Linearly interpolated percentiles, 0 to 100."""

    percentages: tuple[float, ...]


@dataclass(frozen=True)
class FrequencyRanges:
    """Sums of spectral magnitudes between frequencies in hertz."""

    ranges: tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class TopFrequencies:
    count: int


@dataclass(frozen=True)
class Bouts:
    """Seconds and number of bouts in closed value ranges; (lo, hi) or (lo, hi, least seconds)."""

    ranges: tuple[tuple[float, ...], ...]


@dataclass(frozen=True)
class Sdx:
    percentages: tuple[int, ...]


def number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def names(signal: str, statistics: list) -> list[str]:
    """Result columns of a list of requests, in order."""
    out: list[str] = []
    for s in statistics:
        if isinstance(s, Generic):
            out += [f"{signal}_{x}" for x in s.names]
        elif isinstance(s, Cutpoints):
            out += [f"{signal}_{number(a)}_{number(b)}" for a, b in s.ranges]
        elif isinstance(s, Bigrams):
            out += [f"{signal}_{number(a)}tr{number(b)}" for a in s.values for b in s.values]
        elif isinstance(s, Percentiles):
            out += [f"{signal}_p{number(p)}" for p in s.percentages]
        elif isinstance(s, FrequencyRanges):
            out += [f"{signal}_{number(a)}hz_{number(b)}hz" for a, b in s.ranges]
        elif isinstance(s, TopFrequencies):
            out += [f"{signal}_{kind}_{i}" for i in range(s.count) for kind in ("topfreq", "topmag")]
        elif isinstance(s, Bouts):
            for a, b, *least in s.ranges:
                stem = f"{signal}_{number(a)}_{number(b)}_bouts" + (f"_mt{number(least[0])}" if least else "")
                out += [f"{stem}_sum", f"{stem}_num"]
        elif isinstance(s, Sdx):
            out += [f"{signal}_sd{p}" for p in s.percentages]
        else:
            raise ValueError(f"unknown statistic: {s!r}")
    return out


def _ranked(value: Column, p: float) -> Column:
    """A percentile from samples' rank (from 1) among the valid ones of their group and their number, ranks."""
    place = (F.col("ranks") - 1) * (p / 100)
    at = lambda rank: F.max(F.when(F.col("rank") == rank, value))
    low, high = at(F.floor(place) + 1), at(F.ceil(place) + 1)
    share = F.max(F.when(~F.col("missing"), place - F.floor(place)))
    return low + (high - low) * share


def aggregates(signal: str, statistics: list, named: bool = True, ranked: bool = False) -> list[Column]:
    """Aggregate columns over samples (value, missing, and previous for Bigrams).

    ranked: samples have rank and ranks, from which percentiles come; without them a group's distinct values are held.
    """
    valid, gone = ~F.col("missing"), F.col("missing")
    value, out = F.when(valid, F.col("value")), []
    generic = {
        "mean": F.avg(value), "sum": F.sum(value), "std": F.stddev_pop(value), "min": F.min(value), "max": F.max(value), "n": F.count_if(valid), "missing": F.count_if(gone),
    }
    for s in statistics:
        if isinstance(s, Generic):
            out += [generic[x] for x in s.names]
        elif isinstance(s, Cutpoints):
            out += [F.count_if(valid & F.col("value").between(float(a), float(b))) for a, b in s.ranges]
        elif isinstance(s, Bigrams):
            out += [F.count_if(valid & (F.col("previous") == float(a)) & (F.col("value") == float(b))) for a in s.values for b in s.values]
        elif isinstance(s, Percentiles):
            out += [_ranked(value, p) if ranked else F.percentile(value, F.lit(p / 100)) for p in s.percentages]
        else:
            raise ValueError(f"{s!r} has an operator of its own")
    return [c.alias(n) for c, n in zip(out, names(signal, statistics), strict=True)] if named else out


def rendered(signal: str, statistics: list) -> list[Column]:
    """Result columns with the values that empty windows show: 0 for counts, -1 for the rest."""
    zero: set[str] = set()
    for s in statistics:
        if isinstance(s, (Cutpoints, Bigrams, Bouts)):
            zero |= set(names(signal, [s]))
        elif isinstance(s, Generic):
            zero |= {f"{signal}_{x}" for x in s.names if x in ("n", "missing")}
    return [F.coalesce(F.col(f"`{n}`"), F.lit(0).cast("long") if n in zero else F.lit(EMPTY).cast("double")).alias(n) for n in names(signal, statistics)]


def ordinal(n: str) -> str:
    last = "th" if n[-2:] in ("11", "12", "13") else {"1": "st", "2": "nd", "3": "rd"}.get(n[-1], "th")
    return n + last


def dictionary(signal: str, statistics: list) -> list[tuple[str, str]]:
    """Result column and what it means, for all requests."""
    words = {"mean": "Mean", "sum": "Sum", "std": "Population standard deviation", "min": "Minimum", "max": "Maximum", "n": "Number of valid samples", "missing": "Number of missing samples"}
    out: list[str] = []
    for s in statistics:
        if isinstance(s, Generic):
            out += [f"{words[x]} of {signal}" for x in s.names]
        elif isinstance(s, Cutpoints):
            out += [f"Samples of {signal} from {number(a)} to {number(b)}" for a, b in s.ranges]
        elif isinstance(s, Bigrams):
            out += [f"Transitions of {signal} from {number(a)} to {number(b)}" for a in s.values for b in s.values]
        elif isinstance(s, Percentiles):
            out += [f"{ordinal(number(p))} percentile of {signal}" for p in s.percentages]
        elif isinstance(s, FrequencyRanges):
            out += [f"Spectral magnitude of {signal} from {number(a)} to {number(b)} Hz" for a, b in s.ranges]
        elif isinstance(s, TopFrequencies):
            out += [f"{what} of the {ordinal(str(i + 1))} largest spectral component of {signal}" for i in range(s.count) for what in ("Frequency", "Magnitude")]
        elif isinstance(s, Bouts):
            for a, b, *least in s.ranges:
                stem = f"bouts of {signal} from {number(a)} to {number(b)}" + (f" of {number(least[0])} s or more" if least else "")
                out += [f"Seconds in {stem}", f"Number of {stem}"]
        else:
            out += [f"Length in minutes up to which bouts make up {p} % of bout time of {signal}" for p in s.percentages]
    return list(zip(names(signal, statistics), out, strict=True))
