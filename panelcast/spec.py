"""Model specification for a reduced-form VAR."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum


class Det(IntEnum):
    """Deterministic terms: none, constant, linear trend, constant + trend."""

    NONE = 0
    CONST = 1
    TREND = 2
    CONST_TREND = 3


@dataclass(frozen=True)
class VarSpec:
    lags: int
    det: Det = Det.CONST
    exogenous: bool = False

    def __post_init__(self):
        if int(self.lags) <= 0:
            raise ValueError("lags must be > 0")
        object.__setattr__(self, "det", Det(int(self.det)))
        if self.exogenous:
            raise ValueError("exogenous variables are not supported")

    @property
    def has_const(self) -> bool:
        return self.det in (Det.CONST, Det.CONST_TREND)

    @property
    def has_trend(self) -> bool:
        return self.det in (Det.TREND, Det.CONST_TREND)

    @property
    def n_det(self) -> int:
        return int(self.has_const) + int(self.has_trend)

    def n_regressors(self, k: int) -> int:
        return self.n_det + self.lags * k

    def term_names(self, variables: list[str]) -> list[tuple[str, int, str]]:
        """(term, lag, variable) for every regressor, in design-column order."""
        out: list[tuple[str, int, str]] = []
        if self.has_const:
            out.append(("const", 0, ""))
        if self.has_trend:
            out.append(("trend", 0, ""))
        for j in range(1, self.lags + 1):
            for v in variables:
                out.append(("lag", j, v))
        return out
