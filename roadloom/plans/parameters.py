"""Parameters of a graph build and the names of what it leaves."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class BuildParameters:
    """Options of ``plans.pipelines.build_graph`` for one area, and where its files go.

    Lengths are metres (pixels without a transform), angles degrees; all but the turn
    penalty have to be at least 0.
    """

    area: str
    folder: str = "data/processed"
    resolution: float = 1.0
    min_edge: float = 0.5
    min_stub: float = 15.0
    gap: float = 40.0
    max_angle: float = 60.0
    penalty: float = 2.0
    merge: float = 10.0
    tolerance: float = 1.5

    def __post_init__(self) -> None:
        wrong = [k for k, v in self.options().items() if k != "penalty" and v < 0]
        if wrong:
            raise ValueError(f"negative: {wrong}")

    def options(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k not in ("area", "folder")}

    def _file(self, what: str) -> str:
        return f"{self.folder.rstrip('/')}/{self.area}_{what}"

    @property
    def graph_file(self) -> str:
        return self._file("graph.graphml")

    @property
    def features_file(self) -> str:
        return self._file("graph.geojson")

    @property
    def criticality_file(self) -> str:
        return self._file("criticality.csv")

    @property
    def curve_file(self) -> str:
        return self._file("resilience.csv")
