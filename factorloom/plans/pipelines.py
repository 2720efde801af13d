"""Whole analyses composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from factorloom.operators.groups import GroupSummary, summarize_by
from factorloom.operators.intervals import region_map
from factorloom.operators.motif import motif_enrichment, regionise, soft_threshold
from factorloom.operators.scores import CellScores, score_from_z
from factorloom.operators.testing import add_fdr
from factorloom.session import materialize


@dataclass(frozen=True)
class TraitAnalysis:
    """Corrected results of one trait, its score per cell, and the summary per group."""

    results: DataFrame
    scores: CellScores
    summary: GroupSummary


def trait_analysis(
    cells: DataFrame,
    results: DataFrame,
    *,
    x: str,
    names: Sequence[str],
    trait: str,
    by: str | Sequence[str],
    model: str = "model",
    cell: str = "cell_id",
    direction: str | None = "pos",
    min_cells: int = 20,
) -> TraitAnalysis:
    """Correct the tests of all traits, score the cells for one of them, summarise by group.

    The tests of a trait are one family. `results` of the answer holds every trait; it is written
    once, and the scores read their trait from there.
    """
    keys = [by] if isinstance(by, str) else list(by)
    corrected = materialize(add_fdr(results, by="trait"))
    one = corrected.where(corrected["trait"] == trait)
    scores = score_from_z(
        cells, one, x=x, names=names, model=model, trait=trait, cell=cell, direction=direction, keep=keys
    )
    return TraitAnalysis(corrected, scores, summarize_by(scores.frame, "cs", by=keys, min_cells=min_cells))


def motif_analysis(
    features: DataFrame,
    regions: DataFrame,
    weights: DataFrame,
    scores: DataFrame,
    strata: DataFrame,
    *,
    feature: str = "peak",
    fraction: float = 0.4,
    threshold_pct: float = 0.0,
    tf: DataFrame | None = None,
    motifs: Sequence[str] | None = None,
) -> DataFrame:
    """Map features onto scored regions, average their weights there, test every motif."""
    pairs = region_map(features, regions, feature=feature, fraction=fraction)
    placed = regionise(pairs, soft_threshold(weights, threshold_pct), feature=feature)
    members = strata.join(pairs.select("region").distinct(), "region", "left_semi")
    return motif_enrichment(placed, scores, members, tf=tf, motifs=motifs)
