"""Declarative column mapping."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def apply_mapping(frame: DataFrame, mappings: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """Keep only the listed columns, renamed and cast.

    Each mapping is ``(source, source type, target, target type)``; the source is read as its
    stated type and then cast to the target type.
    """
    return frame.selectExpr(
        *(
            f"CAST(CAST(`{source}` AS {source_type}) AS {target_type}) AS `{target}`"
            for source, source_type, target, target_type in mappings
        )
    )
