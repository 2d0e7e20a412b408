"""Scoring of a stream: signals of a document need no other document but a frozen reference.

Self mode is a property of the whole corpus and has no streaming form. Each micro-batch is scored in
reference mode; a stateless plan, so that no watermark is needed and a replayed batch gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import fusion as fu
from ..operators.language_model import LanguageModel
from ..plans.profile import profile


def score_stream(stream: DataFrame, reference_stats: DataFrame, model: LanguageModel, calibration: fu.Calibration, path: str, checkpoint: str, **options):
    """Starts a query that writes scored micro-batches as Parquet below ``path``."""
    stats = reference_stats.persist()

    def write(batch: DataFrame, number: int) -> None:
        seen = profile(batch, model=model)
        out = fu.fuse(seen.rows, stats, calibration, dropped=seen.dropped)
        out.select("doc_id", "tier", "score", "families_fired", "evidence").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
