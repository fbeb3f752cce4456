"""The rig's reports from a health indicator: onsets and diagnoses, their evaluation, remaining life."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewright.operators import vibration as V

LIMIT, PERSISTENCE, MAX_LEAD = 10.0, 3, 168.0


def known_failures(hi: DataFrame, settings: Mapping) -> DataFrame:
    """test, bearing, known_failure of the bearings that failed: a configuration table."""
    rows = [(int(x["test"]), int(x["bearing"]), str(x["failure"])) for x in settings.get("known", [])]
    kinds = dict(hi.dtypes)
    return hi.sparkSession.createDataFrame(rows, "test int, bearing int, known_failure string").select(F.col("test").cast(kinds["test"]).alias("test"), F.col("bearing").cast(kinds["bearing"]).alias("bearing"), "known_failure")


def reports(hi: DataFrame, settings: Mapping) -> dict[str, DataFrame]:
    """onsets, evaluation, life and naive_life of every bearing of the indicator table `hi`."""
    known = known_failures(hi, settings)
    envelope = {f"z_env_{f}": f for f in V.FAULTS if f"z_env_{f}" in hi.columns}
    named = {"bpfo": "outer_race", "bpfi": "inner_race", "bsf": "roller"}
    onsets = V.onset_summary(hi, settings.get("limit", LIMIT), settings.get("persistence", PERSISTENCE), known, {c: named.get(f, f) for c, f in envelope.items()}, settings.get("max_lead_hours", MAX_LEAD))
    failed = known.select("test", "bearing")
    life = V.remaining_life(hi, onsets.filter("onset_hours is not null").select("test", "bearing", "onset_hours"), failed)
    flat = onsets.withColumn("alarm_hours", F.array_join(F.transform("alarm_hours", lambda x: F.round(x, 2).cast("string")), " "))
    return {"onsets": flat, "evaluation": V.evaluate_onsets(onsets), "life": life, "naive_life": V.naive_life(onsets)}
