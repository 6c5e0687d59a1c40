"""Streams: scoring against a fixed model, and a model that follows a stream by one move per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mixlake.operators.inference import Fit
from mixlake.operators.model import Model


def score_stream(stream: DataFrame, model: Model) -> DataFrame:
    """Each arriving encoded row with its log-probability: joins with the model's static lookups only."""
    return model.logprob(stream)


def follow(stream: DataFrame, fit: Fit, checkpoint: str) -> StreamingQuery:
    """One sequential Monte Carlo step per micro-batch, and the fit saved after each under checkpoint/fit.

    A restarted query goes on from what was saved there (`fit` then takes that state). A batch id that the saved state
    has seen is skipped; one whose step was lost before it was saved is done again from the state before it.
    """
    states = f"{checkpoint}/fit"
    last = -1
    if found := Fit.resume(fit.rows, states):
        kept, last = found
        fit.__dict__.update(kept.__dict__)

    def step(batch: DataFrame, batch_id: int) -> None:
        nonlocal last
        if batch_id > last and not batch.isEmpty():
            fit.smc_step(batch)
            fit.save(states, batch_id)
            last = batch_id

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
