"""Structured Streaming entry point.

The reference cleans one whole uploaded file per request; the streaming
form treats each micro-batch as such a file: ``clean_stream`` runs the batch
pipeline on every micro-batch through ``foreachBatch`` and writes the result
under a per-batch folder, so a retried batch overwrites its own output
(idempotent) and progress is tracked by the query checkpoint.
"""

from siftframe.streaming.batches import clean_stream

__all__ = ["clean_stream"]
