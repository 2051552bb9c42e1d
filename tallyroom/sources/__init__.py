"""Landed inputs: event batches, webhooks, exports, report files; and the sinks."""
