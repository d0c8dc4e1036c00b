"""Intentionally empty.

The reviewed tool scores one uploaded ledger at a time; it has no streams, event-time
windows, watermarks or incremental state, so there is no streaming operator to carry
over. A continuously arriving ledger is reviewed by running ``plans.review.review`` on
the accumulated table (every pass is a bounded number of scans), not by a stream job.
"""
