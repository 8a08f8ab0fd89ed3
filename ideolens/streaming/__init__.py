"""Streaming: intentionally empty.

The analyses this engine rebuilds are batch only (static scans, file outputs);
they have no watermark, window, session or stateful operator, so nothing here is
built.  Every table operator is a plain DataFrame function, so an incremental
caller can still apply the row-local ones (``valid_votes``, ``race_key``, the
text functions) to a ``readStream`` frame unchanged.
"""
