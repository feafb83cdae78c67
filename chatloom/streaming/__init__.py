"""Nothing to build here: the work this library covers has no streaming operator, no watermark and no keyed state.

The row-local functions (chatloom.functions) apply to a streaming DataFrame unchanged; tests/test_streaming.py shows
that for rendering, splitting and chunking.
"""
