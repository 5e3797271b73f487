"""Incremental tables over streams. The domain is batch; this keeps its counts current as points arrive."""
