"""Incremental ingest as a file-source stream; batch results stay the same."""
