"""Statement files: loading, routing, decoding, expanding, and reading records; sinks."""
