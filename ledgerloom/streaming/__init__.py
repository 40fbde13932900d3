"""The polling parts of a claims desk as Structured Streaming jobs."""
