"""The live path as Structured Streaming."""
