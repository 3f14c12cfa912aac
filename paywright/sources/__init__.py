"""Event log and changelog sources and sinks."""
