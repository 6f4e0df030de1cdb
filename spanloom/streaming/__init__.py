"""The stateful operators over streams of events."""
