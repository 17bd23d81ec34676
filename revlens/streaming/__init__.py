"""State operators on streams: the same results as their batch forms once all events are in."""
