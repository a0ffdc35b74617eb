"""Tidewright: event-time analytics for keyed observation streams, as DataFrame and Structured Streaming plans."""
