"""Streams: event-time windows and zones that are kept up to date."""
