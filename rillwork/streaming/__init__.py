"""Structured Streaming: ordered reassembly and live playlists."""
