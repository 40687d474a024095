"""streaming of framescope."""
