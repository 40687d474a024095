"""sources of framescope."""
