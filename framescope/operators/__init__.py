"""operators of framescope."""
