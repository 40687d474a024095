"""functions of framescope."""
