"""plans of framescope."""
