"""Column functions: page names and numbers, ranges, sizes and durations, geometry, hue."""
