"""Physical-shape helpers: staging, checked broadcasts, skew-safe running totals and percentiles."""
