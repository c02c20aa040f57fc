"""Column expressions: cleaning, time, geometry, calibration."""
