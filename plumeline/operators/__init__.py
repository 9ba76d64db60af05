"""Operators over DataFrames: times, calibration, exposure, rollups, contrasts, quality, space and models."""
