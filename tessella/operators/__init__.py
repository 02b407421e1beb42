"""Operators from DataFrame to DataFrame over pixels, frames, tiles, jobs and checks."""
