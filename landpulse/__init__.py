"""Disturbance, flood and drought monitoring on Spark DataFrames.

Imagery is held as long-form pixel tables keyed ``(tile_id, epoch, row, col)``
with one nullable double column per band. Every operator takes and returns
DataFrames (or Columns), so Catalyst sees one declarative plan.
"""
