"""Multispectral rasters and decision analytics as Spark DataFrames.

One row per pixel observation, one column per band.  Every public function
takes DataFrames or Columns and returns DataFrames or Columns; nothing runs
until the caller triggers an action, except where a docstring says otherwise.
"""

__version__ = "0.1.0"
