"""grainmill: multilevel graph coarsening and coarsening-aware learning on Spark DataFrames."""
