"""Training-data operators. Nothing outside this folder (and the pipeline file
at the repository top) imports it."""
