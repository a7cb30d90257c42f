"""loomstream: pipeline queries over tagged, causally ordered event streams, run as Spark plans."""
