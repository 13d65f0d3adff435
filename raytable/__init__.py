"""raytable: Spark DataFrame operators for correspondence, track, ray, point and raster tables."""
