"""Sources and sinks: file listings, tables of measurements, tiled TIFF images."""
