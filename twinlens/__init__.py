"""twinlens: agreement analysis of paired tool reports, expressed as lazy Spark plans."""
