"""weft: a source-graph analytics engine expressed as Spark DataFrame transformations."""
