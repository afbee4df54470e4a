"""Where relations come from: the retrieve catalog, terminology tables, sinks."""
