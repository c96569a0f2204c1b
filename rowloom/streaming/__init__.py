"""The row-wise operators run on streams unchanged; here are the sinks."""
