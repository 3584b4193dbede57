"""Sources and sinks: raw matrices, checkpoints of collections."""
