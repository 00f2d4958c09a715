"""The message log, delivery and recovery, in batch and as streams."""
