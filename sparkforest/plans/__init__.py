"""Planning helpers: checkpoints, iteration, size-checked joins, streamed groups."""
