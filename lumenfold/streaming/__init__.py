"""Commands as a stream: the latest value of every parameter, and filters that re-derive a frame."""
