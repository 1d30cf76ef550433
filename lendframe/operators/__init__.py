"""DataFrame in, DataFrame out; columns are passed by name."""
