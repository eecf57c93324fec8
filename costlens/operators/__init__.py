"""Report operators: DataFrame in, DataFrame out, all keys at once."""
