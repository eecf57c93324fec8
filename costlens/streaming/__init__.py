"""Structured Streaming: daily rollup (T1/T2/T4), reconcile (T5), alerts (T3), bundle."""
