"""Sources and sinks: table readers, stand-in inputs, idempotent load, layout."""

from costlens.sources.tables import Tables, read_spend_logs, read_virtual_keys
from costlens.sources.testdata import load_tables

__all__ = ["Tables", "read_spend_logs", "read_virtual_keys", "load_tables"]
