"""Model-name normalisers.

Both strip only the first ``provider/`` segment.  They disagree on a trailing
slash: ``openai/`` becomes ``''`` in the per-key path but stays ``openai/`` in
the all-keys path.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _after_first_slash(model: Column) -> Column:
    # instr = 0 when there is no slash, so substr(model, 1) is the whole text.
    return model.substr(F.instr(model, "/") + 1, F.lit(1 << 30))


def per_key_model(model: Column) -> Column:
    """Text after the first ``/``; unchanged when there is none (NULL/'' kept)."""
    return F.when(F.instr(model, "/") > 0, _after_first_slash(model)).otherwise(model)


def all_keys_model(model: Column) -> Column:
    """As X4, but an empty remainder keeps the original text."""
    return F.coalesce(F.nullif(_after_first_slash(model), F.lit("")), model)


def has_model(model: Column) -> Column:
    """model is neither NULL nor empty."""
    return model.isNotNull() & (model != F.lit(""))
