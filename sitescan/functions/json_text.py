"""JSON as people write it: repeated keys and numbers that are none.

Spark's reader refuses a text with a repeated key or with NaN or Infinity as a whole. Such a text is written
anew: of a repeated key the last value counts, and what is no number becomes null.
"""

import json
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The function travels with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def plain_json(text: str) -> str | None:
    """The same as JSON that every reader takes; None for a text that is so already, and for what is no JSON at all."""
    odd = []

    def members(pairs):
        found = dict(pairs)
        if len(found) != len(pairs):
            odd.append("key")
        return found

    try:
        value = json.loads(text, object_pairs_hook=members, parse_constant=odd.append)
    except (ValueError, RecursionError):
        return None
    return json.dumps(value, ensure_ascii=False) if odd else None


def read_json(text) -> Column:
    """The text as a variant, NULL if it is no JSON. Only texts that Spark refuses go through Python."""
    strict = F.try_parse_json(text)

    @F.arrow_udf("string")
    def again(texts: pa.Array) -> pa.Array:
        return pa.array([t.as_py() and plain_json(t.as_py()) for t in texts], pa.string())

    return F.coalesce(strict, F.try_parse_json(again(F.when(strict.isNull(), text))))
