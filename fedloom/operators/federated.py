"""Federated averaging of client parameters, in dense blocks or in long form.

A parameter document is nested objects and arrays.  In blocks each innermost
array of numbers is a row ``(keys..., path, lead, block, values)``: ``path``
joins the object keys with dots, ``lead`` lists the outer array positions, and
an array of more than ``BLOCK`` numbers comes in numbered blocks.  Averaging
adds whole vectors, with map-side partial sums, so a weight costs eight bytes
in the shuffle.  In long form every number is a row ``(keys..., path, pos,
value)``, for documents that are looked at number by number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .columns import q

# Parameters that describe a model and are never averaged.
METADATA_KEYS = (
    "n_features", "n_classes", "max_depth", "n_leaves", "n_nodes",
    "task_type", "random_state", "min_samples_split", "min_samples_leaf",
)
BLOCK = 65_536
ROUND_KEYS = ("session_id", "round")
CLIENT = "client_id"
#: Rounds whose client counts are broadcast; more are joined through a shuffle.
BROADCAST_ROUNDS = 200_000


def flatten_params(df: DataFrame, document: str, keys: Sequence[str], max_depth: int | None = None) -> DataFrame:
    """Leaves of JSON documents: ``keys..., path, pos, text, value``.

    Each level is one narrow ``variant_explode``.  The number of levels is the deepest document's, found in one pass
    over the brackets; where it is known, ``max_depth`` saves that pass, and a deeper document fails.  A dot inside a
    key is escaped.  Parameters too large for one JSON value belong in typed array columns (``flatten_array``).
    """
    level, max_depth = _opened(df, document, keys, max_depth, _is_open)
    deep = _is_open(F.col("node"))
    text = F.when(deep, _too_deep(max_depth)).otherwise(F.try_variant_get("node", "$", "string"))
    leaves = level.select(*keys, "path", "pos", text.alias("text"))
    return leaves.withColumn("value", F.col("text").try_cast("double"))


def _too_deep(max_depth: int) -> Column:
    return F.raise_error(F.lit(f"parameters nested deeper than {max_depth} levels")).cast("string")


def _opened(df: DataFrame, document: str, keys: Sequence[str], max_depth: int | None, is_open) -> tuple[DataFrame, int]:
    """The nodes of each document, ``path, pos, node``, after all levels where ``is_open(node)`` are opened."""
    if max_depth is None:
        max_depth = df.agg(F.max(nesting(q(document)))).first()[0] or 0
    level = df.select(
        *keys, F.lit("").alias("path"), F.array().cast("array<int>").alias("pos"), F.parse_json(q(document)).alias("node")
    )
    for _ in range(max_depth):
        level = _open_level(df.sparkSession, level, keys, is_open)
    return level, max_depth


def nesting(document: Column) -> Column:
    """How deep objects and arrays of a JSON text are nested; brackets inside strings do not count."""
    bare = F.regexp_replace(document, r'"(?:[^"\\]|\\.)*"', "")
    brackets = F.split(F.regexp_replace(F.translate(bare, "{}", "[]"), r"[^\[\]]", ""), "")
    steps = F.transform(brackets, lambda c: F.when(c == "[", 1).when(c == "]", -1).otherwise(0))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    walk = lambda state, step: F.struct((state["now"] + step).alias("now"), F.greatest(state["most"], state["now"] + step).alias("most"))
    return F.aggregate(steps, zero, walk)["most"]


def _is_open(node: Column) -> Column:
    return F.schema_of_variant(node).rlike("^(ARRAY|OBJECT)")


_NUMBER = r"(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(\d+,\d+\))"


def _is_number(node: Column) -> Column:
    return F.schema_of_variant(node).rlike(f"^{_NUMBER}$")


def _is_numbers(node: Column) -> Column:
    """Whether a node is an array of numbers only."""
    return F.schema_of_variant(node).rlike(f"^ARRAY<{_NUMBER}>$")


def _open_level(spark, level: DataFrame, keys: Sequence[str], is_open) -> DataFrame:
    """Explode arrays and objects once; leaves pass through as one-element arrays."""
    boxed = level.withColumn("open", is_open(F.col("node")))
    holder = F.when(F.col("open"), F.col("node")).otherwise(F.to_variant_object(F.array("node")))
    opened = boxed.withColumn("holder", holder).alias("t").lateralJoin(
        spark.tvf.variant_explode(F.col("t.holder").outer()).alias("e")
    )
    key = F.regexp_replace("e.key", r"([.\\])", r"\\$1")
    joined_path = F.when(F.col("t.path") == "", key).otherwise(F.concat_ws(".", "t.path", key))
    is_object = F.col("t.open") & F.col("e.key").isNotNull()
    is_array = F.col("t.open") & F.col("e.key").isNull()
    return opened.select(
        *[F.col(f"t.{k}") for k in keys],
        F.when(is_object, joined_path).otherwise(F.col("t.path")).alias("path"),
        F.when(is_array, F.array_append("t.pos", F.col("e.pos"))).otherwise(F.col("t.pos")).alias("pos"),
        F.col("e.value").alias("node"),
    )


def flatten_array(df: DataFrame, column: str, keys: Sequence[str], path: str | None = None) -> DataFrame:
    """Leaves of a typed (nested) array column in long form, one ``posexplode`` per level."""
    kind = df.schema[column].dataType
    level = df.select(*keys, F.lit(path or column).alias("path"), F.array().cast("array<int>").alias("pos"), q(column).alias("node"))
    while isinstance(kind, T.ArrayType):
        exploded = level.select(*keys, "path", "pos", F.posexplode("node").alias("i", "node"))
        level = exploded.select(*keys, "path", F.array_append("pos", F.col("i")).alias("pos"), "node")
        kind = kind.elementType
    return level.select(*keys, "path", "pos", F.col("node").cast("double").alias("value"))


def parameter_blocks(df: DataFrame, document: str, keys: Sequence[str], max_depth: int | None = None) -> DataFrame:
    """Parameters of JSON documents as dense blocks: ``keys..., path, lead, block, values, text``.

    An array of numbers stays one value while the levels above it are opened.  A single number, also one written as
    text, is a block of one with ``lead`` NULL; a leaf that is no number has ``values`` NULL and its ``text``.  Empty
    arrays have no rows; an array that mixes numbers with other things, NULL included, is refused.
    """
    outer = lambda node: _is_open(node) & ~_is_numbers(node)
    level, max_depth = _opened(df, document, keys, max_depth, outer)
    node, array, alone = F.col("node"), _is_numbers(F.col("node")), F.size("pos") == 0
    text = F.when(~array, F.when(_is_open(node), _too_deep(max_depth)).otherwise(F.try_variant_get("node", "$", "string")))
    mixed = F.raise_error(F.concat(F.lit("numbers and other things in one array: "), F.col("path"))).cast("array<double>")
    numbers = F.when(array, F.try_variant_get("node", "$", "array<double>")).when(alone, _one(text.try_cast("double"))).when(_is_number(node), mixed)
    lead = F.when(array | ~alone, F.col("pos"))
    return _cut(level.select(*keys, "path", lead.alias("lead"), numbers.alias("numbers"), text.alias("text"), array.alias("dense")), keys)


def array_blocks(df: DataFrame, column: str, keys: Sequence[str], path: str | None = None) -> DataFrame:
    """The same from a typed (nested) array column: outer levels are exploded, innermost arrays stay whole."""
    kind = df.schema[column].dataType
    level = df.select(*keys, F.lit(path or column).alias("path"), F.array().cast("array<int>").alias("lead"), q(column).alias("numbers"))
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        exploded = level.select(*keys, "path", "lead", F.posexplode("numbers").alias("i", "numbers"))
        level = exploded.select(*keys, "path", F.array_append("lead", F.col("i")).alias("lead"), "numbers")
        kind = kind.elementType
    single = not isinstance(kind, T.ArrayType)
    numbers = _one(F.col("numbers").cast("double")) if single else F.col("numbers").cast("array<double>")
    lead = F.lit(None).cast("array<int>") if single else F.col("lead")
    return _cut(level.select(*keys, "path", lead.alias("lead"), numbers.alias("numbers"), F.lit(None).cast("string").alias("text"), F.lit(not single).alias("dense")), keys)


def _one(value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(value))


def _cut(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arrays of numbers cut into blocks; what is none passes as it is."""
    # the explode of one element keeps the array from being worked out anew for each block
    held = leaves.select(*keys, "path", "lead", "text", "dense", F.explode(F.array("numbers")).alias("numbers"))
    size = F.size("numbers")
    starts = F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / BLOCK), F.lit(0)).cast("int"))
    parts = F.when(F.col("numbers").isNull() | (size <= BLOCK), F.array("numbers")).otherwise(F.transform(starts, lambda i: F.slice("numbers", i * BLOCK + 1, F.lit(BLOCK))))
    rows = held.filter(F.col("numbers").isNull() | (size > 0)).select(*keys, "path", "lead", "text", "dense", F.posexplode(parts).alias("block", "values"))
    gap = F.exists("values", lambda v: v.isNull())
    values = F.when(F.coalesce(gap, F.lit(False)), F.raise_error(F.concat(F.lit("not a number for every client: "), F.col("path"))).cast("array<double>")).otherwise(F.col("values"))
    return rows.select(*keys, "path", "lead", "block", values.alias("values"), "text", "dense")


def fedavg_blocks(blocks: DataFrame, keys: Sequence[str] = ROUND_KEYS, totals: DataFrame | None = None) -> DataFrame:
    """Unweighted mean over the clients of a round, block by block: ``keys..., path, lead, block, values, metadata``.

    Blocks of one length are added up as vectors, with partial sums in every map task; where clients have arrays of
    different lengths, their few sums are then added position by position.  The rest is as in ``fedavg``: the divisor
    is the number of clients of the round, metadata and texts pass through from the smallest client, and a leaf that
    is a number for some clients only is refused.  The columns are those of ``fedavg_rebuild``.
    """
    totals = client_totals(blocks, keys) if totals is None else totals
    totals = materialize(totals.select(*keys, "num_clients"))
    if totals.count() <= BROADCAST_ROUNDS:
        totals = F.broadcast(totals)
    place = [*keys, "path", "lead", "block"]
    length = F.coalesce(F.size("values"), F.lit(-1))
    vector = array_to_vector(F.coalesce("values", F.array(F.lit(0.0))))
    same = blocks.groupBy(*place, F.when(F.col("values").isNull(), -1).otherwise(length).alias("length")).agg(
        Summarizer.sum(vector).alias("total"), F.min_by(F.struct("text", "values"), CLIENT).alias("first"), F.min(CLIENT).alias("client"), F.max("dense").alias("dense"),
    )
    sums = same.select(*place, "length", vector_to_array("total").alias("total"), "first", "client", "dense").groupBy(*place).agg(
        F.collect_list(F.when(F.col("length") > 0, F.col("total"))).alias("totals"), F.max((F.col("length") < 0).cast("int")).alias("texts"),
        F.min_by("first", "client").alias("first"), F.max("dense").alias("dense"),
    )
    added = F.aggregate("totals", F.array().cast("array<double>"), lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))
    passed = (~F.col("dense") & _names_metadata(F.col("path")) & F.col("lead").isNull()) | (F.size("totals") == 0)
    torn = F.raise_error(F.concat(F.lit("not a number for every client: "), F.col("path"))).cast("array<double>")
    mean = F.when(passed, None).when(F.col("texts") > 0, torn).otherwise(F.transform("sum", lambda v: v / F.col("num_clients")))
    text = F.coalesce(F.col("first.text"), F.array_join(F.col("first.values").cast("array<string>"), ","))
    joined = sums.withColumn("sum", added).join(totals, list(keys))
    return joined.select(*place, mean.alias("values"), F.when(passed, text).alias("metadata"))


def blocks_to_long(averaged: DataFrame, keys: Sequence[str] = ROUND_KEYS) -> DataFrame:
    """Averaged blocks in long form, the columns of ``fedavg``."""
    cells = averaged.select(*keys, "path", "lead", "block", "metadata", F.posexplode_outer("values").alias("k", "value"))
    at = F.array((F.col("block") * BLOCK + F.col("k")).cast("int"))
    pos = F.when(F.col("lead").isNull(), F.array().cast("array<int>")).when(F.col("value").isNull(), F.col("lead")).otherwise(F.concat("lead", at))
    return cells.select(*keys, "path", pos.alias("pos"), "value", "metadata")


def is_metadata(path: Column, pos: Column | None = None) -> Column:
    """Whether a leaf describes the model: a single value, not a list, under one of the metadata names."""
    pos = F.col("pos") if pos is None else pos
    return (F.size(pos) == 0) & _names_metadata(path)


def _names_metadata(path: Column) -> Column:
    return path.rlike(r"(^|(?<!\\)\.)(" + "|".join(METADATA_KEYS) + ")$")


def client_totals(params: DataFrame, keys: Sequence[str] = ROUND_KEYS) -> DataFrame:
    """Clients per session and round."""
    return params.select(*keys, CLIENT).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("num_clients"))


def fedavg(params: DataFrame, keys: Sequence[str] = ROUND_KEYS, totals: DataFrame | None = None) -> DataFrame:
    """Unweighted mean over the clients of a round, per path and position.

    The divisor is the number of clients of the round, also where a client
    lacks the position; ``totals`` supplies it when it is already known.
    Metadata and leaves that are no number pass through from the smallest
    client; a leaf that is a number for some clients only is refused.
    """
    totals = client_totals(params, keys) if totals is None else totals
    text = F.col("text") if "text" in params.columns else F.lit(None).cast("string")
    sums = params.groupBy(*keys, "path", "pos").agg(
        F.sum("value").alias("total"), F.count("value").alias("numbers"), F.count(F.lit(1)).alias("leaves"), F.min_by(text, CLIENT).alias("text")
    )
    passed = is_metadata(F.col("path")) | (F.col("numbers") == 0)
    torn = F.raise_error(F.concat(F.lit("not a number for every client: "), F.col("path")))
    mean = F.when(passed, None).when(F.col("numbers") < F.col("leaves"), torn.cast("double")).otherwise(F.col("total") / F.col("num_clients"))
    return sums.join(totals, list(keys)).select(*keys, "path", "pos", mean.alias("value"), F.when(passed, F.col("text")).alias("metadata"))


def fedavg_metadata(params: DataFrame, keys: Sequence[str] = ROUND_KEYS) -> DataFrame:
    """What an aggregation covered: session, round, number of clients."""
    return client_totals(params, keys)


def fedavg_rebuild(averaged: DataFrame, keys: Sequence[str] = ROUND_KEYS) -> DataFrame:
    """Innermost arrays put back in order: one row per path, leading position and block.

    A row of a weight matrix is one array; whole matrices stay distributed, and
    a longer flat vector comes in numbered blocks, so no group grows without bound.
    A scalar has no ``lead`` and one value, a leaf that was passed through no
    ``values`` but its text as ``metadata``.
    """
    depth = F.size("pos")
    single = depth == 0
    lead = F.when(~single, F.slice("pos", F.lit(1), F.greatest(depth - 1, F.lit(0)))).alias("lead")
    at = F.coalesce(F.try_element_at("pos", F.lit(-1)), F.lit(0))
    block = F.floor(at / BLOCK).cast("int").alias("block")
    cell = F.struct(at.alias("at"), F.col("value").alias("value"))
    numbers = averaged.filter(F.col("value").isNotNull())
    rows = numbers.groupBy(*keys, "path", lead, block).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    arrays = rows.select(*keys, "path", "lead", "block", F.transform("cells", lambda c: c["value"]).alias("values"), F.lit(None).cast("string").alias("metadata"))
    passed = averaged.filter(F.col("value").isNull()).select(
        *keys, "path", F.when(~single, F.col("pos")).alias("lead"), F.lit(0).alias("block"), F.lit(None).cast("array<double>").alias("values"), "metadata"
    )
    return arrays.unionByName(passed)
