"""Display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model names with a set spelling.
MODEL_NAMES = {
    "LinearRegression": "Linear Regression",
    "LandMarkSVM": "Land Mark SVM",
    "multiLayerPerceptron": "Multi Layer Perceptron",
}
# Size units, each 1024 times the one before.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def pretty_model_name(name: Column) -> Column:
    """Camel case split into words, first letter upper."""
    spaced = F.trim(F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", " "))
    shown = F.concat(F.upper(F.substring(spaced, 1, 1)), F.substr(spaced, F.lit(2)))
    result = F.when(name.isNull() | (name == "Unknown"), name)
    for raw, fixed in MODEL_NAMES.items():
        result = result.when(name == raw, F.lit(fixed))
    return result.otherwise(shown)


def human_size(size: Column) -> Column:
    """Bytes with two decimals in the largest unit below 1024."""
    def shown(i: int) -> Column:
        return F.format_string(f"%.2f {SIZE_UNITS[i]}", F.bround(size / F.lit(1024.0**i), 2))

    top = len(SIZE_UNITS) - 1
    result = F.when(size < 1024, shown(0))
    for i in range(1, top):
        result = result.when(size < 1024.0 ** (i + 1), shown(i))
    return result.when(size.isNotNull(), shown(top))
