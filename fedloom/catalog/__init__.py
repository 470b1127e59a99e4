"""All registered queries; importing this package fills the registry."""

from . import cleaning, evaluation, flows, landing, profiling, reporting, training  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
