"""Vector-based visual retrieval and frame selection on Spark."""

from .operators.descriptor import SpatialDescriptor
from .session import get_session
from .sources.index_store import VectorIndex, open_index

__version__ = "0.2.0"
__all__ = ["SpatialDescriptor", "VectorIndex", "get_session", "open_index"]
