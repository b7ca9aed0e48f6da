"""sluicebox: profiling, cleaning, validating and reconciling messy tables as Spark plans."""

from .errors import TableError
from .session import StagingScope, build_session, configure_session, release_staged
from .table import ROW_NO, display_names, from_frame, with_display_names

__all__ = [
    "ROW_NO",
    "TableError",
    "build_session",
    "configure_session",
    "display_names",
    "from_frame",
    "StagingScope",
    "release_staged",
    "with_display_names",
]
