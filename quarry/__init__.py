"""quarry: exact table profiling and document-text operators on Spark.

The main entry points::

    from quarry import TableProfile, report, read_delimited, grid_to_table
    from quarry import query, documents, SnapshotStore, StreamingProfile
"""

from quarry.operators import documents, query
from quarry.operators.profile import TableProfile
from quarry.plans import report
from quarry.session import build_session, checkpoint_root
from quarry.sources.delimited import grid_to_table, read_delimited
from quarry.sources.files import file_check, file_inventory, load_summary
from quarry.sources.snapshots import SnapshotStore, latest_per_key, older_than_newest
from quarry.streaming.profile_stream import StreamingProfile

__all__ = [
    "TableProfile", "report", "query", "documents", "read_delimited", "grid_to_table",
    "file_inventory", "file_check", "load_summary", "SnapshotStore", "latest_per_key",
    "older_than_newest", "StreamingProfile", "build_session", "checkpoint_root",
]
