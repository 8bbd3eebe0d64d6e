"""ledgerlark: procurement and revenue analytics as Spark DataFrame operators.

Every operator is a plain ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, so Catalyst plans the scans, joins, aggregations and windows.  Python
runs inside Spark tasks only for the isolation forest (tree fitting and scoring).
"""

from ledgerlark.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
