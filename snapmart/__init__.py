"""Monthly credit-risk snapshots as Spark jobs.

Sub-packages:

* ``functions``  column functions (text, numbers, dates, encoding)
* ``operators``  frame-to-frame operators
* ``sources``    readers, partitioned writers, audits, model artefacts
* ``plans``      whole tables and jobs built from the operators
* ``catalogue``  the registered queries with their SQL twins
"""

from snapmart.session import build_session

__all__ = ["build_session"]
