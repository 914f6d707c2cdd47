"""Print the formatted physical plan of registered queries.

    python tools/plans.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

if __name__ == "__main__":
    from eddy.config import build_session
    from eddy.plans.catalog import QUERIES
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("local[8]")
    for name in args or ["cf_by_tick"]:
        print(f"# {name}")
        QUERIES[name](spark, sf).explain("formatted")
