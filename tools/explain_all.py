"""Print the formatted physical plan of registered queries (after running them,
so AQE's final plan is shown). Usage:
python tools/explain_all.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from verdant.plans.catalog import QUERIES  # noqa: E402
from verdant.session import get_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(QUERIES)
    spark = get_session("local[8]", 8)
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        df.collect()
        print(f"===== {name}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
