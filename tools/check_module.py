"""Check the queries of the named query modules: python tools/check_module.py intake vectors"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import check_oracle
from idsieve.queries.registry import MODULE_OF
import idsieve.queries  # noqa: F401

sf = os.environ.get("SF", "/root/testdata/sf0.01")
names = [n for n, m in MODULE_OF.items() if m in sys.argv[1:]]
sys.argv = ["check", sf, *names]
sys.exit(check_oracle.main())
