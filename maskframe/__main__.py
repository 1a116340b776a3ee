"""``python -m maskframe``: see ``maskframe.plans.job``."""

import sys

from .plans.job import main

sys.exit(main())
